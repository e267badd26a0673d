"""Sources.  Paths are any Hadoop URI; nothing is read through the driver but a few sniffed lines."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..core import as_list
from . import delimited

# --- fixed values ------------------------------------------------------------
DELIMITERS = [",", ";", "\t", "|"]
ENVELOPES = ["data", "records", "results"]
ENCODINGS = ["utf-8", "iso-8859-1"]
# --- end of fixed values -----------------------------------------------------

CORRUPT = "_corrupt_record"


def sniff_delimiter(spark: SparkSession, paths, encoding: str | None = None) -> str:
    """Candidate that splits the first five lines most often and most evenly."""
    reader = spark.read.option("encoding", encoding) if encoding else spark.read
    lines = [r.value for r in reader.text(as_list(paths)).limit(5).collect() if r.value.strip()]

    def fit(mark):
        counts = [line.count(mark) for line in lines]
        return (min(counts) if counts else 0, sum(counts))

    best = max(DELIMITERS, key=fit)
    return best if fit(best)[1] else ","


def find_encoding(spark: SparkSession, paths, encodings=None) -> str:
    """First of the encodings in which no line has an undecodable byte, else the last; one pass for each one tried."""
    encodings = list(encodings or ENCODINGS)
    for name in encodings[:-1]:
        if spark.read.option("encoding", name).csv(as_list(paths), sep="\x01", quote="", schema="line string").where(F.col("line").contains("\ufffd")).isEmpty():
            return name
    return encodings[-1]


def read_delimited(spark: SparkSession, paths, delimiter: str | None = None, encoding: str | None = None, schema=None,
                   keep_corrupt: bool = False, header: bool = True, multi_line: bool | None = None) -> DataFrame:
    """CSV, TSV or TXT as text columns (or with a schema); no inference pass over the data.

    Quoted values may hold delimiters, doubled quotes and line breaks.  Files are
    split among tasks in either case: one pass finds out which splits start inside
    quotes (``delimited``), and if none does, and no record runs over a line, the
    lines are parsed as they are.  Compressed files, and encodings whose line breaks
    are not the byte 10, are read whole by one task each, as ``multi_line=True`` has
    it; ``multi_line=False`` takes every line for a record and spares the pass.
    Lines end in a line feed, with or without a carriage return before it.
    ``encoding="auto"`` takes the first of ``ENCODINGS`` that fits.
    """
    paths = as_list(paths)
    if encoding == "auto":
        encoding = find_encoding(spark, paths)
    mark = delimiter or sniff_delimiter(spark, paths, encoding)
    options = {"sep": mark, "mode": "PERMISSIVE", "escape": '"'}
    if schema is not None and keep_corrupt:
        schema = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
        options["columnNameOfCorruptRecord"] = CORRUPT

    def plain(lines: bool) -> DataFrame:
        reader = spark.read.options(**options).option("header", header).option("multiLine", lines)
        reader = reader.option("encoding", encoding) if encoding else reader
        return (reader.schema(schema) if schema is not None else reader).csv(paths)

    if multi_line is not None or len(mark) != 1 or not delimited.can_split(encoding, [f for p in paths for f in ([p] if "." in p.rsplit("/", 1)[-1] else spark.read.text(p).inputFiles())]):
        return plain(multi_line is None or multi_line)
    lines = delimited._lines(spark, paths, encoding, mark)
    if lines.where("opens").isEmpty():
        return plain(False)
    start, _ = delimited.split_states(lines)
    return delimited.parsed(delimited.records(lines, start), plain(True).schema, options, header)


def flatten_structs(df: DataFrame, separator: str = "_") -> DataFrame:
    """Nested objects become columns ``outer_inner``; arrays stay."""
    def leaves(fields, prefix, path):
        for f in fields:
            name = f"{prefix}{separator}{f.name}" if prefix else f.name
            here = path + [f.name]
            if isinstance(f.dataType, T.StructType):
                yield from leaves(f.dataType.fields, name, here)
            else:
                yield F.col(".".join(f"`{p}`" for p in here)).alias(name)

    return df.select(*leaves(df.schema.fields, "", []))


def read_json_records(spark: SparkSession, paths, records_path: str | None = None, schema=None) -> DataFrame:
    """Array, single object, or a ``data`` / ``records`` / ``results`` envelope; nested objects flattened."""
    reader = spark.read.option("multiLine", True).option("mode", "PERMISSIVE")
    raw = (reader.schema(schema) if schema is not None else reader).json(as_list(paths))
    wanted = [records_path] if records_path else ENVELOPES
    for name in wanted:
        kind = raw.schema[name].dataType if name in raw.columns else None
        if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
            raw = raw.select(F.explode(F.col(f"`{name}`")).alias("_r")).select("_r.*")
            break
    return flatten_structs(raw)


def read_jsonl(spark: SparkSession, paths, schema: T.StructType | str) -> DataFrame:
    """One object per line; blank lines and ``#`` comments skipped, bad lines kept in ``_corrupt_record``."""
    kind = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    full = T.StructType(list(kind.fields) + [T.StructField(CORRUPT, T.StringType())])
    lines = spark.read.text(as_list(paths)).where(~F.trim("value").startswith("#") & (F.trim("value") != ""))
    parsed = F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    return lines.select(parsed.alias("_r")).select("_r.*")


def read_parquet(spark: SparkSession, paths, columns=None) -> DataFrame:
    df = spark.read.parquet(*as_list(paths))
    return df.select(*as_list(columns)) if columns else df


def read_folder(spark: SparkSession, folder: str, glob: str = "*.csv", delimiter: str | None = None) -> dict[str, DataFrame]:
    """File name without ending -> table, for every matching file below the folder.

    Each table is sniffed by a job of its own; files of one layout are read at once by ``read_collection``.
    """
    found = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(folder).select("path").collect()
    return {
        re.sub(r"\.[^.]*$", "", r.path.rsplit("/", 1)[-1]): read_delimited(spark, r.path, delimiter)
        for r in sorted(found, key=lambda r: r.path)
    }


def read_collection(spark: SparkSession, folder: str, glob: str = "*.csv", delimiter: str = ",", schema=None) -> DataFrame:
    """All files of one layout as one table with a ``dataset`` column (the file's name)."""
    reader = spark.read.option("header", True).option("sep", delimiter).option("recursiveFileLookup", True).option("pathGlobFilter", glob)
    df = (reader.schema(schema) if schema is not None else reader).csv(folder)
    name = F.regexp_extract(F.input_file_name(), r"([^/]+)\.[^./]*$", 1)
    return df.select(name.alias("dataset"), *df.columns)


def read_jdbc(spark: SparkSession, url: str, table: str | None = None, query: str | None = None, limit: int | None = None,
              partition_column: str | None = None, bounds: tuple | None = None, num_partitions: int = 8, options: dict | None = None) -> DataFrame:
    """Table or SELECT-only query, all rows unless ``limit`` is given; with a partition column and bounds it is read in parallel ranges."""
    if (table is None) == (query is None):
        raise ValueError("give either a table or a query")
    if query is not None:
        bare = query.strip().rstrip(";")
        if ";" in bare or not re.match(r"(?is)(select|with)\b", bare):
            raise ValueError("only SELECT queries are allowed")
    reader = spark.read.format("jdbc").option("url", url).options(**(options or {}))
    reader = reader.option("dbtable", table if table is not None else f"({bare}) q")
    if partition_column:
        low, high = bounds
        reader = reader.option("partitionColumn", partition_column).option("lowerBound", low).option("upperBound", high).option("numPartitions", num_partitions)
    df = reader.load()
    return df.limit(limit) if limit is not None else df


def read_stream(spark: SparkSession, path: str, schema, fmt: str = "csv", max_files: int | None = None) -> DataFrame:
    """File stream; a schema is required."""
    reader = spark.readStream.schema(schema).format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)


def decode_messages(df: DataFrame, fmt: str = "json", schema: T.StructType | str | None = None, fields: int = 0) -> DataFrame:
    """Message bytes -> record columns plus ``_kafka_partition``, ``_kafka_offset``, ``_kafka_timestamp``.

    Works on any batch or streaming table with ``value, partition, offset,
    timestamp``.  A message that does not parse keeps its text in ``raw``.
    """
    text = F.col("value").cast("string")
    meta = [F.col("partition").alias("_kafka_partition"), F.col("offset").alias("_kafka_offset"), F.col("timestamp").alias("_kafka_timestamp")]
    if fmt == "json":
        kind = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        full = T.StructType(list(kind.fields) + [T.StructField(CORRUPT, T.StringType())])
        record = F.from_json(text, full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
        bad: Column = F.col("_r").isNull() | F.col(f"_r.{CORRUPT}").isNotNull()
        parsed = df.withColumn("_r", record).withColumn("_text", text)
        return parsed.select(*[F.col(f"_r.`{f.name}`").alias(f.name) for f in kind.fields],
                             F.when(bad, F.col("_text")).alias("raw"), *meta)
    if fmt == "csv":
        parts = F.split(text, ",", -1)
        return df.select(*[F.try_element_at(parts, F.lit(i + 1)).alias(f"field_{i}") for i in range(fields)],
                         F.when(F.size(parts) > fields, text).alias("raw"), *meta)
    return df.select(text.alias("raw"), *meta)

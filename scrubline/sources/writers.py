"""Sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..core import as_list, col, with_exprs


def without_zones(df: DataFrame) -> DataFrame:
    """Zoned timestamps become plain ones."""
    return with_exprs(df, {f.name: col(f.name).cast("timestamp_ntz") for f in df.schema if isinstance(f.dataType, T.TimestampType)})


def write(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists", partition_by=None) -> None:
    """csv (with header), json or parquet, without time zones."""
    if fmt not in ("csv", "json", "parquet"):
        raise ValueError(f"unknown format: {fmt}")
    writer = without_zones(df).write.format(fmt).mode(mode)
    if fmt == "csv":
        writer = writer.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
    if partition_by:
        writer = writer.partitionBy(*as_list(partition_by))
    writer.save(path)


def write_folder(tables: dict[str, DataFrame], folder: str, fmt: str = "parquet", mode: str = "errorifexists") -> None:
    """One output per dataset: ``<folder>/<dataset>``."""
    for name, table in tables.items():
        write(table, f"{folder.rstrip('/')}/{name}", fmt, mode)


def write_collection(df: DataFrame, folder: str, fmt: str = "parquet", mode: str = "errorifexists") -> None:
    """One long table split by its ``dataset`` column in a single job."""
    write(df, folder, fmt, mode, "dataset")


def write_stream(df: DataFrame, path: str, checkpoint: str, fmt: str = "parquet", available_now: bool = True) -> StreamingQuery:
    """File sink with a checkpoint: every finished batch is written exactly once."""
    writer = df.writeStream.format(fmt).option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def checksum(df: DataFrame):
    """Order-free content checksum: sum of row hashes as a decimal."""
    return df.agg(F.sum(F.xxhash64(*[col(c) for c in df.columns]).cast("decimal(38,0)"))).first()[0]

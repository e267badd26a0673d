"""Immutable snapshots: one parquet folder per version, an append-only manifest and a hash tree of key buckets.

A version saved with ``keys`` is dealt into buckets by the hash of its keys, one folder
each.  Its tree holds a checksum of every bucket and, level by level, of every group of
``FAN`` nodes, up to the root.  Two versions with equal keys and buckets are compared
from the root down, and only buckets whose checksums differ are read.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..core import as_list, col
from ..operators.compare import diff_by_key
from .writers import checksum, without_zones, write

MANIFEST = "version int, name string, parent int, rows long, columns array<string>, checksum string, created timestamp, event string, keys array<string>, buckets int, layout string"
#: buckets of a version, and children of a node of its tree
BUCKETS, FAN = 256, 16


def _path(spark: SparkSession, root: str, name: str):
    """(file system, path) of a file under the root."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{name}")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def _manifest(spark: SparkSession, root: str) -> DataFrame:
    files, path = _path(spark, root, "manifest")
    return spark.read.schema(MANIFEST).option("recursiveFileLookup", True).parquet(path.toString()) if files.exists(path) else spark.createDataFrame([], MANIFEST)


def _log(spark: SparkSession, root: str, row: tuple) -> None:
    line = spark.createDataFrame([row], MANIFEST.replace(", created timestamp", "")).withColumn("created", F.current_timestamp())
    names = [part.split()[0] for part in MANIFEST.split(", ")]
    # a folder for each line, as writers that append to one folder at once would clear each other's unfinished files
    line.select(*names).coalesce(1).write.parquet(f"{root.rstrip('/')}/manifest/line{row[0]}")


def _created(spark: SparkSession, files, path) -> bool:
    """Whether this call made the file; on local disks Hadoop looks first and then creates, so that writers at once may both or neither succeed."""
    if files.getUri().getScheme() == "file":
        return spark._jvm.java.io.File(files.makeQualified(path).toUri().getPath()).createNewFile()
    return files.createNewFile(path)


def _claim(spark: SparkSession, root: str) -> int:
    """A number that no other writer has: the first whose claim file this one creates.

    Creating a file that must not exist is atomic on HDFS and local disks.
    """
    number = (_manifest(spark, root).agg(F.max("version")).first()[0] or 0) + 1
    while True:
        files, path = _path(spark, root, f"claims/{number}")
        if not files.exists(path):
            files.mkdirs(path.getParent())
            if _created(spark, files, path):
                return number
        number += 1


def _row_hash(df: DataFrame) -> Column:
    """Hash of a row that tells nulls from missing values, whatever the order of the columns."""
    parts = []
    for field in sorted(df.schema, key=lambda f: f.name):
        kind = field.dataType.simpleString()
        value = F.to_json(F.struct(col(field.name))) if "map<" in kind or "variant" in kind else col(field.name)
        parts += [F.lit(field.name), value, col(field.name).isNull()]
    return F.xxhash64(*parts)


def _write_tree(saved: DataFrame, path: str, buckets: int) -> None:
    """``(level, node, rows, checksum)``; level 0 has a node for each bucket that has rows."""
    content = saved.drop("_bucket")
    leaves = saved.withColumn("_h", _row_hash(content)).groupBy(F.col("_bucket").cast("long").alias("node")).agg(
        F.count("*").alias("rows"), F.sum(F.col("_h").cast("decimal(38,0)")).alias("checksum"))
    levels = max(1, math.ceil(math.log(buckets, FAN)))
    # every level is made from the leaves, of which there is at most one a bucket
    up = leaves.select(F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("level"), "node", "rows", "checksum")
    place = F.floor(F.col("node") / F.pow(F.lit(float(FAN)), F.col("level")))
    salted = F.when(F.col("level") > 0, F.xxhash64("node", "rows", "checksum").cast("decimal(38,0)")).otherwise(F.col("checksum"))
    tree = up.select("level", place.alias("node"), "rows", salted.alias("checksum")).groupBy("level", "node").agg(
        F.sum("rows").alias("rows"), F.sum("checksum").alias("checksum"))
    tree.repartition(1).sortWithinPartitions("level", "node").write.parquet(path)


def save_version(df: DataFrame, root: str, name: str, parent: int | None = None, keys=None, buckets: int = BUCKETS) -> int:
    """Write a snapshot; returns its number.  Any number of writers may save at once.

    With ``keys`` the version gets buckets and a hash tree for ``diff_versions``; rows with
    null keys are dealt like any others.  A bucket of many rows is written by several
    tasks.  A writer that fails leaves its number unused.
    """
    spark, keys = df.sparkSession, as_list(keys)
    number = _claim(spark, root)
    path = f"{root.rstrip('/')}/v{number}"
    if keys:
        plain = without_zones(df)
        dealt = plain.withColumn("_bucket", F.pmod(F.xxhash64(*[col(k) for k in keys]), F.lit(buckets)).cast("int"))
        # ranges keep a bucket's rows together and split a bucket that is too large for one
        dealt.repartitionByRange("_bucket", _row_hash(plain)).write.partitionBy("_bucket").parquet(path)
        layout = dealt.schema.json()
        saved = _bucketed(spark, root, number, layout)
        _write_tree(saved, f"{root.rstrip('/')}/tree{number}", buckets)
        saved = saved.drop("_bucket")
    else:
        write(df, path)
        saved, layout = spark.read.parquet(path), None
    _log(spark, root, (number, name, parent, saved.count(), saved.columns, str(checksum(saved)), "saved", keys or None, buckets if keys else None, layout))
    return number


def read_version(spark: SparkSession, root: str, number: int) -> DataFrame:
    layout = _entry(spark, root, number).layout
    return _bucketed(spark, root, number, layout).drop("_bucket") if layout else spark.read.parquet(f"{root.rstrip('/')}/v{number}")


def _bucketed(spark: SparkSession, root: str, number: int, layout: str) -> DataFrame:
    """Rows and ``_bucket`` of a version with keys; an empty one has no file that could tell its columns."""
    return spark.read.schema(T.StructType.fromJson(json.loads(layout))).parquet(f"{root.rstrip('/')}/v{number}")


def _entry(spark: SparkSession, root: str, number: int):
    found = _manifest(spark, root).where(F.col("version") == number).first()
    if found is None:
        raise ValueError(f"version {number} does not exist")
    return found


def changed_buckets(spark: SparkSession, root: str, before: int, after: int) -> list[int]:
    """Buckets that differ between two versions, found from the roots of their trees down."""
    a, b = _entry(spark, root, before), _entry(spark, root, after)
    if not a.buckets or (a["keys"], a.buckets) != (b["keys"], b.buckets):
        raise ValueError("both versions need the same keys and buckets")
    one, two = (spark.read.parquet(f"{root.rstrip('/')}/tree{n}") for n in (before, after))
    nodes = None
    for level in range(max(1, math.ceil(math.log(a.buckets, FAN))), -1, -1):
        here = F.col("level") == level
        if nodes is not None:
            here = here & F.floor(F.col("node") / FAN).isin(nodes)
        left = one.where(here).select("node", F.struct("rows", "checksum").alias("a"))
        right = two.where(here).select("node", F.struct("rows", "checksum").alias("b"))
        # at most as many nodes as buckets
        nodes = [r.node for r in left.join(right, "node", "full_outer").where(~F.col("a").eqNullSafe(F.col("b"))).select("node").collect()]
        if not nodes:
            return []
    return sorted(nodes)


def diff_versions(spark: SparkSession, root: str, before: int, after: int) -> DataFrame:
    """Cell changes between two versions, as ``diff_by_key`` tells them, reading only buckets that differ.

    The versions' keys are unique and not null in each of them.
    """
    entries = [_entry(spark, root, n) for n in (before, after)]
    buckets = changed_buckets(spark, root, before, after)
    picked = F.col("_bucket").isin(buckets) if buckets else F.lit(False)
    sides = [_bucketed(spark, root, e.version, e.layout).where(picked).drop("_bucket") for e in entries]
    return diff_by_key(*sides, entries[0]["keys"])


def list_versions(spark: SparkSession, root: str) -> DataFrame:
    """Newest first; ``status`` is active for the newest version and archived for the others."""
    log = _manifest(spark, root).drop("keys", "buckets", "layout")
    newest = F.max("version").over(W.partitionBy())
    # the manifest has one short row per version
    return log.withColumn("status", F.when(F.col("version") == newest, "active").otherwise("archived")).orderBy(F.desc("version"))


def rollback(spark: SparkSession, root: str, number: int) -> int:
    """A new version with the content of an old one, whose parent it is."""
    old = _entry(spark, root, number)
    return save_version(read_version(spark, root, number), root, f"rollback to {old['name']}", number, old["keys"], old.buckets or BUCKETS)

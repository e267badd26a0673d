"""Ordered scans that never put one key, or the whole table, into one task.

A plain window with no partition key runs in one task, and one with a hot key
sends that key to one task.  Here the rows are cut into buckets along
(partition columns, order columns), so every bucket holds about the same number
of rows whatever the keys are, and there are as many buckets as the rows need.

``bucketed``   reads the keys once: one aggregate counts the rows and draws the
               boundaries.  A row finds its bucket by binary search.
``running``    two-level prefix sums: windows inside the buckets, whose last
               rows are the buckets' summaries; the summaries of the keys that
               go on in another bucket are scanned in turn (one row per bucket)
               and carried back.  Both levels read one shuffle of the table.
``over_rows``  lag, lead and rolling frames: rows get their exact position in
               the table, positions are cut into chunks, and the few rows at a
               chunk's edge are copied to its neighbour.

A table of one bucket has no boundaries and uses the plain window.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import WindowSpec

from ..core import as_list, col, data_type

ROWS_PER_BUCKET = 1_000_000
#: rows drawn per input partition, and per bucket, to find the boundaries
DRAWN_PER_PARTITION, DRAWN_PER_BUCKET = 128, 20
#: drawn rows that come to the driver in one go, whatever the number of buckets
DRAWN_AT_ONCE = 100_000


def _sortable(df: DataFrame, name: str) -> Column:
    """Order-preserving form of a column whose values survive a round trip as literals."""
    kind = data_type(df, name)
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(col(name))
    if isinstance(kind, (T.TimestampNTZType, T.DateType)):
        return col(name).cast("string")
    return col(name)


@dataclass
class Buckets:
    df: DataFrame            # input plus _bucket
    keys: list[str]
    order: list[str]
    edge_keys: DataFrame | None   # partition keys that cross a boundary; None = no boundaries

    @property
    def split(self) -> bool:
        return self.edge_keys is not None or self.many

    many: bool = False


def bucketed(df: DataFrame, partition_by, order_by, rows_per_bucket: int | None = None) -> Buckets:
    keys, order = as_list(partition_by), as_list(order_by)
    if not order:
        raise ValueError("an ordered operator needs order_by: Spark tables have no row order")
    per_bucket = rows_per_bucket or ROWS_PER_BUCKET
    names = keys + order
    slim = df.select(*[_sortable(df, n).alias(f"k{i}") for i, n in enumerate(names)])
    rows, drawn = _drawn(slim, per_bucket)
    wanted = math.ceil(rows / per_bucket)
    # boundaries at even steps of the rows that the drawn ones stand for
    edges, passed, step = [], 0, 1
    total = sum(r["rows"] for r in drawn)
    for row in drawn if wanted > 1 else ():
        if passed >= total * step / wanted:
            step = int(passed * wanted / total) + 1
            if not edges or row["k"] != edges[-1]:
                edges.append(row["k"])
        passed += row["rows"]
    if not edges:
        return Buckets(df, keys, order, None)
    key = F.struct(*[_sortable(df, n).alias(f"k{i}") for i, n in enumerate(names)])
    kind = T.StructType([T.StructField("k", T.ArrayType(T.StructType(slim.schema.fields)))])
    bounds = df.sparkSession.createDataFrame([(edges,)], kind)
    cut = df.withColumn("_bounds", bounds.scalar()).withColumn("_bucket", _place(key, F.col("_bounds"), len(edges))).drop("_bounds")
    edge_keys = None
    if keys:
        rows = {tuple(e)[: len(keys)] for e in edges}
        kind = T.StructType([T.StructField(f"e{i}", slim.schema[i].dataType) for i in range(len(keys))])
        edge_keys = df.sparkSession.createDataFrame(list(rows), kind)
    return Buckets(cut, keys, order, edge_keys, many=True)


def _drawn(slim: DataFrame, per_bucket: int) -> tuple[int, list]:
    """The number of rows, and rows drawn evenly from every input partition, in order, each with the number of rows it stands for.

    One pass without a shuffle of rows: each partition deals its rows into slots
    and keeps one row, at random, and the count of each.  What reaches the driver
    is at most ``DRAWN_PER_BUCKET`` rows for each bucket, or ``DRAWN_AT_ONCE``.
    """
    slots = slim.select(F.struct(*slim.columns).alias("k"), F.spark_partition_id().alias("p"), F.floor(F.rand(7) * DRAWN_PER_PARTITION).alias("s"), F.rand(11).alias("u"))
    slots = slots.groupBy("p", "s").agg(F.count("*").alias("rows"), F.max_by("k", "u").alias("k"))
    # many input partitions give more than comes in one go; what was drawn is then kept for the second look
    many = len(slim.inputFiles()) * DRAWN_PER_PARTITION > DRAWN_AT_ONCE
    slots = slots.persist() if many else slots
    try:
        few = slots.limit(DRAWN_AT_ONCE + 1).collect()
        if len(few) <= DRAWN_AT_ONCE:
            return sum(r["rows"] for r in few), sorted(few, key=_null_first)
        found = slots.agg(F.sum("rows").alias("rows"), F.count("*").alias("drawn")).first()
        most = DRAWN_PER_BUCKET * math.ceil(found["rows"] / per_bucket)
        some = slots.where(F.rand(13) < most / found["drawn"]) if found["drawn"] > most else slots
        return found["rows"], some.select("rows", "k").orderBy("k").collect()
    finally:
        if many:
            slots.unpersist()


def _null_first(row) -> list:
    """Spark's order of structs: nulls first, NaN last."""
    return [(0, 0) if v is None else (2, 0) if isinstance(v, float) and math.isnan(v) else (1, v) for v in row["k"]]


def _place(key: Column, bounds: Column, count: int) -> Column:
    """How many of the sorted bounds are not above the key, by binary search."""

    def halve(state, _):
        lo, hi = state["lo"], state["hi"]
        mid = F.floor((lo + hi) / 2).cast("int")
        up = (lo < hi) & (F.get(bounds, mid) <= key)
        return F.struct(F.when(up, mid + 1).otherwise(lo).alias("lo"), F.when(up, hi).otherwise(F.least(mid, hi)).alias("hi"))

    start = F.struct(F.lit(0).alias("lo"), F.lit(count).alias("hi"))
    steps = F.sequence(F.lit(1), F.lit(count.bit_length()))
    return F.aggregate(steps, start, halve, lambda s: s["lo"])


def _window(keys: list[str], order: list[str], reverse: bool, extra: list[str]) -> WindowSpec:
    by = [F.desc_nulls_last(col(o)) if reverse else F.asc_nulls_first(col(o)) for o in order]
    parts = [col(k) for k in keys + extra]
    return (W.partitionBy(*parts) if parts else W.partitionBy()).orderBy(*by)


def _hashable(df: DataFrame) -> list[str]:
    """Columns that a hash can read (all but maps and variants)."""
    return [f.name for f in df.schema if not any(w in f.dataType.simpleString() for w in ("map<", "variant"))]


def _aggregate(kind: str, value: Column) -> Column:
    return {
        "sum": F.sum, "count": F.count, "min": F.min, "max": F.max,
    }[kind](value)


def running(df: DataFrame, partition_by, order_by, specs: dict[str, tuple[str, Column]],
            reverse: bool = False, rows_per_bucket: int | None = None,
            buckets: Buckets | None = None) -> DataFrame:
    """Add running aggregates from the first row up to each row.

    ``specs`` maps a new column to (kind, expression); kind is sum, count, min,
    max or last (last non-null value).  ``reverse`` scans from the end.
    """
    b = buckets or bucketed(df, partition_by, order_by, rows_per_bucket)
    frame = _window(b.keys, b.order, reverse, ["_bucket"] if b.many else []).rowsBetween(
        W.unboundedPreceding, 0
    )
    local = {
        name: (F.last(value, ignorenulls=True) if kind == "last" else _aggregate(kind, value)).over(frame)
        for name, (kind, value) in specs.items()
    }
    if not b.many:
        return b.df.withColumns(local)

    # the last row of a (bucket, key) holds the totals; they matter for the keys that go on in another bucket
    inside = b.df.withColumns({"_l_" + n: e for n, e in local.items()} | {"_end": F.lead(F.lit(True)).over(_window(b.keys, b.order, reverse, ["_bucket"])).isNull()})
    # the condition on the hash always holds; with it both levels need all columns, and so read one shuffle
    ends = inside.where(F.col("_end") & (F.xxhash64(*[F.col(f"`{c}`") for c in _hashable(b.df)]) + 1 != F.xxhash64(*[F.col(f"`{c}`") for c in _hashable(b.df)])))
    if b.edge_keys is not None:
        same = [_sortable(b.df, k).eqNullSafe(F.col(f"e{i}")) for i, k in enumerate(b.keys)]
        ends = ends.join(F.broadcast(b.edge_keys), same, "left_semi")
    per_bucket = ends.groupBy("_bucket", *[col(k) for k in b.keys]).agg(*[F.any_value("_l_" + n).alias("_l_" + n) for n in specs])
    before = _window(b.keys, ["_bucket"], reverse, []).rowsBetween(W.unboundedPreceding, -1)
    carry = per_bucket.select(
        F.col("_bucket").alias("_cb"),
        *[col(k).alias(f"_ck{i}") for i, k in enumerate(b.keys)],
        *[
            (F.last("_l_" + n, ignorenulls=True) if kind == "last"
             else F.sum("_l_" + n) if kind in ("sum", "count")
             else _aggregate(kind, F.col("_l_" + n))).over(before).alias("_c_" + n)
            for n, (kind, _v) in specs.items()
        ],
    )
    on = [F.col("_bucket") == F.col("_cb")] + [
        col(k).eqNullSafe(F.col(f"_ck{i}")) for i, k in enumerate(b.keys)
    ]
    joined = inside.join(F.broadcast(carry), on, "left")

    def merged(name: str, kind: str) -> Column:
        here, there = F.col("_l_" + name), F.col("_c_" + name)
        if kind == "last":
            return F.coalesce(here, there)
        if kind == "min":
            return F.least(here, there)
        if kind == "max":
            return F.greatest(here, there)
        both = F.coalesce(here, F.lit(0)) + F.coalesce(there, F.lit(0))
        return F.when(here.isNotNull() | there.isNotNull(), both)

    result = joined.withColumns({n: merged(n, kind) for n, (kind, _v) in specs.items()})
    return result.select(*[col(c) for c in b.df.columns if c not in ("_bucket", *specs)],
                         *[col(n) for n in specs])


def over_rows(df: DataFrame, partition_by, order_by, before: int, after: int,
              build: Callable[[WindowSpec], dict[str, Column]],
              rows_per_bucket: int | None = None) -> DataFrame:
    """Add window columns that look at most ``before`` rows back and ``after`` ahead."""
    b = bucketed(df, partition_by, order_by, rows_per_bucket)
    if not b.many:
        return df.withColumns(build(_window(b.keys, b.order, False, [])))
    size = max(rows_per_bucket or ROWS_PER_BUCKET, 10 * max(before, after, 1))
    numbered = running(df, None, None, {"_row": ("count", F.lit(1))}, buckets=b)
    place = F.col("_row") - 1
    chunk = F.floor(place / size)
    inside = place % size
    targets = F.array(chunk)
    if before:
        targets = F.concat(targets, F.when(inside >= size - before, F.array(chunk + 1)).otherwise(F.array().cast("array<bigint>")))
    if after:
        targets = F.concat(targets, F.when((inside < after) & (chunk > 0), F.array(chunk - 1)).otherwise(F.array().cast("array<bigint>")))
    copied = numbered.withColumn("_home", chunk).withColumn("_chunk", F.explode(targets))
    made = build(_window(b.keys, ["_row"], False, ["_chunk"]))
    return copied.withColumns(made).where("_chunk = _home").drop("_row", "_home", "_chunk")

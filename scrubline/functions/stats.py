"""Statistics that operators need before they can build their expressions.

Everything comes back as ONE small row.  An exact ``percentile`` over a whole
column would build one map of all its distinct values in one task, so exact
quantiles are found in two passes instead:

1. a bounded sketch (``percentile_approx``) gives two values around each rank,
2. one aggregate counts the rows below and at the two values and collects the
   few rows strictly between them, whose number the sketch error bounds.

When the bound is still large the sketch is repeated between the two values.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SKETCH = 10_000         # accuracy: rank error at most n / SKETCH
COLLECT_ROWS = 50_000   # rows between the two values that may come back


@dataclass
class _Target:
    column: int
    prob: int
    rank: float      # position in the sorted values, 0-based
    low: float
    high: float
    between: float   # bound on the rows strictly between low and high


def quantiles(df: DataFrame, columns: dict[str, Column], probs: list[float],
              collect_rows: int = COLLECT_ROWS, sketch: int = SKETCH) -> dict[str, list]:
    """Exact linear-interpolation quantiles of several expressions.

    Returns name -> list of values in the order of ``probs`` (None when empty).
    """
    names = list(columns)
    numbers = [columns[n].cast("double") for n in names]
    data = df.select(*[F.when(~F.isnan(v), v).alias(f"v{i}") for i, v in enumerate(numbers)])
    slack = 2.0 / sketch
    spread = 6.0 / sketch
    fractions = [f for p in probs for f in (max(p - slack, 0.0), min(p + slack, 1.0))]
    first = data.agg(
        *[F.count(f"v{i}").alias(f"n{i}") for i in range(len(names))],
        *[F.percentile_approx(f"v{i}", fractions, sketch).alias(f"e{i}") for i in range(len(names))],
        *[F.min(f"v{i}").alias(f"min{i}") for i in range(len(names))],
        *[F.max(f"v{i}").alias(f"max{i}") for i in range(len(names))],
    ).first()
    result = {n: [None] * len(probs) for n in names}
    targets = []
    for i in range(len(names)):
        rows = first[f"n{i}"]
        for j, p in enumerate(probs if rows else []):
            if rows <= collect_rows:
                # too few rows for the sketch's slack to span a whole rank
                low, high, between = first[f"min{i}"], first[f"max{i}"], rows
            else:
                low, high = first[f"e{i}"][2 * j: 2 * j + 2]
                between = rows * spread
            targets.append(_Target(i, j, p * (rows - 1), low, high, between))
    wide = [t for t in targets if t.between > collect_rows]
    while wide:
        _narrow(data, wide, slack, spread)
        wide = [t for t in wide if t.between > collect_rows]
    exprs = []
    for k, t in enumerate(targets):
        v = F.col(f"v{t.column}")
        exprs += [
            F.count_if(v < t.low).alias(f"below{k}"), F.count_if(v == t.low).alias(f"low{k}"),
            F.count_if(v == t.high).alias(f"high{k}"),
            F.sort_array(F.collect_list(F.when((v > t.low) & (v < t.high), v))).alias(f"mid{k}"),
        ]
    found = data.agg(*exprs).first() if exprs else None
    for k, t in enumerate(targets):
        below, at_low, middle, at_high = found[f"below{k}"], found[f"low{k}"], found[f"mid{k}"], found[f"high{k}"]

        def value(rank: int) -> float:
            place = rank - below
            if place < 0 or place >= at_low + len(middle) + at_high:
                raise ArithmeticError("quantile sketch missed its rank")
            if place < at_low:
                return t.low
            return middle[place - at_low] if place < at_low + len(middle) else t.high

        lower, upper = value(math.floor(t.rank)), value(math.ceil(t.rank))
        # equal neighbours, infinite ones too, have nothing between them
        result[names[t.column]][t.prob] = lower if lower == upper else lower + (upper - lower) * (t.rank - math.floor(t.rank))
    return result


def _narrow(data: DataFrame, targets: list[_Target], slack: float, spread: float) -> None:
    """Move low and high of every target closer to its rank by a sketch of the rows between them."""
    exprs = []
    for k, t in enumerate(targets):
        v = F.col(f"v{t.column}")
        exprs += [F.count_if(v <= t.low).alias(f"b{k}"), F.count_if((v > t.low) & (v < t.high)).alias(f"m{k}")]
    counts = data.agg(*exprs).first()
    inner, exprs = {}, []
    for k, t in enumerate(targets):
        rows = counts[f"m{k}"]
        start, end = math.floor(t.rank) - counts[f"b{k}"], math.ceil(t.rank) - counts[f"b{k}"]
        if rows and end >= 0 and start < rows:
            inner[k] = (start, end, rows)
            shares = [max(start / max(rows - 1, 1) - slack, 0.0), min(max(end / max(rows - 1, 1) + slack, 0.0), 1.0)]
            v = F.col(f"v{t.column}")
            accuracy = int(round(2.0 / slack))
            exprs.append(F.percentile_approx(F.when((v > t.low) & (v < t.high), v), shares, accuracy).alias(f"e{k}"))
    edges = data.agg(*exprs).first() if exprs else None
    for k, t in enumerate(targets):
        if k not in inner:
            # the rank sits on low or on high itself
            if math.ceil(t.rank) < counts[f"b{k}"]:
                t.high = t.low
            else:
                t.low = t.high
            t.between = 0
            continue
        start, end, rows = inner[k]
        if start >= 0:
            t.low = edges[f"e{k}"][0]
        if end < rows:
            t.high = edges[f"e{k}"][1]
        t.between = rows * spread if start >= 0 and end < rows else rows * (slack * 2)


def moments(df: DataFrame, columns: dict[str, Column]) -> dict[str, dict]:
    """count, mean, sample and population deviation, min, max of each expression."""
    exprs = []
    for i, expr in enumerate(columns.values()):
        v = expr.cast("double")
        exprs += [
            F.count(v).alias(f"n{i}"), F.avg(v).alias(f"mean{i}"),
            F.stddev_samp(v).alias(f"std{i}"), F.stddev_pop(v).alias(f"pstd{i}"),
            F.min(v).alias(f"min{i}"), F.max(v).alias(f"max{i}"),
        ]
    row = df.agg(*exprs).first()
    keys = ["n", "mean", "std", "pstd", "min", "max"]
    return {name: {k: row[f"{k}{i}"] for k in keys} for i, name in enumerate(columns)}


def modes(df: DataFrame, names: list[str]) -> dict[str, object]:
    """Most frequent non-null value per column, the smallest one on a tie.

    Counting by value is a shuffled aggregate (a hot value is pre-summed on the
    map side); ``mode()`` would keep every distinct value in one task.
    """
    from ..core import col

    found = {}
    for name in names:
        row = (
            df.groupBy(col(name).alias("v")).count().where("v is not null")
            .orderBy(F.desc("count"), F.asc("v")).limit(1).collect()
        )
        found[name] = row[0]["v"] if row else None
    return found


def grouped_quantile(df: DataFrame, keys: list[str], value: Column, prob: float) -> DataFrame:
    """Exact quantile per group: ``keys + q``.

    One sketch per group brackets the rank, then an exact percentile looks only
    inside the bracket, so a group that holds most rows never sits in one map.
    """
    from ..core import col

    data = df.select(*[col(k) for k in keys], value.cast("double").alias("_v")).where("_v is not null")
    slack = 2.0 / SKETCH
    sketch = data.groupBy(*[col(k) for k in keys]).agg(
        F.count("_v").alias("_n"),
        F.percentile_approx("_v", [max(prob - slack, 0.0), min(prob + slack, 1.0)], SKETCH).alias("_e"),
    )
    bound = data.alias("d").join(
        sketch.alias("s"), [F.col(f"d.`{k}`").eqNullSafe(F.col(f"s.`{k}`")) for k in keys]
    )
    inside = F.when(F.col("_v").between(F.col("_e")[0], F.col("_e")[1]), F.col("_v"))
    # the position inside the bracket differs per group, so keep value counts
    # of the bracket and read the two neighbours of the rank from them
    counted = (
        bound.where(F.col("_v") <= F.col("_e")[1])
        .groupBy(*[F.col(f"d.`{k}`").alias(k) for k in keys], inside.alias("_v"), F.col("_n"))
        .agg(F.count("*").alias("_c"))
    )
    order = W.partitionBy(*[col(k) for k in keys]).orderBy(F.col("_v").asc_nulls_first())
    ranked = counted.withColumn(
        "_hi", F.sum("_c").over(order.rowsBetween(W.unboundedPreceding, 0)) - 1
    ).withColumn("_lo", F.col("_hi") - F.col("_c") + 1)
    pos = (F.col("_n") - 1) * F.lit(prob)
    low = F.max(F.when((F.floor(pos) >= F.col("_lo")) & (F.floor(pos) <= F.col("_hi")), F.col("_v")))
    high = F.max(F.when((F.ceil(pos) >= F.col("_lo")) & (F.ceil(pos) <= F.col("_hi")), F.col("_v")))
    frac = F.max(pos - F.floor(pos))
    return ranked.groupBy(*[col(k) for k in keys]).agg((low + (high - low) * frac).alias("q"))

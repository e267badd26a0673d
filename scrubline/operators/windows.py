"""Window functions: ranks, lags, rolling and cumulative statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core import action, as_list, col
from .ordered import over_rows, running


def _value_ranks(df: DataFrame, column: str, keys: list[str], descending: bool,
                 rows_per_bucket: int | None) -> DataFrame:
    """One row per (keys, value): rows ranked before it, its own rows, its dense rank.

    Ranks come from value counts, so ties never travel and no window sees all rows.
    """
    counts = (
        df.where(col(column).isNotNull())
        .groupBy(*[col(k).alias(f"_g{i}") for i, k in enumerate(keys)], col(column).alias("_v"))
        .agg(F.count("*").alias("_ties"))
    )
    return running(
        counts, [f"_g{i}" for i in range(len(keys))], ["_v"],
        {"_upto": ("sum", F.col("_ties")), "_dense": ("count", F.lit(1))},
        reverse=descending, rows_per_bucket=rows_per_bucket,
    )


def _join_ranks(df: DataFrame, column: str, keys: list[str], ranks: DataFrame) -> DataFrame:
    on = [col(column) == F.col("_v")] + [
        col(k).eqNullSafe(F.col(f"_g{i}")) for i, k in enumerate(keys)
    ]
    return df.join(ranks, on, "left")


@action("add_rank")
def add_rank(df: DataFrame, column: str, method: str = "average", new_col: str | None = None,
             partition_by=None, order_by=None, rows_per_bucket: int | None = None) -> DataFrame:
    """Descending rank: average, min, max, dense, or first (ties by ``order_by``)."""
    new_col = new_col or f"{column}_rank"
    keys = as_list(partition_by)
    if column not in df.columns:
        return df
    if method == "first":
        # rows of higher values, then the place among the rows of the same value
        placed = running(df, [*keys, column], order_by, {"_place": ("count", F.lit(1))}, rows_per_bucket=rows_per_bucket)
        ranks = _value_ranks(df, column, keys, True, rows_per_bucket)
        return _join_ranks(placed, column, keys, ranks).select(
            *[col(c) for c in df.columns], F.when(col(column).isNotNull(), F.col("_upto") - F.col("_ties") + F.col("_place")).alias(new_col))
    ranks = _value_ranks(df, column, keys, True, rows_per_bucket)
    upto, ties = F.col("_upto"), F.col("_ties")
    rank = {
        "min": upto - ties + 1,
        "max": upto,
        "dense": F.col("_dense"),
        "average": upto - (ties - 1) / 2,
    }[method]
    ranks = ranks.withColumn("_rank", rank)
    return _join_ranks(df, column, keys, ranks).select(*[col(c) for c in df.columns],
                                                       F.col("_rank").alias(new_col))


@action("add_percentile")
def add_percentile(df: DataFrame, column: str, new_col: str | None = None,
                   rows_per_bucket: int | None = None) -> DataFrame:
    """Average ascending rank as a percentage of the non-null rows."""
    if column not in df.columns:
        return df
    total = df.agg(F.count(col(column))).first()[0]
    ranks = _value_ranks(df, column, [], False, rows_per_bucket)
    share = (F.col("_upto") - (F.col("_ties") - 1) / 2) / F.lit(max(total, 1)) * 100
    ranks = ranks.withColumn("_share", share)
    return _join_ranks(df, column, [], ranks).select(
        *[col(c) for c in df.columns], F.col("_share").alias(new_col or f"{column}_percentile")
    )


@action("lag_column")
def lag_column(df: DataFrame, column: str, periods: int = 1, new_col: str | None = None,
               partition_by=None, order_by=None, rows_per_bucket: int | None = None) -> DataFrame:
    new_col = new_col or f"{column}_lag_{periods}"
    return over_rows(df, partition_by, order_by, periods, 0,
                     lambda w: {new_col: F.lag(col(column), periods).over(w)}, rows_per_bucket)


@action("lead_column")
def lead_column(df: DataFrame, column: str, periods: int = 1, new_col: str | None = None,
                partition_by=None, order_by=None, rows_per_bucket: int | None = None) -> DataFrame:
    new_col = new_col or f"{column}_lead_{periods}"
    return over_rows(df, partition_by, order_by, 0, periods,
                     lambda w: {new_col: F.lead(col(column), periods).over(w)}, rows_per_bucket)


@action("lag_columns")
def lag_columns(df: DataFrame, column: str, periods: int = 1, suffix: str = "_lag",
                partition_by=None, order_by=None, rows_per_bucket: int | None = None) -> DataFrame:
    """All lags 1..periods as ``<column><suffix><k>``."""
    return over_rows(
        df, partition_by, order_by, periods, 0,
        lambda w: {f"{column}{suffix}{k}": F.lag(col(column), k).over(w)
                   for k in range(1, periods + 1)},
        rows_per_bucket,
    )


@action("percentage_change")
def percentage_change(df: DataFrame, column: str, periods: int = 1, new_col: str | None = None,
                      partition_by=None, order_by=None,
                      rows_per_bucket: int | None = None) -> DataFrame:
    new_col = new_col or f"{column}_pct_change"
    value = col(column).cast("double")
    return over_rows(
        df, partition_by, order_by, periods, 0,
        lambda w: {new_col: (F.try_divide(value, F.lag(value, periods).over(w)) - 1) * 100},
        rows_per_bucket,
    )


_STATS = {
    "mean": F.avg, "avg": F.avg, "std": F.stddev_samp, "var": F.var_samp, "min": F.min,
    "max": F.max, "sum": F.sum, "median": F.median, "count": F.count,
}


@action("rolling_stats")
def rolling_stats(df: DataFrame, column: str, window: int = 7, operations=("mean",),
                  partition_by=None, order_by=None,
                  rows_per_bucket: int | None = None) -> DataFrame:
    """Statistics of the last ``window`` rows; null until the window is full."""
    value = col(column)

    def build(w):
        frame = w.rowsBetween(-(window - 1), 0)
        full = F.count(value).over(frame) == window
        return {
            f"{column}_rolling_{op}_{window}": F.when(full, _STATS[op](value).over(frame))
            for op in as_list(operations)
        }

    return over_rows(df, partition_by, order_by, window - 1, 0, build, rows_per_bucket)


@action("cumulative_sum")
def cumulative_sum(df: DataFrame, column: str, new_col: str | None = None, partition_by=None,
                   order_by=None, rows_per_bucket: int | None = None) -> DataFrame:
    """Running sum; a null row stays null and does not break the sum."""
    new_col = new_col or f"{column}_cumsum"
    summed = running(df, partition_by, order_by, {new_col: ("sum", col(column))},
                     rows_per_bucket=rows_per_bucket)
    return summed.withColumn(new_col, F.when(col(column).isNotNull(), col(new_col)))


@action("cumulative_stats")
def cumulative_stats(df: DataFrame, column: str, operations=("sum", "max", "min"),
                     window: int | None = None, partition_by=None, order_by=None,
                     rows_per_bucket: int | None = None) -> DataFrame:
    """Expanding (or, with ``window``, rolling) statistics as ``<column>_cum_<op>``."""
    ops = as_list(operations)
    if window:
        rolled = rolling_stats(df, column, window, ops, partition_by, order_by, rows_per_bucket)
        return rolled.withColumnsRenamed(
            {f"{column}_rolling_{op}_{window}": f"{column}_cum_{op}" for op in ops}
        )
    value = col(column).cast("double")
    if {"std", "var"} & set(ops):
        # sums of squares are taken about the key's first value, which every prefix holds: no cancellation
        keys, order = as_list(partition_by), F.struct(*[col(o) for o in as_list(order_by)])
        firsts = df.where(value.isNotNull()).groupBy(*[col(k).alias(f"_f{i}") for i, k in enumerate(keys)]).agg(F.min_by(value, order).alias("_first"))
        same = [col(k).eqNullSafe(F.col(f"_f{i}")) for i, k in enumerate(keys)]
        df = df.join(firsts, same, "left").drop(*[f"_f{i}" for i in range(len(keys))]) if keys else df.withColumn("_first", F.lit((firsts.first() or [None])[0]).cast("double"))
        shifted = value - F.col("_first")
    specs: dict[str, tuple[str, Column]] = {}
    for op in ops:
        if op in ("sum", "max", "min", "count"):
            specs[f"{column}_cum_{op}"] = (op, col(column))
        elif op in ("mean", "std", "var"):
            specs["_n"] = ("count", value)
            specs["_s"] = ("sum", value)
            if op != "mean":
                specs["_d"] = ("sum", shifted)
                specs["_q"] = ("sum", shifted * shifted)
        else:
            raise ValueError(f"unknown cumulative operation: {op}")
    out = running(df, partition_by, order_by, specs, rows_per_bucket=rows_per_bucket)
    n, s = F.col("_n"), F.col("_s")
    variance = F.when(n > 1, F.greatest((F.col("_q") - F.col("_d") * F.col("_d") / n) / (n - 1), F.lit(0.0))) if "_q" in specs else None
    derived = {"mean": s / n, "var": variance, "std": F.sqrt(variance) if variance is not None else None}
    out = out.withColumns({f"{column}_cum_{op}": derived[op] for op in ops if op in derived})
    return out.drop("_n", "_s", "_q", "_d", "_first")


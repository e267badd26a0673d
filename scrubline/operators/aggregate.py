"""Grouping, pivots, charts data, SQL, and summaries of event and change logs."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..core import action, as_list, batches, col, numeric_columns
from ..functions.dates import as_timestamp
from ..functions.stats import grouped_quantile, moments

_AGGS = {
    "sum": F.sum, "mean": F.avg, "avg": F.avg, "min": F.min, "max": F.max, "count": F.count,
    "std": F.stddev_samp,
}


def _pairs(aggregations) -> list[tuple[str, str]]:
    if isinstance(aggregations, str):
        parts = [p.split(":") for p in re.split(r"[,\n]", aggregations) if ":" in p]
        return [(c.strip(), a.strip()) for c, a in parts]
    return list(aggregations.items()) if isinstance(aggregations, dict) else list(aggregations)


@action("group_by")
def group_by(df: DataFrame, group_columns, aggregations) -> DataFrame:
    """``"sales:sum, price:max"`` -> columns ``sales_sum``, ``price_max``.

    A median comes from a per-group sketch and its bracket, not from collecting
    the group, so one hot group is no problem.
    """
    keys, pairs = as_list(group_columns), _pairs(aggregations)
    unknown = [a for _, a in pairs if a != "median" and a not in _AGGS]
    if unknown:
        raise ValueError(f"unknown aggregations: {unknown}")
    plain = [_AGGS[a](col(c)).alias(f"{c}_{a}") for c, a in pairs if a != "median"]
    out = df.groupBy(*[col(k) for k in keys]).agg(*(plain or [F.count("*").alias("_rows")]))
    for c, a in pairs:
        if a == "median":
            q = grouped_quantile(df, keys, col(c), 0.5).select(
                *[col(k).alias(f"_g{i}") for i, k in enumerate(keys)], F.col("q").alias(f"{c}_median"))
            on = [col(k).eqNullSafe(F.col(f"_g{i}")) for i, k in enumerate(keys)]
            out = out.join(q, on, "left").drop(*[f"_g{i}" for i in range(len(keys))])
    return out.select(*[col(k) for k in keys], *[col(f"{c}_{a}") for c, a in pairs])


@action("pivot_table", "pivot")
def pivot_table(df: DataFrame, index, columns: str, values, aggfunc: str = "sum",
                categories=None, max_categories: int = 1000) -> DataFrame:
    """Columns ``<value>_<category>``, empty cells 0."""
    index, values = as_list(index), as_list(values)
    if categories is None:
        rows = df.select(col(columns).cast("string").alias("v")).where("v is not null").distinct() \
            .limit(max_categories + 1).collect()
        if len(rows) > max_categories:
            raise ValueError(f"{columns!r} has more than {max_categories} categories")
        categories = sorted(r.v for r in rows)
    categories = [str(c) for c in categories]
    fold = _AGGS[aggfunc]
    key = col(columns).cast("string")
    # conditional aggregates: one shuffle with map-side combining, however many categories
    cells = [
        F.coalesce(fold(F.when(key == c, col(v))), F.lit(0)).alias(f"{v}_{c}")
        for v in values for c in categories
    ]
    return df.groupBy(*[col(i) for i in index]).agg(*cells)


@action("unpivot", "melt", row_wise=True)
def unpivot(df: DataFrame, id_columns, value_columns=None, var_name: str = "variable",
            val_name: str = "value") -> DataFrame:
    """Long form without null values."""
    ids = as_list(id_columns)
    wanted = as_list(value_columns) or [c for c in df.columns if c not in ids]
    return df.unpivot([col(c) for c in ids], [col(c) for c in wanted], var_name, val_name).where(
        col(val_name).isNotNull())


@action("stack_columns", row_wise=True)
def stack_columns(df: DataFrame, columns) -> DataFrame:
    """Long form of the listed columns, nulls kept."""
    names = as_list(columns)
    ids = [c for c in df.columns if c not in names]
    return df.unpivot([col(c) for c in ids], [col(c) for c in names], "variable", "value") if names else df


def value_distribution(df: DataFrame, column: str, k: int = 10) -> DataFrame:
    counts = df.where(col(column).isNotNull()).groupBy(col(column).cast("string").alias("value"))
    return counts.agg(F.count("*").alias("count")).orderBy(F.desc("count"), "value").limit(k)


def histogram(df: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """Equal-width counts, last bin closed, empty bins 0; ``height`` = share of the tallest bin."""
    m = moments(df, {"v": col(column)})["v"]
    spark = df.sparkSession
    low, high = m["min"], m["max"]
    if m["n"] and low == high:
        low, high = low - 0.5, high + 0.5
    value = col(column).cast("double")
    number = F.when(value == high, F.lit(bins)).otherwise(
        F.width_bucket(value, F.lit(low), F.lit(high), F.lit(bins)))
    counts = df.where(value.isNotNull()).groupBy(number.cast("int").alias("bin")).agg(F.count("*").alias("n"))
    grid = spark.range(1, bins + 1).select(F.col("id").cast("int").alias("bin"))
    width = (high - low) / bins if m["n"] else 0.0
    full = grid.join(F.broadcast(counts), "bin", "left").select(
        "bin",
        (F.lit(low) + (F.col("bin") - 1) * width).alias("lower"),
        (F.lit(low) + F.col("bin") * width).alias("upper"),
        F.coalesce("n", F.lit(0)).cast("long").alias("count"),
    )
    return full.withColumn("height", F.try_divide(F.col("count"), F.max("count").over(W.partitionBy())))


def timeseries_rollup(df: DataFrame, date_col: str, value_cols=None, grain: str | None = None) -> DataFrame:
    """Mean per day, week or month; the grain follows from the range when not given."""
    stamp = as_timestamp(df, date_col, False)
    if grain is None:
        days = df.agg(F.date_diff(F.max(stamp), F.min(stamp))).first()[0] or 0
        grain = "day" if days <= 60 else "week" if days <= 365 else "month"
    values = as_list(value_cols) or [c for c in numeric_columns(df) if c != date_col]
    period = F.date_trunc(grain, stamp).cast("timestamp_ntz").alias("period")
    return df.where(stamp.isNotNull()).groupBy(period).agg(*[F.avg(col(v)).alias(v) for v in values])


def missing_by_column(df: DataFrame) -> DataFrame:
    """Null count and share of every column from one aggregate per 40 columns."""
    parts = []
    for names in batches(df.columns, 40):
        row = df.agg(F.count("*").alias("rows"), *[F.count(col(c)).alias(f"c{i}") for i, c in enumerate(names)])
        items = F.array(*[
            F.struct(F.lit(c).alias("column"), (F.col("rows") - F.col(f"c{i}")).alias("missing"), F.col("rows"))
            for i, c in enumerate(names)
        ])
        parts.append(row.select(F.inline(items)))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out.select("column", "missing", (F.try_divide("missing", "rows") * 100).alias("missing_pct"))


@action("sql_apply")
def sql_query(df: DataFrame | None = None, query: str = "", tables: dict[str, DataFrame] | None = None,
              max_rows: int | None = None) -> DataFrame:
    """Read-only SELECT, WITH or EXPLAIN over view ``df`` and any named tables; all rows unless ``max_rows`` is given."""
    text = query.strip().rstrip(";").strip()
    bare = re.sub(r"'(?:[^']|'')*'|`[^`]*`|\"[^\"]*\"", " ", text)
    if ";" in bare or not re.match(r"(?is)(select|with|explain)\b", bare):
        raise ValueError("only a single SELECT, WITH or EXPLAIN statement is allowed")
    if re.match(r"(?is)with\b", bare) and re.search(r"(?is)\)\s*(insert|update|delete|merge)\b", bare):
        raise ValueError("only read-only statements are allowed")
    views = dict(tables or {})
    if df is not None:
        views["df"] = df
    spark = next(iter(views.values())).sparkSession
    for name, table in views.items():
        table.createOrReplaceTempView(name)
    result = spark.sql(text)
    if max_rows is not None and not re.match(r"(?is)explain\b", bare):
        result = result.limit(max_rows)
    return result


def event_query(events: DataFrame, filters: dict | None = None, time_col: str = "ts", start=None, end=None,
                limit: int | None = None, offset: int = 0, tie_break: str | None = None) -> DataFrame:
    """Events by equality filters and time range, newest first."""
    out = events
    for name, wanted in (filters or {}).items():
        out = out.where(col(name).isin(as_list(wanted)) if isinstance(wanted, (list, tuple)) else col(name) == wanted)
    stamp = col(time_col)
    if start is not None:
        out = out.where(stamp >= F.lit(start).cast(events.schema[time_col].dataType))
    if end is not None:
        out = out.where(stamp <= F.lit(end).cast(events.schema[time_col].dataType))
    order = [F.desc(time_col)] + ([F.desc(tie_break)] if tie_break else [])
    out = out.orderBy(*order)
    if offset:
        out = out.offset(offset)
    return out.limit(limit) if limit is not None else out


def activity_summary(events: DataFrame, dimensions: dict[str, str], time_col: str = "ts", days: int | None = None,
                     as_of: str | None = None, top: dict[str, int] | None = None) -> DataFrame:
    """Counts per value of every dimension and per day: ``(dimension, value, n)``.

    Grouping sets count all dimensions in one pass; ``top`` keeps the k most
    frequent values of a dimension.
    """
    stamp = col(time_col).cast("timestamp_ntz")
    data = events
    if days is not None:
        until = F.lit(as_of).cast("timestamp_ntz") if as_of else F.current_timestamp().cast("timestamp_ntz")
        data = data.where((stamp >= until - F.make_interval(days=F.lit(days))) & (stamp <= until))
    named = {name: col(source).cast("string") for name, source in dimensions.items()}
    named["day"] = F.date_format(stamp, "yyyy-MM-dd")
    slim = data.select(*[F.coalesce(e, F.lit("")).alias(n) for n, e in named.items()])
    names = list(named)
    grouped = slim.groupingSets([[F.col(n)] for n in names], *[F.col(n) for n in names]).agg(
        F.count("*").alias("n"), *[F.grouping(n).alias(f"_{n}") for n in names])
    which = F.coalesce(*[F.when(F.col(f"_{n}") == 0, F.lit(n)) for n in names])
    value = F.coalesce(*[F.when(F.col(f"_{n}") == 0, F.col(n)) for n in names])
    out = grouped.select(which.alias("dimension"), value.alias("value"), F.col("n"))
    if top:
        # a literal limit lets Spark cut each partition to k rows before the shuffle
        ranked = F.col("dimension").isin(list(top))
        place = F.row_number().over(W.partitionBy("dimension").orderBy(F.desc("n"), "value"))
        best = out.where(ranked).withColumn("_p", place).where(F.col("_p") <= max(top.values()))
        limit = F.coalesce(*[F.when(F.col("dimension") == d, F.lit(k)) for d, k in top.items()])
        out = best.where(F.col("_p") <= limit).drop("_p").unionByName(out.where(~ranked))
    return out


def security_summary(events: DataFrame, conditions: dict[str, Column], distinct: dict[str, str],
                     risk: Column | None = None, group_by=None) -> DataFrame:
    """Conditional counts, distinct counts and a risk level."""
    aggs = [F.count("*").alias("events")]
    aggs += [F.count_if(test).alias(name) for name, test in conditions.items()]
    aggs += [F.count_distinct(col(source)).alias(name) for name, source in distinct.items()]
    out = events.groupBy(*[col(g) for g in as_list(group_by)]).agg(*aggs)
    return out.withColumn("risk_level", risk) if risk is not None else out


def risk_level(failures: Column, suspicious: Column) -> Column:
    return (
        F.when((suspicious > 10) | (failures > 100), "high")
        .when((suspicious > 5) | (failures > 50), "medium")
        .otherwise("low")
    )


def period_event_counts(events: DataFrame, frameworks: dict[str, list[str]], type_col: str, time_col: str,
                        start: str, end: str) -> DataFrame:
    """Events per (framework, type) in a period, 0 for types that did not occur."""
    spark = events.sparkSession
    config = spark.createDataFrame(
        [(f, t) for f, types in frameworks.items() for t in types], "framework string, event_type string")
    stamp = col(time_col)
    kind = events.schema[time_col].dataType
    counts = (
        events.where((stamp >= F.lit(start).cast(kind)) & (stamp < F.lit(end).cast(kind)))
        .groupBy(col(type_col).alias("event_type")).agg(F.count("*").alias("n"))
    )
    return config.join(counts, "event_type", "left").select(
        "framework", "event_type", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def change_log_summary(log: DataFrame, keys=("action", "column", "trigger")) -> DataFrame:
    """Rows removed and cells changed per action, column and trigger in one pass."""
    names = as_list(keys)
    grouped = log.groupingSets([[col(n)] for n in names], *[col(n) for n in names]).agg(
        F.count("*").alias("entries"), F.sum("rows_removed").alias("rows_removed"),
        F.sum("cells_changed").alias("cells_changed"), *[F.grouping(n).alias(f"_{n}") for n in names])
    which = F.coalesce(*[F.when(F.col(f"_{n}") == 0, F.lit(n)) for n in names])
    value = F.coalesce(*[F.when(F.col(f"_{n}") == 0, col(n).cast("string")) for n in names])
    return grouped.select(which.alias("dimension"), value.alias("value"), "entries", "rows_removed", "cells_changed")


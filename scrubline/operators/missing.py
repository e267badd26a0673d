"""Missing values: constants, statistics, neighbours and interpolation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core import (action, as_list, chosen, col, data_type, is_numeric, is_string,
                    numeric_columns, string_columns, with_exprs)
from ..functions.numbers import to_number
from ..functions.stats import grouped_quantile, modes, moments, quantiles
from ..plans.cut import cut
from .curves import CURVES, KNOTS_PER_CHUNK, curve
from .curves import at as curve_at
from .ordered import running


def medians(df: DataFrame, columns: dict[str, Column]) -> dict[str, float | None]:
    return {name: q[0] for name, q in quantiles(df, columns, [0.5]).items()}


def _fill(df: DataFrame, values: dict[str, object]) -> DataFrame:
    """Fill nulls in one projection; a fraction widens an integer column to double."""
    exprs = {}
    for name, value in values.items():
        if value is None:
            continue
        kind = data_type(df, name)
        if is_numeric(df, name) and isinstance(value, float) and not value.is_integer():
            kind = "double"
        exprs[name] = F.coalesce(col(name).cast(kind), F.lit(value).cast(kind))
    return with_exprs(df, exprs)


@action("fill_missing")
def fill_missing(df: DataFrame, column: str | None = None, strategy: str = "mode", value=None,
                 group_by=None, by=None, order_by=None,
                 rows_per_bucket: int | None = None) -> DataFrame:
    """Fill nulls: mean, median, mode, value, zero, auto, ffill, bfill or drop.

    ``group_by`` takes the statistic (or the neighbour) from the row's own group.
    """
    columns = chosen(df, column, df.columns)
    groups = as_list(group_by or by)
    missing = [g for g in groups if g not in df.columns]
    if missing:
        raise ValueError(f"group-by column(s) not found: {missing}")
    if strategy == "drop":
        return df.dropna(subset=columns)
    if strategy in ("ffill", "forward_fill"):
        return fill_missing_ffill(df, columns, order_by, groups, rows_per_bucket)
    if strategy in ("bfill", "backward_fill"):
        return fill_missing_bfill(df, columns, order_by, groups, rows_per_bucket)
    if strategy == "value":
        return _fill(df, {c: value for c in columns}) if value is not None else df
    if strategy == "zero":
        return _fill(df, {c: 0 for c in columns if is_numeric(df, c)})
    if strategy == "auto":
        return impute_auto(df, columns=columns)
    if groups:
        for name in columns:
            if name not in groups:
                df = _fill_grouped(df, name, strategy, groups)
        return df
    numeric = [c for c in columns if is_numeric(df, c)]
    if strategy == "mean" and numeric:
        found = moments(df, {c: col(c) for c in numeric})
        return _fill(df, {c: found[c]["mean"] for c in numeric})
    if strategy == "median" and numeric:
        return _fill(df, medians(df, {c: col(c) for c in numeric}))
    if strategy == "mode":
        return _fill(df, modes(df, columns))
    return df


def _fill_grouped(df: DataFrame, name: str, strategy: str, groups: list[str]) -> DataFrame:
    if strategy in ("mean", "median") and not is_numeric(df, name):
        return df
    keys = [col(g) for g in groups]
    if strategy == "mean":
        stat = df.groupBy(*keys).agg(F.avg(col(name)).alias("q"))
    elif strategy == "median":
        stat = grouped_quantile(df, groups, col(name), 0.5)
    elif strategy == "mode":
        # counts per (group, value) first: a hot group is spread over its values
        counts = df.where(col(name).isNotNull()).groupBy(*keys, col(name).alias("v")).count()
        best = F.min_by("v", F.struct(-F.col("count"), F.col("v")))
        stat = counts.groupBy(*keys).agg(best.alias("q"))
    else:
        return df
    stat = stat.select(*[col(g).alias(f"_g{i}") for i, g in enumerate(groups)], F.col("q"))
    on = [col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(groups)]
    joined = df.join(stat, on, "left")
    filled = F.coalesce(col(name), F.col("q"))
    return joined.select(*[filled.alias(c) if c == name else col(c) for c in df.columns])


@action("fill_nulls")
def fill_nulls(df: DataFrame, columns=None, strategy: str = "constant", value=None,
               order_by=None, partition_by=None) -> DataFrame:
    """Pipeline-node form: the same strategy on several columns at once."""
    names = chosen(df, columns, df.columns)
    strategy = {"constant": "value", "forward_fill": "ffill", "backward_fill": "bfill"}.get(
        strategy, strategy
    )
    if strategy == "value":
        typed = {}
        for c in names:
            if is_string(df, c):
                typed[c] = None if value is None else str(value)
            elif is_numeric(df, c):
                try:
                    typed[c] = float(value)
                except (TypeError, ValueError):
                    typed[c] = None
        return _fill(df, typed)
    if strategy in ("ffill", "bfill"):
        step = fill_missing_ffill if strategy == "ffill" else fill_missing_bfill
        return step(df, names, order_by, partition_by)
    filled = df
    if strategy == "mode":
        return _fill(df, modes(df, names))
    numeric = [c for c in names if is_numeric(df, c)]
    if strategy == "mean" and numeric:
        found = moments(df, {c: col(c) for c in numeric})
        filled = _fill(df, {c: found[c]["mean"] for c in numeric})
    elif strategy == "median" and numeric:
        filled = _fill(df, medians(df, {c: col(c) for c in numeric}))
    return filled


def _neighbour(df: DataFrame, columns, order_by, partition_by, reverse: bool,
               rows_per_bucket: int | None) -> DataFrame:
    keys, order = as_list(partition_by), as_list(order_by)
    names = chosen(df, columns, [c for c in df.columns if c not in keys + order])
    specs = {f"_n{i}": ("last", col(c)) for i, c in enumerate(names)}
    scanned = running(df, keys, order, specs, reverse=reverse, rows_per_bucket=rows_per_bucket)
    place = {c: F.col(f"_n{i}") for i, c in enumerate(names)}
    return scanned.select(*[place[c].alias(c) if c in place else col(c) for c in df.columns])


@action("fill_missing_ffill")
def fill_missing_ffill(df: DataFrame, column=None, order_by=None, partition_by=None,
                       rows_per_bucket: int | None = None) -> DataFrame:
    """Last non-null value at or before the row."""
    return _neighbour(df, column, order_by, partition_by, False, rows_per_bucket)


@action("fill_missing_bfill")
def fill_missing_bfill(df: DataFrame, column=None, order_by=None, partition_by=None,
                       rows_per_bucket: int | None = None) -> DataFrame:
    """Next non-null value at or after the row."""
    return _neighbour(df, column, order_by, partition_by, True, rows_per_bucket)


@action("fill_missing_interpolate")
def fill_missing_interpolate(df: DataFrame, column=None, order_by=None, partition_by=None,
                             method: str = "linear",
                             rows_per_bucket: int | None = None) -> DataFrame:
    """Gaps between two values of an ordered column.

    ``linear`` goes by row position and ``time`` by the first order column (a
    number, date or time); ``nearest`` takes the nearer row's value, the earlier
    one when both are as near; ``previous`` and ``next`` take that neighbour's.
    ``pchip``, ``akima``, ``cubic`` and ``cubicspline`` draw a curve through the values
    by row position.
    A leading gap stays null but for ``next``; a trailing gap repeats the last
    value but for ``next``, ``akima`` and ``cubic``, where it stays null, and for ``pchip``
    and ``cubicspline``, which carry their last piece on.  Curves need two
    values; NaN and infinite ones are no points of a curve and stay.
    """
    if method in CURVES:
        return _curved(df, column, order_by, partition_by, method, rows_per_bucket)
    if method not in ("linear", "time", "nearest", "previous", "next"):
        raise ValueError(f"unsupported interpolation: {method}")
    if method in ("previous", "next"):
        numeric = [c for c in chosen(df, column, numeric_columns(df)) if is_numeric(df, c)]
        scan = fill_missing_ffill if method == "previous" else fill_missing_bfill
        return scan(df, numeric, order_by, partition_by, rows_per_bucket)
    keys, order = as_list(partition_by), as_list(order_by)
    names = [c for c in chosen(df, column, numeric_columns(df)) if is_numeric(df, c)]
    names = [c for c in names if c not in keys + order]
    if method == "time":
        when = col(order[0])
        numbered = df.withColumn("_row", when.cast("double") if is_numeric(df, order[0]) else F.unix_micros(when.cast("timestamp")).cast("double"))
    else:
        numbered = running(df, keys, order, {"_row": ("count", F.lit(1))}, rows_per_bucket=rows_per_bucket)

    def point(c):
        return F.when(col(c).isNotNull(),
                      F.struct(F.col("_row").alias("r"), col(c).cast("double").alias("v")))

    back = running(numbered, keys, order, {f"_p{i}": ("last", point(c)) for i, c in enumerate(names)},
                   rows_per_bucket=rows_per_bucket)
    both = running(back, keys, order, {f"_q{i}": ("last", point(c)) for i, c in enumerate(names)},
                   reverse=True, rows_per_bucket=rows_per_bucket)
    place = {}
    for i, c in enumerate(names):
        p, q = F.col(f"_p{i}"), F.col(f"_q{i}")
        slope = F.try_divide(q["v"] - p["v"], q["r"] - p["r"])
        line = F.coalesce(p["v"] + slope * (F.col("_row") - p["r"]), p["v"])
        if method == "nearest":
            line = F.when(F.col("_row") - p["r"] <= q["r"] - F.col("_row"), p["v"]).otherwise(q["v"])
        place[c] = (
            F.when(col(c).isNotNull(), col(c).cast("double"))
            .when(p.isNull(), F.lit(None).cast("double"))
            .when(q.isNull(), p["v"])
            .otherwise(line)
        )
    return both.select(*[place[c].alias(c) if c in place else col(c) for c in df.columns])


def _curved(df: DataFrame, column, order_by, partition_by, method: str, rows_per_bucket: int | None) -> DataFrame:
    """Rows take the cubic of the last known value at or before them.

    A value before a gap of many rows is one join key; as that side is the
    table's, the join may split it.
    """
    keys, order = as_list(partition_by), as_list(order_by)
    names = [c for c in chosen(df, column, numeric_columns(df)) if is_numeric(df, c) and c not in keys + order]
    values = {c: col(c).cast("double") for c in names}
    point = {c: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))) for c, v in values.items()}
    scans = {"_row": ("count", F.lit(1))} | {f"_k{i}": ("count", F.when(point[c], F.lit(1))) for i, c in enumerate(names)}
    # read by the knots of every column and by the result
    out = numbered = cut(running(df, keys, order, scans, rows_per_bucket=rows_per_bucket))
    for i, c in enumerate(names):
        knots = numbered.where(point[c]).select(*[col(k).alias(f"_g{j}") for j, k in enumerate(keys)], F.col(f"_k{i}").alias("_knot"),
                                                F.col("_row").cast("double").alias("_x"), values[c].alias("_y"))
        groups = [f"_g{j}" for j in range(len(keys))]
        pieces = curve(knots, groups, method, rows_per_bucket or KNOTS_PER_CHUNK)
        same = [F.col(f"_k{i}") == F.col("_knot")] + [col(k).eqNullSafe(F.col(g)) for k, g in zip(keys, groups)]
        filled = F.coalesce(values[c], curve_at(F.col("_row").cast("double")))
        out = out.join(pieces, same, "left").select(*[filled.alias(n) if n == c else col(n) for n in out.columns])
    return out.select(*[col(c) for c in df.columns])


@action("impute_auto")
def impute_auto(df: DataFrame, max_null: float = 0.7, columns=None) -> DataFrame:
    """Numeric columns (or text that is mostly numeric) get the median, others the mode.

    Columns without nulls, or with a null share of ``max_null`` and more, stay.
    """
    names = chosen(df, columns, df.columns)
    texts = [c for c in names if c in string_columns(df)]
    tests = [F.count("*").alias("_rows")]
    for i, c in enumerate(names):
        tests.append(F.count(col(c)).alias(f"n{i}"))
        if c in texts:
            tests.append(F.count_if(col(c).rlike(r"^-?\d+\.?\d*$")).alias(f"d{i}"))
    row = df.agg(*tests).first()
    as_number, as_mode = [], []
    for i, c in enumerate(names):
        nulls = row["_rows"] - row[f"n{i}"]
        if nulls == 0 or nulls >= max_null * row["_rows"]:
            continue
        if is_numeric(df, c) or (c in texts and row[f"n{i}"] and row[f"d{i}"] / row[f"n{i}"] > 0.5):
            as_number.append(c)
        else:
            as_mode.append(c)
    values = {c: to_number(col(c), is_numeric(df, c)) for c in as_number}
    found = medians(df, values) if values else {}
    exprs = {c: F.coalesce(values[c], F.lit(found[c])) for c in as_number if found[c] is not None}
    common = modes(df, as_mode)
    for c in as_mode:
        if common[c] is not None:
            exprs[c] = F.coalesce(col(c), F.lit(common[c]).cast(data_type(df, c)))
    return with_exprs(df, exprs)

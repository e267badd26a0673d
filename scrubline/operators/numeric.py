"""Numeric transforms: statistics first (one small aggregate), then one projection."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core import action, as_list, chosen, col, is_numeric, numeric_columns, with_exprs
from ..functions.numbers import clamp
from ..functions.stats import moments, quantiles
from .rows import fences


@action("clip_outliers")
def clip_outliers(df: DataFrame, column: str, method: str = "iqr", lower=None, upper=None,
                  iqr_factor: float = 1.5) -> DataFrame:
    if column not in df.columns or not is_numeric(df, column):
        return df
    if method == "iqr":
        lower, upper = fences(df, [column], "iqr", iqr_factor).get(column, (None, None))
    return df.withColumn(column, clamp(col(column), lower, upper))


@action("replace_outliers")
def replace_outliers(df: DataFrame, column: str, method: str = "iqr", strategy: str = "median",
                     iqr_factor: float = 1.5, z_threshold: float = 3.0) -> DataFrame:
    """Outliers become the mean or median of the other values, or null."""
    if column not in df.columns or not is_numeric(df, column):
        return df
    factor = z_threshold if method == "zscore" else iqr_factor
    fence = fences(df, [column], method, factor).get(column)
    if fence is None:
        return df
    value = col(column).cast("double")
    regular = F.when(value.between(*fence), value)
    if strategy == "mean":
        fill = moments(df, {"v": regular})["v"]["mean"]
    elif strategy == "median":
        fill = quantiles(df, {"v": regular}, [0.5])["v"][0]
    else:
        fill = None
    outlier = ~value.between(*fence)
    return df.withColumn(column, F.when(outlier, F.lit(fill).cast("double")).otherwise(value))


@action("winsorize")
def winsorize(df: DataFrame, column: str, lower: float = 0.05, upper: float = 0.95) -> DataFrame:
    if column not in df.columns or not is_numeric(df, column):
        return df
    low, high = quantiles(df, {"v": col(column)}, [lower, upper])["v"]
    return df.withColumn(column, clamp(col(column).cast("double"), low, high))


@action("clip_sigma")
def clip_sigma(df: DataFrame, columns=None, threshold: float = 3) -> DataFrame:
    names = [c for c in chosen(df, columns, numeric_columns(df)) if is_numeric(df, c)]
    limits = fences(df, names, "zscore", threshold)
    return with_exprs(df, {c: clamp(col(c).cast("double"), *limits[c]) for c in limits})


@action("round_numeric", row_wise=True)
def round_numeric(df: DataFrame, column=None, decimals: int = 2) -> DataFrame:
    """Half-even rounding."""
    names = [c for c in chosen(df, column, numeric_columns(df)) if is_numeric(df, c)]
    return with_exprs(df, {c: F.bround(col(c), decimals) for c in names})


@action("scale_numeric")
def scale_numeric(df: DataFrame, column=None, method: str = "min_max") -> DataFrame:
    """min_max or z_score; a constant column stays as it is."""
    names = [c for c in chosen(df, column, numeric_columns(df)) if is_numeric(df, c)]
    found = moments(df, {c: col(c) for c in names})
    exprs = {}
    for c in names:
        m = found[c]
        if method == "z_score" and m["std"]:
            exprs[c] = (col(c) - m["mean"]) / m["std"]
        elif method != "z_score" and m["n"] and m["max"] != m["min"]:
            exprs[c] = (col(c) - m["min"]) / (m["max"] - m["min"])
    return with_exprs(df, exprs)


@action("normalize")
def normalize(df: DataFrame, columns=None, method: str = "minmax") -> DataFrame:
    """Pipeline-node form: minmax, zscore or robust ((x - median) / IQR)."""
    if method != "robust":
        return scale_numeric(df, columns, "z_score" if method == "zscore" else "min_max")
    names = [c for c in chosen(df, columns, numeric_columns(df)) if is_numeric(df, c)]
    found = quantiles(df, {c: col(c) for c in names}, [0.25, 0.5, 0.75])
    exprs = {}
    for c, (q1, median, q3) in found.items():
        if q1 is not None and q3 != q1:
            exprs[c] = (col(c) - median) / (q3 - q1)
    return with_exprs(df, exprs)


@action("zscore_normalize")
def zscore_normalize(df: DataFrame, column: str, new_col: str | None = None) -> DataFrame:
    if column not in df.columns or not is_numeric(df, column):
        return df
    m = moments(df, {"v": col(column)})["v"]
    score = (col(column) - m["mean"]) / m["std"] if m["std"] else F.lit(0.0)
    return df.withColumn(new_col or f"{column}_zscore", score)


def _log_likelihoods(df: DataFrame, x: Column, lambdas: list[float]) -> list[float]:
    """Box-Cox profile log-likelihood of several candidates in one aggregate."""
    exprs = [F.count(x).alias("n"), F.sum(F.log(x)).alias("s")]
    for i, lam in enumerate(lambdas):
        y = F.log(x) if abs(lam) < 1e-9 else (F.pow(x, F.lit(lam)) - 1) / lam
        exprs.append(F.var_pop(y).alias(f"v{i}"))
    row = df.agg(*exprs).first()
    out = []
    for i, lam in enumerate(lambdas):
        variance = row[f"v{i}"]
        usable = variance is not None and variance > 0 and math.isfinite(variance)
        out.append(-row.n / 2 * math.log(variance) + (lam - 1) * row.s if usable else -math.inf)
    return out


def box_cox_lambda(df: DataFrame, column: str, shift: float, rounds: int = 6,
                   candidates: int = 11) -> float:
    """Maximum-likelihood exponent: each round refines the best interval of a grid."""
    x = col(column).cast("double") - F.lit(shift)
    low, high = -5.0, 5.0
    best = 1.0
    for _ in range(rounds):
        step = (high - low) / (candidates - 1)
        grid = [low + i * step for i in range(candidates)]
        scores = _log_likelihoods(df, x, grid)
        best = grid[max(range(candidates), key=scores.__getitem__)]
        low, high = best - step, best + step
    return best


@action("box_cox_transform")
def box_cox_transform(df: DataFrame, column: str, new_col: str | None = None) -> DataFrame:
    if column not in df.columns or not is_numeric(df, column):
        return df
    low = df.agg(F.min(col(column)).cast("double")).first()[0]
    if low is None:
        return df
    shift = low - 1
    lam = box_cox_lambda(df, column, shift)
    x = col(column).cast("double") - F.lit(shift)
    y = F.log(x) if abs(lam) < 1e-9 else (F.pow(x, F.lit(lam)) - 1) / lam
    return df.withColumn(new_col or f"{column}_boxcox", y)


def _edge_text(value: float) -> str:
    """Edge with three significant decimals, as interval labels show it."""
    text = f"{value:.3f}".rstrip("0")
    return text + "0" if text.endswith(".") else text


@action("bin_numeric")
def bin_numeric(df: DataFrame, column: str, bins: int = 5, strategy: str = "equal_width",
                labels=None, new_col: str | None = None) -> DataFrame:
    """Right-closed bins labelled ``(a, b]`` or by ``labels``."""
    new_col = new_col or f"{column}_bin"
    if column not in df.columns or not is_numeric(df, column):
        return df
    if strategy == "quantile":
        found = quantiles(df, {"v": col(column)}, [i / bins for i in range(bins + 1)])["v"]
        edges = sorted({e for e in found if e is not None})
        if len(edges) < 2:
            raise ValueError(f"cannot bin column {column!r}: too few distinct values")
        shown = [edges[0] - 0.001, *edges[1:]]
    else:
        m = moments(df, {"v": col(column)})["v"]
        if not m["n"] or m["min"] == m["max"]:
            raise ValueError(f"cannot bin column {column!r}: too few distinct values")
        width = (m["max"] - m["min"]) / bins
        edges = [m["min"] + i * width for i in range(bins)] + [m["max"]]
        edges[0] -= (m["max"] - m["min"]) * 0.001
        shown = edges
    names = as_list(labels)
    if len(names) != len(edges) - 1:
        names = [f"({_edge_text(a)}, {_edge_text(b)}]" for a, b in zip(shown, shown[1:])]
    value = col(column).cast("double")
    label = F.when(value <= edges[1], F.lit(names[0]))
    for edge, name in zip(edges[2:], names[1:]):
        label = label.when(value <= edge, F.lit(name))
    return df.withColumn(new_col, F.when(value.isNotNull(), label))


@action("one_hot_encode")
def one_hot_encode(df: DataFrame, column: str, prefix: str | None = None, max_categories: int = 1000) -> DataFrame:
    """0/1 column per category.  Columns are schema, so too many categories are refused."""
    if column not in df.columns:
        return df
    rows = df.select(col(column).alias("v")).where("v is not null").distinct().limit(max_categories + 1).collect()
    if len(rows) > max_categories:
        raise ValueError(f"{column!r} has more than {max_categories} categories")
    found = sorted(r.v for r in rows)
    text = prefix if prefix is not None else column
    return with_exprs(df, {
        f"{text}_{v}": F.coalesce((col(column) == F.lit(v)).cast("int"), F.lit(0)) for v in found
    })


@action("label_encode")
def label_encode(df: DataFrame, column: str, new_col: str | None = None,
                 rows_per_bucket: int | None = None) -> DataFrame:
    """Codes 0..k-1 in sorted order of the values, null -> -1."""
    from .ordered import running

    if column not in df.columns:
        return df
    values = df.select(col(column).alias("_v")).where("_v is not null").distinct()
    codes = running(values, None, ["_v"], {"_code": ("count", F.lit(1))}, rows_per_bucket=rows_per_bucket)
    joined = df.join(codes, col(column) == F.col("_v"), "left")
    return joined.select(*[col(c) for c in df.columns],
                         F.coalesce(F.col("_code") - 1, F.lit(-1).cast("long")).alias(new_col or f"{column}_encoded"))

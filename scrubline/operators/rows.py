"""Row filters, limits, paging and sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..core import action, as_list, chosen, col, data_type, is_numeric, numeric_columns
from ..functions.stats import moments, quantiles


@action("drop_rows_where", row_wise=True)
def drop_rows_where(df: DataFrame, column: str, value) -> DataFrame:
    """Drop rows equal to ``value`` (brought to the column's type); nulls survive."""
    if column not in df.columns or value is None:
        return df
    return df.where(~col(column).eqNullSafe(F.lit(value).try_cast(data_type(df, column))))


@action("drop_rows_matching", row_wise=True)
def drop_rows_matching(df: DataFrame, column: str, pattern: str, keep: bool = False, flags: str = "") -> DataFrame:
    if column not in df.columns or not pattern:
        return df
    inline = "".join(f for f in "im" if f in flags)
    regex = (f"(?{inline})" if inline else "") + pattern
    match = F.coalesce(col(column).cast("string").rlike(regex), F.lit(False))
    return df.where(match if keep else ~match)


@action("filter_rows", row_wise=True)
def filter_rows(df: DataFrame, column: str, operator: str, value=None) -> DataFrame:
    c = col(column)
    kind = data_type(df, column)
    typed = F.lit(value).try_cast(kind) if value is not None else None
    text = c.cast("string")
    if operator in ("is_null", "is_not_null"):
        return df.where(c.isNull() if operator == "is_null" else c.isNotNull())
    tests = {
        "==": lambda: c == typed,
        "!=": lambda: ~c.eqNullSafe(typed),
        ">": lambda: c > typed,
        "<": lambda: c < typed,
        ">=": lambda: c >= typed,
        "<=": lambda: c <= typed,
        "contains": lambda: F.lower(text).contains(str(value).lower()),
        "startswith": lambda: text.startswith(str(value)),
        "endswith": lambda: text.endswith(str(value)),
    }
    if operator not in tests:
        raise ValueError(f"unknown operator: {operator}")
    return df.where(tests[operator]())


@action("filter_nulls", row_wise=True)
def filter_nulls(df: DataFrame, columns=None, how: str = "any") -> DataFrame:
    return df.dropna(how=how, subset=chosen(df, columns, df.columns))


@action("drop_rows_missing_threshold", row_wise=True)
def drop_rows_missing_threshold(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Keep rows with at least max(1, int(columns * (1 - threshold))) values."""
    return df.dropna(thresh=max(1, int(len(df.columns) * (1 - threshold))))


def fences(df: DataFrame, columns: list[str], method: str, threshold: float,
           population: bool = False) -> dict[str, tuple]:
    """(lower, upper) limits per column from its quartiles or its mean and deviation."""
    values = {c: col(c) for c in columns}
    out = {}
    if method == "iqr":
        for c, (q1, q3) in quantiles(df, values, [0.25, 0.75]).items():
            if q1 is not None:
                out[c] = (q1 - threshold * (q3 - q1), q3 + threshold * (q3 - q1))
    elif method == "zscore":
        for c, m in moments(df, values).items():
            std = m["pstd" if population else "std"]
            if std:
                out[c] = (m["mean"] - threshold * std, m["mean"] + threshold * std)
    else:
        raise ValueError(f"unknown outlier method: {method}")
    return out


@action("outlier_remove")
def outlier_remove(df: DataFrame, columns=None, method: str = "iqr", threshold: float = 1.5) -> DataFrame:
    """Drop rows outside the fence of any column; nulls are no outliers."""
    names = [c for c in chosen(df, columns, numeric_columns(df)) if is_numeric(df, c)]
    keep = F.lit(True)
    for c, (low, high) in fences(df, names, method, threshold).items():
        keep = keep & F.coalesce(col(c).between(low, high), F.lit(True))
    return df.where(keep)


def page_rows(df: DataFrame, order_by, start: int = 0, end: int = 100) -> DataFrame:
    """Rows start..end of the sorted table: a top-k, never a full sort on the driver."""
    return df.orderBy(*[col(c) for c in as_list(order_by)]).offset(start).limit(max(end - start, 0))


def preview(df: DataFrame, n: int = 100) -> DataFrame:
    """First n rows with NaN and infinities shown as null."""
    exprs = []
    for field in df.schema:
        c = col(field.name)
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            c = F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)
        exprs.append(c.alias(field.name))
    return df.limit(n).select(*exprs)


def _spread(df: DataFrame, keys, seed: int):
    """Repeatable pseudo-random order key of a row."""
    return F.xxhash64(*[col(c) for c in as_list(keys) or df.columns], F.lit(seed))


@action("sample_random")
def sample_random(df: DataFrame, n: int | None = None, frac: float | None = None, seed: int = 42,
                  keys=None) -> DataFrame:
    """n rows by smallest key hash (same rows whatever the partitioning), or a fraction."""
    if n:
        return df.orderBy(_spread(df, keys, seed)).limit(n)
    return df.sample(fraction=frac, seed=seed) if frac else df


def _first_per_stratum(df: DataFrame, column: str, limits, seed: int, keys) -> DataFrame:
    """The rows with the smallest hashes of every stratum.

    Two levels of ranking: first inside 64 hash slices of the stratum, then over
    the survivors, so a hot stratum is never ranked by one task.
    """
    from pyspark.sql import Window as W

    tagged = limits(df.withColumns({"_h": _spread(df, keys, seed)})).withColumn(
        "_slice", F.pmod(F.col("_h"), F.lit(64))
    )
    part = W.partitionBy(col(column), F.col("_slice")).orderBy("_h")
    whole = W.partitionBy(col(column)).orderBy("_h")
    kept = tagged.withColumn("_r", F.row_number().over(part)).where("_r <= _take")
    return kept.withColumn("_r", F.row_number().over(whole)).where("_r <= _take").select(
        *[col(c) for c in df.columns]
    )


@action("sample_stratified")
def sample_stratified(df: DataFrame, column: str, n: int = 1, seed: int = 42, keys=None) -> DataFrame:
    if column not in df.columns:
        return df
    return _first_per_stratum(df, column, lambda d: d.withColumn("_take", F.lit(n)), seed, keys)


def smart_sample(df: DataFrame, n: int, stratify_col: str | None = None, seed: int = 42, keys=None,
                 max_strata: int | None = None) -> DataFrame:
    """Proportional sample, max(1, n * share) of each stratum; a plain one without strata, or with over ``max_strata`` of them if that is given."""
    total = df.count()
    if total <= n:
        return df
    if stratify_col in df.columns:
        strata = df.groupBy(col(stratify_col).alias("_s")).agg(F.count("*").alias("_c"))
        if max_strata is None or strata.count() <= max_strata:
            take = strata.withColumn("_take", F.greatest(F.lit(1), F.floor(F.lit(n) * F.col("_c") / F.lit(total))))

            def limits(d):
                return d.join(take, col(stratify_col).eqNullSafe(F.col("_s"))).drop("_s", "_c")

            return _first_per_stratum(df, stratify_col, limits, seed, keys)
    return sample_random(df, n=n, seed=seed, keys=keys)


def split_frames(df: DataFrame, test_size: float = 0.2, seed: int = 42, keys=None) -> tuple[DataFrame, DataFrame]:
    """(train, test) by hash bucket: disjoint, repeatable, no shuffle."""
    bucket = F.pmod(_spread(df, keys, seed), F.lit(10_000))
    cut = int(round(test_size * 10_000))
    return df.where(bucket >= cut), df.where(bucket < cut)


@action("train_test_split", row_wise=True)
def train_test_split(df: DataFrame, test_size: float = 0.2, seed: int = 42, return_test: bool = False,
                     keys=None) -> DataFrame:
    train, test = split_frames(df, test_size, seed, keys)
    return test if return_test else train


def top_k(df: DataFrame, order_by, k: int, descending: bool = True) -> DataFrame:
    keys = [(F.desc if descending else F.asc)(col(c)) for c in as_list(order_by)]
    return df.orderBy(*keys).limit(k)

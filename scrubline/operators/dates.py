"""Date and time operators (all one projection, except the period roll-up)."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core import action, as_list, col, numeric_columns, with_exprs
from ..functions.dates import as_timestamp, parse_dates, spark_format, whole_days
from ..functions.stats import grouped_quantile


@action("standardise_dates", "standardise_mixed_dates", row_wise=True)
def standardise_dates(df: DataFrame, column: str, dayfirst: bool = True,
                      output_format: str = "%Y-%m-%d") -> DataFrame:
    """Any common layout -> one text layout; unreadable dates become null."""
    if column not in df.columns:
        return df
    stamp = as_timestamp(df, column, dayfirst)
    return df.withColumn(column, F.date_format(stamp, spark_format(output_format)))


_PARTS = {
    "year": F.year,
    "month": F.month,
    "day": F.dayofmonth,
    "weekday": lambda t: F.date_format(t, "EEEE"),
    "quarter": F.quarter,
    "week": F.weekofyear,
    "hour": F.hour,
    "minute": F.minute,
    "second": F.second,
}


@action("extract_date_parts", row_wise=True)
def extract_date_parts(df: DataFrame, column: str, parts=("year", "month", "day"),
                       prefix: str | None = None, dayfirst: bool = True) -> DataFrame:
    if column not in df.columns:
        return df
    prefix = prefix or f"{column}_"
    stamp = as_timestamp(df, column, dayfirst)
    exprs = {}
    for part in as_list(parts):
        if part in _PARTS:
            bare = prefix.rstrip("_")
            exprs[bare if bare.endswith(part) else prefix + part] = _PARTS[part](stamp)
    return with_exprs(df, exprs)


def _reference(text: str | None) -> Column:
    """A fixed date, or today at midnight when none is given."""
    value = text or datetime.date.today().isoformat()
    return parse_dates(F.lit(value), False)


@action("calculate_date_diff", row_wise=True)
def calculate_date_diff(df: DataFrame, column: str, column2: str | None = None,
                        reference_date: str | None = None, unit: str = "days",
                        new_col: str | None = None, absolute: bool = True,
                        dayfirst: bool = True) -> DataFrame:
    if column not in df.columns or not (column2 in df.columns or reference_date):
        return df
    other = as_timestamp(df, column2, dayfirst) if column2 in df.columns else _reference(reference_date)
    days = whole_days(as_timestamp(df, column, dayfirst), other)
    if absolute:
        days = F.abs(days)
    value = {
        "weeks": F.bround(days / 7, 1),
        "months": F.bround(days / 30.4375, 1),
        "years": F.bround(days / 365.25, 2),
    }.get(unit, days)
    return df.withColumn(new_col or f"{column}_diff_{unit}", value)


@action("flag_future_dates", row_wise=True)
def flag_future_dates(df: DataFrame, column: str, cutoff_date: str | None = None,
                      flag_col: str | None = None, dayfirst: bool = True) -> DataFrame:
    if column not in df.columns:
        return df
    late = as_timestamp(df, column, dayfirst) > _reference(cutoff_date)
    return df.withColumn(flag_col or f"{column}_is_future", F.coalesce(late, F.lit(False)))


@action("flag_weekend_dates", row_wise=True)
def flag_weekend_dates(df: DataFrame, column: str, flag_col: str | None = None,
                       dayfirst: bool = True) -> DataFrame:
    if column not in df.columns:
        return df
    weekend = F.weekday(as_timestamp(df, column, dayfirst)) >= 5
    return df.withColumn(flag_col or f"{column}_is_weekend", F.coalesce(weekend, F.lit(False)))


@action("age_from_date", row_wise=True)
def age_from_date(df: DataFrame, column: str, reference_date: str | None = None,
                  unit: str = "years", new_col: str | None = None, dayfirst: bool = True) -> DataFrame:
    if column not in df.columns:
        return df
    days = whole_days(_reference(reference_date), as_timestamp(df, column, dayfirst))
    value = {
        "years": F.floor(days / 365.25).cast("long"),
        "months": F.bround(days / 30.4375, 1),
    }.get(unit, days)
    return df.withColumn(new_col or f"{column}_age", F.when(days >= 0, value))


# --- fixed values: period letters --------------------------------------------
PERIODS = {
    "D": ("day", "interval 1 day"), "W": ("week", "interval 7 days"),
    "M": ("month", "interval 1 month"), "ME": ("month", "interval 1 month"),
    "Q": ("quarter", "interval 3 months"), "Y": ("year", "interval 1 year"),
    "H": ("hour", "interval 1 hour"), "h": ("hour", "interval 1 hour"),
}
# --- end of fixed values -----------------------------------------------------

_AGGREGATES = {
    "sum": F.sum, "mean": F.avg, "avg": F.avg, "min": F.min, "max": F.max, "count": F.count,
    "std": F.stddev_samp,
}


@action("aggregate_by_period")
def aggregate_by_period(df: DataFrame, date_column: str, value_column: str | None = None,
                        period: str = "M", agg_func: str = "sum", dayfirst: bool = False) -> DataFrame:
    """Calendar roll-up with a row for every period between first and last.

    The empty periods come from a sequence over the (tiny) range of the result,
    so the table itself is read once.
    """
    unit, step = PERIODS[period]
    values = [value_column] if value_column else [c for c in numeric_columns(df) if c != date_column]
    start = F.date_trunc(unit, as_timestamp(df, date_column, dayfirst)).cast("timestamp_ntz")
    dated = df.withColumn("_period", start).where("_period is not null")
    if agg_func == "median":
        # a period's values never meet in one task
        rolled = dated.select("_period").distinct()
        for v in values:
            middle = grouped_quantile(dated, ["_period"], col(v), 0.5).select(F.col("_period").alias("_p"), F.col("q").alias(v))
            rolled = rolled.join(middle, F.col("_period") == F.col("_p"), "left").drop("_p")
    else:
        fold = _AGGREGATES[agg_func]
        rolled = dated.groupBy("_period").agg(*[fold(col(v)).alias(v) for v in values])
    span = rolled.agg(F.min("_period").alias("lo"), F.max("_period").alias("hi"))
    grid = span.where("lo is not null").select(F.explode(F.expr(f"sequence(lo, hi, {step})")).alias(date_column))
    out = grid.join(rolled, F.col(date_column) == F.col("_period"), "left").drop("_period")
    if agg_func in ("sum", "count"):
        out = out.fillna(0, subset=values)
    return out

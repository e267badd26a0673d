"""Queries for dates and times."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dates
from .base import query


def mixed(t):
    """Order dates in seven layouts."""
    layouts = ["yyyy-MM-dd", "dd/MM/yyyy", "d.M.yyyy", "MMM d, yyyy", "d MMMM yyyy", "yyyy/MM/dd HH:mm:ss", "yyyyMMdd"]
    cases = " ".join(f"WHEN {i} THEN date_format(o_orderdate, '{p}')" for i, p in enumerate(layouts))
    return t.orders.selectExpr("o_orderkey", f"CASE o_orderkey % 8 {cases} ELSE 'no date' END AS d")


@query("standardise_dates", "SELECT o_orderkey, CASE WHEN o_orderkey % 8 < 7 THEN strftime(o_orderdate, '%Y-%m-%d') END AS d FROM orders")
def standardise_dates(t):
    return dates.standardise_dates(mixed(t), "d")


@query("standardise_mixed_dates", """
SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate + INTERVAL 20 YEAR, '%d/%m/%Y')
  WHEN day(o_orderdate) > 12 THEN strftime(o_orderdate, '%d/%m/%Y')
  ELSE lpad(CAST(month(o_orderdate) AS VARCHAR), 2, '0') || '/' || lpad(CAST(day(o_orderdate) AS VARCHAR), 2, '0') || '/' || year(o_orderdate) END AS d
FROM orders""")
def standardise_mixed_dates(t):
    # month-first text read day-first: swapped where both readings exist
    df = t.orders.selectExpr("o_orderkey", "CASE WHEN o_orderkey % 2 = 0 THEN string(unix_seconds(timestamp(o_orderdate + interval 20 years))) "
                             "ELSE date_format(o_orderdate, 'M-d-yyyy') END AS d")
    return dates.standardise_dates(df, "d", dayfirst=True, output_format="%d/%m/%Y")


@query("extract_date_parts", """
SELECT event_id, year(ts) AS p_year, month(ts) AS p_month, day(ts) AS p_day, dayname(ts) AS p_weekday, quarter(ts) AS p_quarter,
  week(ts) AS p_week, hour(ts) AS p_hour, minute(ts) AS p_minute, second(ts) AS p_second FROM events""")
def extract_date_parts(t):
    return dates.extract_date_parts(
        t.events.select("event_id", "ts"), "ts",
        ["year", "month", "day", "weekday", "quarter", "week", "hour", "minute", "second"], "p_").drop("ts")


@query("calculate_date_diff", """
WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, abs(date_diff('day', TIMESTAMP '1998-01-01', l_shipdate)) AS days FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, days, round_even(days / 7.0, 1)::DOUBLE AS weeks, round_even(days / 365.25, 2)::DOUBLE AS years FROM s""")
def calculate_date_diff(t):
    df = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate")
    for unit in ("days", "weeks", "years"):
        df = dates.calculate_date_diff(df, "l_shipdate", reference_date="1998-01-01", unit=unit, new_col=unit)
    return df.drop("l_shipdate")


@query("flag_future_dates", "SELECT o_orderkey, o_orderdate > TIMESTAMP '1999-06-01' AS d_is_future FROM orders")
def flag_future_dates(t):
    df = t.orders.selectExpr("o_orderkey", "date_format(o_orderdate, 'yyyy-MM-dd') AS d")
    return dates.flag_future_dates(df, "d", "1999-06-01").drop("d")


@query("flag_weekend_dates", "SELECT event_id, isodow(ts) >= 6 AS ts_is_weekend FROM events")
def flag_weekend_dates(t):
    return dates.flag_weekend_dates(t.events.select("event_id", "ts"), "ts").drop("ts")


@query("age_from_date", """
WITH s AS (SELECT o_orderkey, date_diff('day', o_orderdate, TIMESTAMP '2000-01-01') AS days FROM orders)
SELECT o_orderkey, CASE WHEN days >= 0 THEN CAST(floor(days / 365.25) AS BIGINT) END AS years,
  CASE WHEN days >= 0 THEN round_even(days / 30.4375, 1)::DOUBLE END AS months FROM s""")
def age_from_date(t):
    df = t.orders.select("o_orderkey", "o_orderdate")
    df = dates.age_from_date(df, "o_orderdate", "2000-01-01", "years", "years")
    return dates.age_from_date(df, "o_orderdate", "2000-01-01", "months", "months").drop("o_orderdate")


@query("aggregate_by_period", """
WITH s AS (SELECT date_trunc('month', o_orderdate) AS m, sum(o_totalprice) AS v FROM orders WHERE month(o_orderdate) <> 5 GROUP BY 1),
g AS (SELECT unnest(generate_series((SELECT min(m) FROM s), (SELECT max(m) FROM s), INTERVAL 1 MONTH)) AS m)
SELECT strftime(g.m, '%Y-%m-%d') AS o_orderdate, round(coalesce(v, 0), 2) AS o_totalprice FROM g LEFT JOIN s ON s.m = g.m""")
def aggregate_by_period(t):
    df = t.orders.where("month(o_orderdate) <> 5")
    out = dates.aggregate_by_period(df, "o_orderdate", "o_totalprice", "M", "sum")
    return out.select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate"), F.round("o_totalprice", 2).alias("o_totalprice"))


@query("aggregate_by_period_median", """
WITH s AS (SELECT date_trunc('quarter', o_orderdate) AS m, quantile_cont(o_totalprice, 0.5) AS v FROM orders GROUP BY 1)
SELECT strftime(m, '%Y-%m-%d') AS o_orderdate, round(v, 2) AS o_totalprice FROM s""")
def aggregate_by_period_median(t):
    out = dates.aggregate_by_period(t.orders, "o_orderdate", "o_totalprice", "Q", "median")
    return out.select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate"), F.round("o_totalprice", 2).alias("o_totalprice"))

"""Queries for window functions: per key, and over the whole table in many buckets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import windows
from .base import query
from .missing import rounded

ORDER = ["ts", "event_id"]


def events(t):
    return t.events.select("event_id", "user_id", "ts", "value")


@query("add_rank", """
SELECT l_orderkey, l_linenumber, l_partkey, rank() OVER w + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0::DOUBLE AS r_average,
  rank() OVER w AS r_min, dense_rank() OVER w AS r_dense FROM lineitem WINDOW w AS (ORDER BY l_quantity DESC)""")
def add_rank(t):
    df = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    for method in ("average", "min", "dense"):
        df = windows.add_rank(df, "l_quantity", method, f"r_{method}", rows_per_bucket=20)
    return df.drop("l_quantity")


@query("add_rank_bigint", """
WITH s AS (SELECT l_orderkey, l_linenumber, 9007199254740992 + l_quantity::BIGINT AS big, l_shipdate::VARCHAR AS day FROM lineitem)
SELECT l_orderkey, l_linenumber, rank() OVER (ORDER BY big DESC) AS r_big, rank() OVER (ORDER BY day DESC) AS r_day FROM s""")
def add_rank_bigint(t):
    df = t.lineitem.selectExpr("l_orderkey", "l_linenumber", "9007199254740992 + cast(l_quantity AS bigint) AS big", "date_format(l_shipdate, 'yyyy-MM-dd HH:mm:ss') AS day")
    df = windows.add_rank(df, "big", "min", "r_big", rows_per_bucket=20)
    return windows.add_rank(df, "day", "min", "r_day", rows_per_bucket=200).drop("big", "day")


@query("add_rank_first", """
SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS r FROM events""")
def add_rank_first(t):
    return windows.add_rank(t.events.select("event_id", "user_id", "value"), "value", "first", "r", "user_id", "event_id").drop("value")


@query("add_percentile", """
SELECT o_orderkey, round((rank() OVER (ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_totalprice) - 1) / 2.0) / count(*) OVER () * 100, 6) AS p FROM orders""")
def add_percentile(t):
    out = windows.add_percentile(t.orders.select("o_orderkey", "o_totalprice"), "o_totalprice", "p", rows_per_bucket=4000)
    return rounded(out.drop("o_totalprice"), "p", digits=6)


@query("lag_column", "SELECT event_id, lag(value, 2) OVER (ORDER BY ts, event_id) AS prev FROM events")
def lag_column(t):
    return windows.lag_column(events(t), "value", 2, "prev", order_by=ORDER, rows_per_bucket=2500).select("event_id", "prev")


@query("lead_column", "SELECT event_id, lead(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS value_lead_1 FROM events")
def lead_column(t):
    return windows.lead_column(events(t), "value", partition_by="user_id", order_by=ORDER).select("event_id", "value_lead_1")


@query("lag_columns", """
SELECT event_id, lag(value, 1) OVER w AS value_lag1, lag(value, 2) OVER w AS value_lag2, lag(value, 3) OVER w AS value_lag3 FROM events
WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def lag_columns(t):
    out = windows.lag_columns(events(t), "value", 3, partition_by="user_id", order_by=ORDER)
    return out.select("event_id", "value_lag1", "value_lag2", "value_lag3")


@query("percentage_change", """
SELECT event_id, round((value / nullif(lag(value) OVER (ORDER BY ts, event_id), 0) - 1) * 100, 3) AS value_pct_change FROM events""")
def percentage_change(t):
    out = windows.percentage_change(events(t), "value", order_by=ORDER, rows_per_bucket=3000)
    return rounded(out.select("event_id", "value_pct_change"), "value_pct_change", digits=3)


@query("rolling_stats", """
SELECT event_id, CASE WHEN count(value) OVER w = 5 THEN round(avg(value) OVER w, 4) END AS value_rolling_mean_5,
  CASE WHEN count(value) OVER w = 5 THEN round(stddev_samp(value) OVER w, 4) END AS value_rolling_std_5,
  CASE WHEN count(value) OVER w = 5 THEN max(value) OVER w END AS value_rolling_max_5 FROM events
WINDOW w AS (ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""")
def rolling_stats(t):
    out = windows.rolling_stats(events(t), "value", 5, ["mean", "std", "max"], order_by=ORDER, rows_per_bucket=1700)
    return rounded(out.drop("user_id", "ts", "value"), "value_rolling_mean_5", "value_rolling_std_5")


@query("cumulative_sum", """
SELECT event_id, CASE WHEN event_id % 4 <> 0 THEN round(sum(CASE WHEN event_id % 4 <> 0 THEN value END) OVER (ORDER BY ts, event_id), 2) END AS total FROM events""")
def cumulative_sum(t):
    df = t.events.selectExpr("event_id", "ts", "CASE WHEN event_id % 4 <> 0 THEN value END AS value")
    return rounded(windows.cumulative_sum(df, "value", "total", order_by=ORDER, rows_per_bucket=900), "total", digits=2).drop("ts", "value")


@query("cumulative_stats_std", """
SELECT event_id, round(stddev_samp(value) OVER w, 6) AS value_cum_std, round(var_samp(value) OVER w, 6) AS value_cum_var FROM events
WINDOW w AS (PARTITION BY user_id % 3 ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""")
def cumulative_stats_std(t):
    df = events(t).withColumn("g", F.col("user_id") % 3)
    out = windows.cumulative_stats(df, "value", ["std", "var"], partition_by="g", order_by=ORDER, rows_per_bucket=1200)
    return rounded(rounded(out, "value_cum_std", digits=6), "value_cum_var", digits=6).select("event_id", "value_cum_std", "value_cum_var")


@query("cumulative_stats", """
SELECT event_id, round(sum(value) OVER w, 2) AS value_cum_sum, max(value) OVER w AS value_cum_max, min(value) OVER w AS value_cum_min,
  round(avg(value) OVER w, 7) AS value_cum_mean FROM events WINDOW w AS (PARTITION BY user_id % 3 ORDER BY ts, event_id)""")
def cumulative_stats(t):
    df = events(t).withColumn("g", F.col("user_id") % 3)
    out = windows.cumulative_stats(df, "value", ["sum", "max", "min", "mean"], partition_by="g", order_by=ORDER, rows_per_bucket=1200)
    return rounded(rounded(out, "value_cum_sum", digits=2), "value_cum_mean", digits=7).drop("user_id", "ts", "value", "g")

"""Queries for outliers, anomalies, time series and models."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import anomalies, model, seasonal
from .base import query
from .missing import rounded


@query("detect_outliers_iqr", """
WITH f AS (SELECT quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.75) AS q3 FROM lineitem)
SELECT 'l_extendedprice' AS "column", 'IQR' AS method, count_if(l_extendedprice < q1 - 0.3 * (q3 - q1) OR l_extendedprice > q3 + 0.3 * (q3 - q1)) AS outlier_count,
  round(max(q1 - 0.3 * (q3 - q1)), 3) AS lower_bound, round(max(q3 + 0.3 * (q3 - q1)), 3) AS upper_bound,
  CASE WHEN count_if(l_extendedprice < q1 - 0.3 * (q3 - q1) OR l_extendedprice > q3 + 0.3 * (q3 - q1)) > 0.05 * count(*) THEN 'high' ELSE 'medium' END AS severity FROM lineitem, f""")
def detect_outliers_iqr(t):
    return rounded(anomalies.detect_outliers_iqr(t.lineitem, "l_extendedprice", 0.3), "lower_bound", "upper_bound", digits=3)


@query("detect_outliers_zscore", """
WITH f AS (SELECT avg(value) AS a, stddev_pop(value) AS p, stddev_samp(value) AS s FROM events)
SELECT 'Z-score' AS method, count_if(abs(value - a) > 2 * p) AS outlier_count FROM events, f UNION ALL
SELECT 'GrubbsTest', count_if(abs(value - a) > 2 * s) FROM events, f""")
def detect_outliers_zscore(t):
    a = anomalies.detect_outliers_zscore(t.events, "value", 2)
    return a.unionByName(anomalies.detect_outliers_zscore(t.events, "value", 2, population=False)).select("method", "outlier_count")


@query("flag_anomalies", """
WITH f AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events)
SELECT event_id, value < a - (b - a) OR value > b + (b - a) AS odd FROM events, f""")
def flag_anomalies(t):
    return anomalies.flag_anomalies(t.events.select("event_id", "value"), "value", "iqr", 1, "odd").drop("value")


@query("isolation_forest")
def isolation_forest(t):
    return rounded(anomalies.isolation_forest(t.lineitem.select("l_orderkey", "l_quantity", "l_extendedprice", "l_discount"), ["l_quantity", "l_extendedprice", "l_discount"]),
                   "anomaly_score")


@query("cluster_anomalies")
def cluster_anomalies(t):
    return anomalies.cluster_anomalies(t.events.select("event_id", "value"), "value")


@query("text_anomalies", r"""
WITH m AS (SELECT avg(length(text)) AS a, stddev_samp(length(text)) AS s FROM conversations), c AS (
SELECT count(*) AS n, count_if(abs((length(text) - a) / s) > 2) AS l, count_if(regexp_matches(text, '(?i)[<>"'']|test|fake|sample')) AS x,
  count_if(len(list_filter(range(1, length(text) // 4 + 1), lambda i: starts_with(text, repeat(left(text, i), 4)) AND NOT contains(left(text, i), chr(10)))) > 0) AS r FROM conversations, m)
SELECT 'text' AS "column", type, count FROM (SELECT 'unusual_length' AS type, CASE WHEN l < n * 0.1 THEN l ELSE 0 END AS count FROM c
  UNION ALL SELECT 'suspicious_content', x FROM c UNION ALL SELECT 'repeated_pattern', r FROM c) WHERE count > 0""")
def text_anomalies(t):
    return anomalies.text_anomalies(t.conversations, "text")


@query("text_anomalies_repeats")
def text_anomalies_repeats(t):
    return anomalies.text_anomalies(t.documents, ["text", "source"])


@query("domain_anomalies", """
WITH s AS (SELECT CASE WHEN o_orderkey % 50 = 0 THEN -o_totalprice WHEN o_orderkey % 997 = 0 THEN o_totalprice * 100 ELSE o_totalprice END AS amount, o_orderdate FROM orders),
q AS (SELECT quantile_cont(amount, 0.99) AS q FROM s)
SELECT 'amount' AS "column", 'negative_amount' AS type, count(*) AS count FROM s WHERE amount < 0 UNION ALL
SELECT 'amount', 'extreme_amount', count(*) FROM s, q WHERE amount > q * 10 UNION ALL SELECT 'o_orderdate', 'future_date', count(*) FROM s WHERE o_orderdate > TIMESTAMP '2000-01-01'""")
def domain_anomalies(t):
    df = t.orders.selectExpr("CASE WHEN o_orderkey % 50 = 0 THEN -o_totalprice WHEN o_orderkey % 997 = 0 THEN o_totalprice * 100 ELSE o_totalprice END AS amount", "o_orderdate")
    return anomalies.domain_anomalies(df, "financial", "2000-01-01 00:00:00")


@query("timeseries_anomalies", """
WITH n AS (SELECT event_id, value, row_number() OVER w AS r, avg(value) OVER (ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS trend FROM events WINDOW w AS (ORDER BY ts, event_id)),
p AS (SELECT (r - 1) % 7 AS p, avg(value - trend) AS s FROM n GROUP BY 1), d AS (SELECT n.*, value - trend - s AS res FROM n JOIN p ON p.p = (r - 1) % 7),
q AS (SELECT quantile_cont(res, 0.25) AS a, quantile_cont(res, 0.75) AS b, stddev_samp(res) AS sd FROM d)
SELECT event_id, round(res, 4) AS residual, round(res / sd, 4) AS zscore FROM d, q WHERE res < a - 1.2 * (b - a) OR res > b + 1.2 * (b - a)""")
def timeseries_anomalies(t):
    out = anomalies.timeseries_anomalies(t.events.select("event_id", "ts", "value"), ["ts", "event_id"], "value", 7, k=1.2, rows_per_bucket=3000)
    return rounded(out.select("event_id", "residual", "zscore"), "residual", "zscore")


@query("timeseries_summary", """
WITH e AS (SELECT date_trunc('day', ts) AS day, sum(value) AS value FROM events GROUP BY 1),
n AS (SELECT value, row_number() OVER (ORDER BY day) AS r, avg(value) OVER (ORDER BY day ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS trend FROM e),
p AS (SELECT (r - 1) % 7 AS p, avg(value - trend) AS s FROM n GROUP BY 1), d AS (SELECT n.*, value - trend - s AS res FROM n JOIN p ON p.p = (r - 1) % 7),
q AS (SELECT quantile_cont(res, 0.25) AS a, quantile_cont(res, 0.75) AS b FROM d)
SELECT count(*) AS rows, count_if(res < a - 3 * (b - a) OR res > b + 3 * (b - a)) AS anomaly_count, round(regr_slope(trend, r), 4) AS trend_slope,
  CASE WHEN abs(regr_slope(trend, r)) > 0.5 THEN 'trending_anomaly' ELSE 'point_anomaly' END AS anomaly_type, 'medium' AS severity FROM d, q""")
def timeseries_summary(t):
    daily = t.events.groupBy(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day")).agg(F.sum("value").alias("value"))
    return rounded(anomalies.timeseries_summary(daily, "day", "value"), "trend_slope")


# robust local regression has no SQL form; tests/test_seasonal.py holds it against a sequential one
@query("stl_anomalies")
def stl_anomalies(t):
    out = anomalies.timeseries_anomalies(t.events.select("event_id", "ts", "value"), ["ts", "event_id"], "value", 7, k=1.2, method="stl")
    return rounded(out.select("event_id", "trend", "seasonal", "residual", "zscore"), "trend", "seasonal", "residual", "zscore")


@query("stl_by_user")
def stl_by_user(t):
    out = seasonal.stl(t.events.select("event_id", "user_id", "ts", "value"), ["ts", "event_id"], "value", 7, "user_id")
    return rounded(out.select("event_id", "user_id", "trend", "seasonal", "residual"), "trend", "seasonal", "residual")


@query("rolling_zscore_anomalies", """
WITH s AS (SELECT event_id, user_id, value, count(value) OVER w AS n, avg(value) OVER w AS a, stddev_samp(value) OVER w AS s FROM events
  WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING))
SELECT event_id, CASE WHEN n >= 3 AND s > 0 THEN round((value - a) / s, 5) END AS zscore, coalesce(n >= 3 AND s > 0 AND abs((value - a) / s) > 2.5, false) AS is_anomaly FROM s""")
def rolling_zscore_anomalies(t):
    df = t.events.select("event_id", "user_id", "ts", "value")
    out = anomalies.rolling_zscore_anomalies(df, ["ts", "event_id"], "value", 10, 3, 2.5, "user_id", rows_per_bucket=4000)
    return rounded(out.select("event_id", "zscore", "is_anomaly"), "zscore", digits=5)


@query("infer_period", """
WITH d AS (SELECT DISTINCT o_orderdate AS t FROM orders), g AS (SELECT date_diff('hour', lag(t) OVER (ORDER BY t), t) AS gap FROM d)
SELECT CASE WHEN gap <= 12 THEN 24 WHEN gap <= 72 THEN 7 ELSE 4 END AS period FROM g WHERE gap IS NOT NULL GROUP BY gap ORDER BY count(*) DESC, gap LIMIT 1""")
def infer_period(t):
    period = anomalies.infer_period(t.orders, "o_orderdate")
    return t.orders.agg(F.lit(period).alias("period"))


@query("train_model")
def train_model(t):
    df = t.documents.join(t.labels, "doc_id").select("lang", "source", "n_chars", F.length("text").alias("length"), F.col("quality").alias("label"))
    result = model.train_model(df, "label", trees=20)
    metrics = t.spark.createDataFrame([(k, float(v)) for k, v in result["metrics"].items()], "name string, value double")
    return metrics.unionByName(result["importance"].select(F.concat(F.lit("importance:"), "feature").alias("name"), F.col("importance").alias("value")))

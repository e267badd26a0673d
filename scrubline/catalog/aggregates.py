"""Queries for grouping, pivots, chart data, SQL and log summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregate
from .base import query
from .missing import rounded


@query("group_by", """
SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS l_quantity_sum, round(avg(l_extendedprice), 3) AS l_extendedprice_mean,
  round(quantile_cont(l_extendedprice, 0.5), 3) AS l_extendedprice_median, count(l_orderkey) AS l_orderkey_count,
  round(stddev_samp(l_discount), 6) AS l_discount_std FROM lineitem GROUP BY ALL""")
def group_by(t):
    out = aggregate.group_by(t.lineitem, ["l_returnflag", "l_linestatus"],
                             "l_quantity:sum, l_extendedprice:mean, l_extendedprice:median, l_orderkey:count, l_discount:std")
    out = rounded(out, "l_extendedprice_mean", "l_extendedprice_median", digits=3)
    return rounded(rounded(out, "l_quantity_sum", digits=2), "l_discount_std", digits=6)


@query("pivot_table", """
SELECT l_returnflag, round(coalesce(sum(l_quantity) FILTER (l_linestatus = 'F'), 0), 2) AS "l_quantity_F",
  round(coalesce(sum(l_quantity) FILTER (l_linestatus = 'O'), 0), 2) AS "l_quantity_O" FROM lineitem GROUP BY 1""")
def pivot_table(t):
    return rounded(aggregate.pivot_table(t.lineitem, "l_returnflag", "l_linestatus", "l_quantity"), "l_quantity_F", "l_quantity_O", digits=2)


@query("unpivot", """
SELECT o_orderkey, variable, value FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END AS o_orderstatus, o_orderpriority FROM orders)
UNPIVOT (value FOR variable IN (o_orderstatus, o_orderpriority))""")
def unpivot(t):
    df = t.orders.selectExpr("o_orderkey", "CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END AS o_orderstatus", "o_orderpriority")
    return aggregate.unpivot(df, "o_orderkey")


@query("stack_columns", """
SELECT o_orderkey, 'o_orderstatus' AS variable, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END AS value FROM orders
UNION ALL SELECT o_orderkey, 'o_orderpriority', o_orderpriority FROM orders""")
def stack_columns(t):
    df = t.orders.selectExpr("o_orderkey", "CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END AS o_orderstatus", "o_orderpriority")
    return aggregate.stack_columns(df, ["o_orderstatus", "o_orderpriority"])


@query("value_distribution", """
SELECT CAST(l_partkey AS VARCHAR) AS value, count(*) AS count FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")
def value_distribution(t):
    return aggregate.value_distribution(t.lineitem, "l_partkey", 10)


@query("histogram", """
WITH m AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem),
b AS (SELECT least(CAST(floor((l_extendedprice - lo) / (hi - lo) * 8) AS INT), 7) + 1 AS bin, count(*) AS n FROM lineitem, m GROUP BY 1)
SELECT CAST(g AS INT) AS bin, round(lo + (g - 1) * (hi - lo) / 8, 4) AS lower, round(lo + g * (hi - lo) / 8, 4) AS upper, coalesce(n, 0) AS count,
  round(coalesce(n, 0) / max(n) OVER (), 6) AS height FROM range(1, 9) r(g) LEFT JOIN b ON b.bin = g, m""")
def histogram(t):
    return rounded(rounded(aggregate.histogram(t.lineitem, "l_extendedprice", 8), "lower", "upper"), "height", digits=6)


@query("timeseries_rollup", """
SELECT strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS period, round(avg(o_totalprice), 3) AS o_totalprice FROM orders GROUP BY 1""")
def timeseries_rollup(t):
    out = aggregate.timeseries_rollup(t.orders, "o_orderdate", "o_totalprice")
    return rounded(out.withColumn("period", F.date_format("period", "yyyy-MM-dd")), "o_totalprice", digits=3)


@query("missing_by_column", """
WITH s AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus END AS a, CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice END AS b FROM orders)
SELECT unnest(['o_orderkey', 'a', 'b']) AS "column", unnest([0, count(*) - count(a), count(*) - count(b)]) AS missing,
  unnest([0.0, round((count(*) - count(a)) * 100 / count(*), 4), round((count(*) - count(b)) * 100 / count(*), 4)]) AS missing_pct FROM s""")
def missing_by_column(t):
    df = t.orders.selectExpr("o_orderkey", "CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus END AS a", "CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice END AS b")
    return rounded(aggregate.missing_by_column(df), "missing_pct")


SQL_TEXT = """
WITH big AS (SELECT o_custkey, sum(o_totalprice) AS total FROM df GROUP BY o_custkey HAVING sum(o_totalprice) > 1000000)
SELECT c.c_mktsegment, n.n_name, count(*) AS customers, round(sum(b.total), 2) AS total, grouping(n.n_name) AS all_nations
FROM big b JOIN customer c ON b.o_custkey = c.c_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey
GROUP BY GROUPING SETS ((c.c_mktsegment, n.n_name), (c.c_mktsegment))"""


@query("sql_query", SQL_TEXT.replace("FROM df", "FROM orders").replace("grouping(n.n_name) AS", "CAST(grouping(n.n_name) AS TINYINT) AS"))
def sql_query(t):
    return aggregate.sql_query(t.orders, SQL_TEXT, {"customer": t.customer, "nation": t.nation})


@query("sql_query_full", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 0")
def sql_query_full(t):
    return aggregate.sql_query(t.lineitem, "SELECT l_orderkey, l_linenumber FROM df WHERE l_quantity > 0")


@query("sql_set_operations", """
SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'
EXCEPT SELECT c_custkey FROM customer WHERE c_mktsegment = 'FURNITURE'""")
def sql_set_operations(t):
    return aggregate.sql_query(t.orders, """
        SELECT o_custkey AS k FROM df WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM df WHERE o_orderpriority = '1-URGENT'
        EXCEPT SELECT c_custkey FROM customer WHERE c_mktsegment = 'FURNITURE'""", {"customer": t.customer})


@query("event_query", """
SELECT event_id, event_type, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts FROM events
WHERE event_type IN ('error', 'view') AND ts >= TIMESTAMP '2024-01-02' AND ts <= TIMESTAMP '2024-02-01' ORDER BY events.ts DESC, event_id DESC LIMIT 40 OFFSET 20""")
def event_query(t):
    out = aggregate.event_query(t.events, {"event_type": ["error", "view"]}, "ts", "2024-01-02 00:00:00", "2024-02-01 00:00:00", 40, 20, "event_id")
    return out.select("event_id", "event_type", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"))


@query("activity_summary", """
WITH e AS (SELECT event_type, CASE WHEN value > 50 THEN 'high' ELSE 'low' END AS status, CAST(user_id AS VARCHAR) AS actor, strftime(ts, '%Y-%m-%d') AS day FROM events),
a AS (SELECT actor, count(*) AS n FROM e GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10)
SELECT 'type' AS dimension, event_type AS value, count(*) AS n FROM e GROUP BY ALL UNION ALL SELECT 'status', status, count(*) FROM e GROUP BY ALL
UNION ALL SELECT 'day', day, count(*) FROM e GROUP BY ALL UNION ALL SELECT 'actor', actor, n FROM a""")
def activity_summary(t):
    df = t.events.withColumn("status", F.when(F.col("value") > 50, "high").otherwise("low"))
    return aggregate.activity_summary(df, {"type": "event_type", "status": "status", "actor": "user_id"}, top={"actor": 10, "type": 10})


@query("security_summary", """
SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS events, count_if(event_type = 'error') AS failures, count_if(value > 300) AS suspicious,
  count(DISTINCT user_id) AS actors, CASE WHEN count_if(value > 300) > 10 OR count_if(event_type = 'error') > 100 THEN 'high'
  WHEN count_if(value > 300) > 5 OR count_if(event_type = 'error') > 50 THEN 'medium' ELSE 'low' END AS risk_level FROM events GROUP BY 1""")
def security_summary(t):
    df = t.events.withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    tests = {"failures": F.col("event_type") == "error", "suspicious": F.col("value") > 300}
    return aggregate.security_summary(df, tests, {"actors": "user_id"}, aggregate.risk_level(F.col("failures"), F.col("suspicious")), "day")


@query("period_event_counts", """
WITH c(framework, event_type) AS (VALUES ('soc', 'signup'), ('soc', 'error'), ('iso', 'error'), ('iso', 'audit'))
SELECT framework, c.event_type, count(e.event_id) AS n FROM c LEFT JOIN events e ON e.event_type = c.event_type
  AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20' GROUP BY ALL""")
def period_event_counts(t):
    return aggregate.period_event_counts(t.events, {"soc": ["signup", "error"], "iso": ["error", "audit"]}, "event_type", "ts",
                                         "2024-01-05 00:00:00", "2024-01-20 00:00:00")


@query("change_log_summary", """
WITH l AS (SELECT event_type AS action, 'c' || user_id % 3 AS "column", CASE WHEN event_id % 2 = 0 THEN 'user' ELSE 'auto' END AS trigger,
  event_id % 4 AS rows_removed, event_id % 7 AS cells_changed FROM events)
SELECT dimension, value, count(*) AS entries, sum(rows_removed)::BIGINT AS rows_removed, sum(cells_changed)::BIGINT AS cells_changed FROM (
  SELECT 'action' AS dimension, action AS value, * FROM l UNION ALL SELECT 'column', "column", * FROM l UNION ALL SELECT 'trigger', trigger, * FROM l) GROUP BY ALL""")
def change_log_summary(t):
    log = t.events.selectExpr("event_type AS action", "'c' || user_id % 3 AS column", "CASE WHEN event_id % 2 = 0 THEN 'user' ELSE 'auto' END AS trigger",
                              "event_id % 4 AS rows_removed", "event_id % 7 AS cells_changed")
    return aggregate.change_log_summary(log)

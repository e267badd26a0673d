"""Queries for pipelines and cleaning programs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.fields import domain_clean as clean_domain
from ..plans import pipeline, programs
from .base import query
from .missing import rounded
from .profiling import dirty
from .texts import title_sql

TWICE = """SELECT c_mktsegment, c_nationkey, CASE c_custkey % 4 WHEN 0 THEN lower(c_mktsegment) WHEN 1 THEN ' ' || c_mktsegment ELSE c_mktsegment END AS segment,
 CASE WHEN c_custkey % 6 = 0 THEN '--' ELSE 'Kind ' || c_custkey % 3 END AS kind FROM customer"""


def twice(t):
    t.customer.createOrReplaceTempView("customer_twice")
    return t.spark.sql(TWICE.replace("FROM customer", "FROM customer_twice"))


@query("auto_clean", f"""
WITH d AS (SELECT DISTINCT * FROM ({TWICE})), c AS (SELECT c_nationkey, {title_sql('trim(c_mktsegment)')} AS c_mktsegment, {title_sql('trim(segment)')} AS segment, {title_sql("nullif(kind, '--')")} AS kind FROM d)
SELECT * FROM c""")
def auto_clean(t):
    return programs.auto_clean(twice(t))


@query("auto_clean_explained", f"""
WITH s AS ({TWICE}), d AS (SELECT DISTINCT * FROM s), c AS (SELECT count(*) AS n, count_if(segment <> trim(segment)) AS t,
  count_if(trim(segment) <> {title_sql('trim(segment)')}) + count_if(c_mktsegment <> {title_sql('c_mktsegment')}) AS k FROM d)
SELECT 1 AS step, 'remove_duplicates' AS action, (SELECT count(*) FROM s) AS rows_before, n AS rows_after, 0 AS cells_changed FROM c UNION ALL
SELECT 2, 'trim_whitespace', n, n, t FROM c UNION ALL SELECT 3, 'standardise_capitalisation', n, n, k FROM c UNION ALL SELECT 4, 'normalise_categories', n, n, 0 FROM c""")
def auto_clean_explained(t):
    return programs.auto_clean_explained(twice(t))[1].drop("columns")


STEPS = [
    {"action": "trim_whitespace", "params": {"columns": ["segment"]}},
    {"action": "standardise_capitalisation", "params": {"columns": ["segment"], "strategy": "upper"}},
    {"action": "no_such_action", "params": {}},
    {"action": "remove_duplicates", "params": {}},
    {"action": "group_by", "params": {"group_columns": ["segment"], "aggregations": "c_nationkey:count"}},
]


@query("run_pipeline", f"SELECT upper(trim(segment)) AS segment, count(*) AS c_nationkey_count FROM ({TWICE}) GROUP BY 1")
def run_pipeline(t):
    return pipeline.run_pipeline(twice(t), STEPS, {"dedup": False})["df"]


@query("run_single_step", f"SELECT c_mktsegment, c_nationkey, trim(segment) AS segment, kind FROM ({TWICE})")
def run_single_step(t):
    return pipeline.run_single_step(twice(t), STEPS, 0)


@query("apply_transformation", "SELECT o_orderkey, round_even(o_totalprice, 0) AS o_totalprice FROM orders")
def apply_transformation(t):
    return pipeline.apply_transformation(t.orders.select("o_orderkey", "o_totalprice"), "round_numeric", {"column": "o_totalprice", "decimals": 0})


@query("batch_clean", """
SELECT dataset, count(*) AS rows, count(name) AS names FROM (SELECT 'region' AS dataset, upper(r_name) AS name FROM region UNION ALL SELECT 'nation', upper(n_name) FROM nation) GROUP BY 1""")
def batch_clean(t):
    tables = {"region": t.region.selectExpr("r_name AS name"), "nation": t.nation.selectExpr("n_name AS name", "n_regionkey")}
    cleaned, _status = pipeline.batch_clean(tables, [{"action": "standardise_capitalisation", "params": {"strategy": "upper"}}])
    return pipeline.stack(cleaned).groupBy("dataset").agg(F.count("*").alias("rows"), F.count("name").alias("names"))


@query("domain_clean_financial", """
SELECT o_orderkey, o_totalprice AS amount, o_totalprice AS price, '****' || lpad(CAST(o_orderkey % 10000 AS VARCHAR), 4, '0') AS account_no,
  CASE o_orderkey % 3 WHEN 0 THEN 'credit' WHEN 1 THEN 'debit' ELSE 'Swap' END AS txn_type FROM orders""")
def domain_clean_financial(t):
    df = t.orders.selectExpr("o_orderkey", "'$' || format_number(o_totalprice, 2) AS amount", "'€' || format_number(o_totalprice, 2) AS price",
                             "'12-34 ' || lpad(o_orderkey % 10000, 4, '0') AS account_no",
                             "CASE o_orderkey % 3 WHEN 0 THEN 'Bank Deposit' WHEN 1 THEN ' PAYMENT out' ELSE 'swap' END AS txn_type")
    return clean_domain(df, "financial")


@query("domain_clean_logistics", """
SELECT l_orderkey, l_linenumber, l_partkey, 'TR' || l_orderkey AS tracking_number, round(CASE WHEN l_linenumber % 2 = 0 THEN l_quantity * 0.453592 ELSE l_quantity END, 6) AS weight,
  '1 x ' || l_linenumber AS dimensions, CASE l_returnflag WHEN 'A' THEN 'Delivered' WHEN 'N' THEN 'In Transit' ELSE 'Lost' END AS status FROM lineitem""")
def domain_clean_logistics(t):
    df = t.lineitem.selectExpr("l_orderkey", "l_linenumber", "l_partkey", "' tr-' || l_orderkey AS tracking_number", "CASE WHEN l_linenumber % 2 = 0 THEN l_quantity || ' lbs' ELSE l_quantity || 'kg' END AS weight",
                               "'1x ' || l_linenumber AS dimensions", "CASE l_returnflag WHEN 'A' THEN 'was delivered' WHEN 'N' THEN 'SHIPPED' ELSE 'lost' END AS status")
    return rounded(clean_domain(df, "logistics"), "weight", digits=6)


@query("domain_clean_hr", """
SELECT c_custkey, 'EMP-' || c_custkey AS emp_id, CASE c_custkey % 3 WHEN 0 THEN 'Human Resources' WHEN 1 THEN 'Finance' ELSE 'Legal Desk' END AS department, c_acctbal AS salary,
  CASE c_custkey % 2 WHEN 0 THEN 'Exceeds Expectations' ELSE 'Needs Improvement' END AS performance FROM customer""")
def domain_clean_hr(t):
    df = t.customer.selectExpr("c_custkey", "'emp-' || c_custkey || '!' AS emp_id", "CASE c_custkey % 3 WHEN 0 THEN 'HR' WHEN 1 THEN ' finance dep' ELSE 'legal desk' END AS department",
                               "'$' || format_number(c_acctbal, 2) AS salary", "CASE c_custkey % 2 WHEN 0 THEN 'Outstanding' ELSE 'poor' END AS performance")
    return clean_domain(df, "hr")


@query("domain_clean_iot", """
SELECT event_id, value AS reading, 'AA:BB:CC:00:11:' || upper(lpad(to_hex(user_id % 256), 2, '0')) AS mac_address, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS timestamp,
  'DEV' || user_id AS device_id, CAST(user_id % 100 AS DOUBLE) AS battery_level FROM events WHERE user_id % 100 <> 1 UNION ALL
SELECT event_id, value, 'AA:BB:CC:00:11:' || upper(lpad(to_hex(user_id % 256), 2, '0')), strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S'), 'DEV' || user_id, 100.0 FROM events WHERE user_id % 100 = 1""")
def domain_clean_iot(t):
    df = t.events.selectExpr("event_id", "string(value) AS reading", "'aa-bb-cc-00-11-' || lower(lpad(hex(user_id % 256), 2, '0')) AS mac_address", "string(unix_seconds(timestamp(ts))) AS timestamp",
                             "'dev_' || user_id AS device_id", "user_id % 100 || '%' AS battery_level")
    return rounded(clean_domain(df, "iot"), "battery_level", digits=6)


@query("auto_clean_columns", """
SELECT c_custkey, 'u' || c_custkey || '@a.org' AS email, '(555) 010-' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') AS phone, CASE c_custkey % 3 WHEN 0 THEN 'Female' WHEN 1 THEN 'Male' ELSE 'Other' END AS gender,
  CASE c_custkey % 2 WHEN 0 THEN 'Inactive' ELSE 'Active' END AS status, c_custkey % 2 = 0 AS opted, CAST(c_custkey % 50 AS DOUBLE) AS share FROM customer""")
def auto_clean_columns(t):
    df = t.customer.selectExpr("c_custkey", "' U' || c_custkey || '@A.org' AS email", "'555.010.' || lpad(c_custkey % 10000, 4, '0') AS phone", "CASE c_custkey % 3 WHEN 0 THEN 'female' WHEN 1 THEN 'M' ELSE 'x' END AS gender",
                               "CASE c_custkey % 2 WHEN 0 THEN 'INACTIVE' ELSE 'active now' END AS status", "CASE c_custkey % 2 WHEN 0 THEN 'Yes' ELSE 'No' END AS opted", "c_custkey % 50 || '%' AS share")
    return programs.auto_clean_columns(df)


@query("smart_auto_clean")
def smart_auto_clean(t):
    return programs.smart_auto_clean(dirty(t))["df"]


@query("deep_clean")
def deep_clean(t):
    return programs.deep_clean(dirty(t))[0]


@query("deep_clean_scores")
def deep_clean_scores(t):
    return programs.deep_clean(dirty(t))[1]

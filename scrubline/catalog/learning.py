"""Queries for rule mining over all tables as a dataset collection."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.profile import detect_domain
from ..plans import learning, programs
from .base import query
from .missing import rounded

NAMES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def cells(t):
    return learning.long_table({n: getattr(t, n) for n in NAMES})


def feature_sql(table: str, c: str) -> str:
    return (f"""SELECT '{table}' AS dataset, '{c}' AS "column", count(*) AS rows, round((count(*) - count({c})) / count(*), 6) AS null_share, count(DISTINCT {c}) AS unique_count,
  CASE WHEN count(DISTINCT {c}) <= 10 THEN 'low' WHEN count(DISTINCT {c}) <= 100 THEN 'medium' ELSE 'high' END AS cardinality FROM {table}""")


COLUMNS = {
    "region": ["r_regionkey", "r_name"], "nation": ["n_nationkey", "n_name", "n_regionkey"],
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"], "supplier": ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"],
    "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"],
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"], "labels": ["doc_id", "quality", "toxic"],
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"],
    "events": ["event_id", "ts", "user_id", "event_type", "value", "props"], "documents": ["doc_id", "text", "lang", "source", "n_chars"],
    "embeddings": ["vec_id", "embedding", "label"], "pages": ["page_id", "url", "html"], "benchmark": ["item_id", "text"], "conversations": ["conv_id", "turn", "role", "text"],
}


@query("extract_dataset_features", " UNION ALL ".join(feature_sql(n, c) for n, cs in COLUMNS.items() for c in cs))
def extract_dataset_features(t):
    out = learning.extract_dataset_features(cells(t)).select("dataset", "column", "rows", "null_share", "unique_count", "cardinality")
    return rounded(out, "null_share", digits=6)


@query("mine_rules")
def mine_rules(t):
    features = learning.extract_dataset_features(cells(t))
    domains = detect_domain(features.select("dataset", "column"))
    return learning.mine_rules(features, domains)


@query("match_rules")
def match_rules(t):
    features = learning.extract_dataset_features(cells(t))
    return learning.match_rules(learning.mine_rules(features), features)


STEP_SQL = """SELECT CASE WHEN user_id % 2 = 0 THEN 'sales' ELSE 'hr' END AS domain, event_type AS action, CASE event_id % 4 WHEN 0 THEN 'Unit Price' WHEN 1 THEN 'email' WHEN 2 THEN 'other' ELSE '' END AS "column",
 event_id % 5 AS cells_affected FROM events"""


def step_log(t):
    return t.events.selectExpr(
        "CASE WHEN user_id % 2 = 0 THEN 'sales' ELSE 'hr' END AS domain", "event_type AS action",
        "CASE event_id % 4 WHEN 0 THEN 'Unit Price' WHEN 1 THEN 'email' WHEN 2 THEN 'other' ELSE '' END AS column", "event_id % 5 AS cells_affected")


@query("learn_rules", f"""
WITH s AS ({STEP_SQL}), r AS (SELECT action || ':' || regexp_replace(lower("column"), '[^a-z0-9]', '_', 'g') AS pattern, action, CASE "column" WHEN 'email' THEN 'email' WHEN 'Unit Price' THEN 'price' ELSE 'other' END AS column_pattern,
  min(domain) AS domain, count(*) AS times_applied, CASE WHEN max(cells_affected) > 0 THEN 0.8 ELSE 0.5 END AS success_rate FROM s WHERE "column" <> '' GROUP BY ALL)
SELECT *, round(CASE WHEN times_applied >= 10 THEN least(0.95, 0.5 + times_applied * 0.02) WHEN times_applied >= 5 THEN least(0.85, 0.4 + times_applied * 0.04) ELSE 0.5 END, 4)::DOUBLE AS confidence FROM r""")
def learn_rules(t):
    return rounded(learning.learn_rules(step_log(t)), "confidence")


@query("suggest_rules", f"""
WITH s AS ({STEP_SQL}), p AS (SELECT "column" AS c, action, count(*) AS n FROM s GROUP BY ALL), r AS (SELECT *, CASE WHEN n >= 10 THEN least(0.95, 0.5 + n * 0.02) WHEN n >= 5 THEN 0.4 + n * 0.04 ELSE 0.5 END AS f FROM p),
b AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY c ORDER BY f DESC, n DESC, action DESC) = 1)
SELECT 'part' AS dataset, CASE c WHEN 'other' THEN 'p_size' ELSE 'p_retailprice' END AS "column", action AS suggested_action, n AS based_on FROM b WHERE c IN ('other', 'Unit Price')""")
def suggest_rules(t):
    columns = t.spark.createDataFrame([("part", c) for c in ("p_size", "p_retailprice")], "dataset string, column string")
    return learning.suggest_rules(learning.learn_rules(step_log(t)), columns).drop("confidence")


@query("rule_outcomes", """
SELECT event_type || user_id % 7 AS rule, count(*) AS uses, round(avg((value > 10)::INT), 6) AS success_rate, CASE WHEN avg((value > 10)::INT) < 0.7 THEN 'disable' WHEN avg((value > 10)::INT) > 0.95 THEN 'auto_apply' ELSE 'keep' END AS suggestion
FROM events GROUP BY 1 HAVING count(*) >= 5""")
def rule_outcomes(t):
    out = learning.rule_outcomes(t.events.selectExpr("event_type || user_id % 7 AS rule", "value > 10 AS succeeded"))
    return rounded(out, "success_rate", digits=6)


@query("report_analytics", """
WITH r AS (SELECT CASE WHEN user_id % 2 = 0 THEN 'sales' ELSE 'hr' END AS domain, event_type, value, event_id FROM events)
SELECT 'domain' AS topic, domain AS key, count(*)::DOUBLE AS count FROM r GROUP BY 2 UNION ALL SELECT 'issue', event_type, count(*) FROM r GROUP BY 2 UNION ALL
SELECT 'issue_column', 'c' || event_id % 3, count(*) FROM r GROUP BY 2 UNION ALL SELECT 'action', event_type, count(*) FROM r GROUP BY 2 UNION ALL
SELECT 'action_by_domain', domain || ':' || event_type, count(*) FROM r GROUP BY 2 UNION ALL SELECT 'quality', 'initial', round(avg(value), 4) FROM r UNION ALL SELECT 'quality', 'final', round(avg(value / 2), 4) FROM r
UNION ALL SELECT 'quality', 'low', count_if(value / 2 < 70) FROM r UNION ALL SELECT 'null_column', 'x', count(*) FROM r""")
def report_analytics(t):
    item = F.struct(F.col("event_type").alias("issue_type"), F.expr("'c' || event_id % 3").alias("column"))
    step = F.struct(F.col("event_type").alias("action"), F.expr("'c' || event_id % 3").alias("column"))
    reports = t.events.select(
        F.expr("CASE WHEN user_id % 2 = 0 THEN 'sales' ELSE 'hr' END").alias("domain"), F.col("value").alias("initial_score"), (F.col("value") / 2).alias("final_score"),
        F.array(item).alias("issues"), F.array(step).alias("steps"), F.create_map(F.lit("x"), F.lit(1).cast("long"), F.lit("y"), F.lit(0).cast("long")).alias("null_counts"))
    return rounded(learning.report_analytics(reports), "count")


@query("apply_learned_rules", """
SELECT p_partkey, upper(p_brand[1]) || lower(p_brand[2:]) AS p_brand, p_retailprice AS p_retailprice FROM part""")
def apply_learned_rules(t):
    rules = t.spark.createDataFrame([("sales", "price", "extract_numeric", 0.9), ("general", "brand", "standardise_capitalisation", 0.8), ("hr", "price", "drop_column", 0.9), ("sales", "id", "drop_column", 0.2)],
                                    "domain string, column_pattern string, action string, confidence double")
    df = t.part.selectExpr("p_partkey", "upper(p_brand) AS p_brand", "'USD ' || p_retailprice AS p_retailprice")
    return programs.apply_learned_rules(df, "sales", rules)

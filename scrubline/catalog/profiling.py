"""Queries for profiles, issues and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import issues, profile
from ..plans import learning
from .base import query
from .learning import cells
from .missing import rounded

DIRTY = """SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN lower(c_mktsegment) WHEN 1 THEN ' ' || c_mktsegment ELSE c_mktsegment END AS segment,
 CASE WHEN c_custkey % 6 <> 0 THEN CASE WHEN c_custkey % 7 = 0 THEN 'nobody' ELSE 'u' || c_custkey || '@a.org' END END AS email,
 CASE WHEN c_custkey % 3 = 0 THEN 'n/a' ELSE CAST(c_custkey % 50 AS {text}) END AS mixed, c_acctbal - 5000 AS balance_amount, 'x' AS same FROM customer"""
DIRTY_SQL = DIRTY.format(text="VARCHAR")


def dirty(t):
    t.customer.createOrReplaceTempView("customer_dirty")
    return t.spark.sql(DIRTY.format(text="STRING").replace("FROM customer", "FROM customer_dirty"))


def number_profile(table: str, c: str) -> str:
    return f"""SELECT '{c}' AS "column", count(*) AS rows, count(*) - count({c}) AS missing, count(DISTINCT {c}) AS "distinct", CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max,
 round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, round(quantile_cont({c}, 0.05), 3) AS p5, round(quantile_cont({c}, 0.25), 3) AS p25,
 round(quantile_cont({c}, 0.5), 3) AS median, round(quantile_cont({c}, 0.75), 3) AS p75, round(quantile_cont({c}, 0.95), 3) AS p95 FROM {table}"""


@query("profile_dataset", " UNION ALL ".join(number_profile("lineitem", c) for c in ("l_partkey", "l_quantity", "l_extendedprice", "l_discount")) + """
 UNION ALL SELECT 'l_returnflag', count(*), 0, count(DISTINCT l_returnflag), NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM lineitem""")
def profile_dataset(t):
    df = t.lineitem.select("l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag")
    out = profile.profile_dataset(df).drop("whitespace", "numeric_like", "dtype", "missing_pct")
    return rounded(rounded(out, "mean", "std"), "p5", "p25", "median", "p75", "p95", digits=3)


@query("profile_text_columns", rf"""
WITH s AS ({DIRTY_SQL})
SELECT 'segment' AS "column", count(*) AS rows, count(*) - count(segment) AS missing, count(DISTINCT segment) AS "distinct", count_if(segment <> trim(segment) OR contains(segment, '  ')) AS whitespace,
  count_if(regexp_matches(segment, '^-?\d*\.?\d*$') AND regexp_matches(segment, '\d')) AS numeric_like FROM s
UNION ALL SELECT 'mixed', count(*), count(*) - count(mixed), count(DISTINCT mixed), 0, count_if(regexp_matches(mixed, '^-?\d*\.?\d*$') AND regexp_matches(mixed, '\d')) FROM s
UNION ALL SELECT 'email', count(*), count(*) - count(email), count(DISTINCT email), 0, 0 FROM s""")
def profile_text_columns(t):
    out = profile.profile_dataset(dirty(t).select("segment", "mixed", "email"))
    return out.select("column", "rows", "missing", "distinct", "whitespace", "numeric_like")


@query("top_values", """
SELECT * FROM (SELECT 'o_orderstatus' AS "column", o_orderstatus AS value, count(*) AS count FROM orders GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 3) UNION ALL
SELECT * FROM (SELECT 'o_custkey', CAST(o_custkey AS VARCHAR) AS v, count(*) AS n FROM orders GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 3)""")
def top_values(t):
    return profile.top_values(t.orders, ["o_orderstatus", "o_custkey"], 3)


@query("profile_with_sampling")
def profile_with_sampling(t):
    return profile.profile_with_sampling(t.orders, 5000)


@query("detect_semantic_type", f"""
SELECT * FROM (VALUES ('c_custkey', 'numeric'), ('segment', 'text'), ('email', 'email'), ('mixed', 'text'), ('balance_amount', 'numeric'), ('same', 'text')) v("column", semantic_type)
WHERE (SELECT count(*) FROM ({DIRTY_SQL})) > 0""")
def detect_semantic_type(t):
    return profile.detect_semantic_type(dirty(t))


@query("column_profile")
def column_profile(t):
    return profile.column_profile(dirty(t))


@query("infer_schema", rf"""
WITH s AS ({DIRTY_SQL}), u AS (SELECT strftime(o_orderdate, '%d/%m/%Y') AS d, CAST(o_custkey AS VARCHAR) AS n, CAST(o_totalprice AS VARCHAR) AS f,
  CASE WHEN o_orderkey % 2 = 0 THEN 'yes' ELSE 'no' END AS b, o_orderpriority AS p FROM orders)
SELECT 'd' AS "column", 'date' AS inferred_type, 1.0::DOUBLE AS confidence FROM u HAVING count(*) > 0 UNION ALL SELECT 'n', 'int', 1.0 UNION ALL SELECT 'f', 'float', 1.0 UNION ALL SELECT 'b', 'bool', 1.0
UNION ALL SELECT 'p', 'currency', 1.0 UNION ALL SELECT 'url', 'url', 1.0""")
def infer_schema(t):
    df = t.orders.selectExpr("date_format(o_orderdate, 'dd/MM/yyyy') AS d", "string(o_custkey) AS n", "string(o_totalprice) AS f", "CASE WHEN o_orderkey % 2 = 0 THEN 'yes' ELSE 'no' END AS b", "o_orderpriority AS p")
    return profile.infer_schema(df).unionByName(profile.infer_schema(t.pages, "url"))


@query("infer_and_cast", """
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS d, o_custkey AS n, o_totalprice AS f, o_orderkey % 2 = 0 AS b, o_orderpriority AS p FROM orders""")
def infer_and_cast(t):
    return profile.infer_and_cast(t.orders.selectExpr("o_orderkey", "date_format(o_orderdate, 'MMM d, yyyy') AS d", "string(o_custkey) AS n", "string(o_totalprice) AS f",
                                                      "CASE WHEN o_orderkey % 2 = 0 THEN 'yes' ELSE 'no' END AS b", "o_orderpriority AS p"))


@query("detect_pattern_type", rf"""
WITH s AS ({DIRTY_SQL})
SELECT 'mixed' AS "column", 'mixed' AS pattern_type, round(count_if(regexp_matches(mixed, '^-?\d+\.?\d*$')) / count(*), 6) AS share FROM s
UNION ALL SELECT 'email', 'email', round(count_if(contains(email, '@')) / count(email), 6) FROM s UNION ALL SELECT 'segment', 'unstructured', 0 FROM s HAVING count(*) > 0""")
def detect_pattern_type(t):
    return rounded(profile.detect_pattern_type(dirty(t), ["mixed", "email", "segment"]), "share", digits=6)


@query("detect_issues", rf"""
WITH s AS ({DIRTY_SQL}), n AS (SELECT count(*) AS n FROM s)
SELECT 'constant_column' AS type, 'medium' AS severity, count(*) AS count, 'same' AS "column" FROM s
UNION ALL SELECT 'missing_values', 'medium', count(*) - count(email), 'email' FROM s
UNION ALL SELECT 'invalid_email', 'medium', count_if(email = 'nobody'), 'email' FROM s
UNION ALL SELECT 'extra_whitespace', 'low', count_if(segment <> trim(segment)), 'segment' FROM s
UNION ALL SELECT 'capitalisation_inconsistency', 'medium', count(DISTINCT trim(segment)) - count(DISTINCT lower(trim(segment))), 'segment' FROM s
UNION ALL SELECT 'category_inconsistency', 'medium', count(DISTINCT segment) - count(DISTINCT lower(trim(segment))), 'segment' FROM s
UNION ALL SELECT 'mixed_data_types', 'high', count_if(mixed = 'n/a'), 'mixed' FROM s
UNION ALL SELECT 'negative_in_positive_col', 'high', count_if(balance_amount < 0), 'balance_amount' FROM s""")
def detect_issues(t):
    return issues.detect_issues(dirty(t)).drop("fix_action")


@query("find_dirty_patterns", rf"""
WITH s AS ({DIRTY_SQL})
SELECT 'mixed' AS "column", round(avg((mixed = 'n/a')::INT), 6) AS dirty_null, round(avg(regexp_matches(mixed, '[a-z]')::INT), 6) AS lower_case, round(avg(regexp_matches(mixed, '^\d+$')::INT), 6) AS numeric_text FROM s
UNION ALL SELECT 'segment', 0, round(avg((segment = lower(segment))::INT), 6), 0 FROM s""")
def find_dirty_patterns(t):
    out = issues.find_dirty_patterns(dirty(t).select("mixed", "segment")).select("column", "dirty_null", "lower_case", "numeric_text")
    return rounded(out, "dirty_null", "lower_case", "numeric_text", digits=6)


@query("health_score", rf"""
WITH s AS ({DIRTY_SQL}), m AS (SELECT round(least((count(*) - count(email)) / (count(*) * 6.0) * 30, 30), 2) AS miss, count(email) AS e, count_if(email = 'nobody') AS bad, count(*) AS n, count_if(balance_amount < 0) AS neg FROM s),
p AS (SELECT miss + 4.0 * 0.6 + round(least(least(bad / e, 1) * 6.0 * 0.6, 6), 2) + 0.13 + 1.0 * 0.6 + 2.5 * 0.6 + 4.0 + round(least(neg / n * 5.0, 5), 2) AS p FROM m)
SELECT round(100 - p, 1)::DOUBLE AS score, CASE WHEN 100 - p >= 90 THEN 'A' WHEN 100 - p >= 80 THEN 'B' ELSE 'C' END AS grade FROM p""")
def health_score(t):
    return issues.health_score(dirty(t))


@query("score_deductions")
def score_deductions(t):
    return issues.score_deductions(dirty(t))


@query("quality_score", """
SELECT round(100 - (count(*) - count(CASE WHEN o_orderkey % 4 <> 0 THEN 1 END)) / count(*) / 3 * 30, 4) AS simple FROM orders""")
def quality_score(t):
    df = t.orders.selectExpr("o_orderkey", "CASE WHEN o_orderkey % 4 <> 0 THEN o_orderpriority END AS prio", "o_totalprice")
    return rounded(issues.quality_score(df), "simple").select("simple")


@query("quality_score_weighted")
def quality_score_weighted(t):
    return issues.quality_score(dirty(t))


@query("recommend_fixes", f"""
SELECT * FROM (VALUES ('drop_constant_columns', 'same', 'medium', 0.9::DOUBLE), ('fill_missing', 'email', 'high', 0.85), ('flag_invalid_emails', 'email', 'medium', 0.9), ('trim_whitespace', 'segment', 'low', 0.9),
 ('standardise_capitalisation', 'segment', 'medium', 0.8), ('normalise_categories', 'segment', 'medium', 0.8), ('coerce_numeric', 'mixed', 'high', 0.75), ('clip_outliers', 'balance_amount', 'high', 0.8)) v(action, "column", priority, confidence)
WHERE (SELECT count(*) FROM ({DIRTY_SQL})) > 0""")
def recommend_fixes(t):
    return issues.recommend_fixes(issues.detect_issues(dirty(t))).drop("params")


@query("detect_domain")
def detect_domain(t):
    """Domains of all tables, from the names and sizes that a pass over their cells finds."""
    features = learning.extract_dataset_features(cells(t)).select("dataset", "column", "rows")
    sizes = features.groupBy("dataset").agg(F.max("rows").alias("rows"))
    return profile.detect_domain(features.select("dataset", "column")).join(sizes, "dataset")

"""Queries for filters, paging and sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import rows
from .base import query


@query("drop_rows_where", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'F'")
def drop_rows_where(t):
    return rows.drop_rows_where(t.orders.select("o_orderkey", "o_orderstatus"), "o_orderstatus", "F")


@query("drop_rows_matching", """
SELECT o_orderkey, o_orderpriority FROM orders WHERE NOT regexp_matches(o_orderpriority, '(?i)urgent|low')""")
def drop_rows_matching(t):
    return rows.drop_rows_matching(t.orders.select("o_orderkey", "o_orderpriority"), "o_orderpriority",
                                   "urgent|low", flags="i")


@query("filter_rows", """
SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 100000 AND contains(lower(o_orderpriority), 'high')""")
def filter_rows(t):
    df = rows.filter_rows(t.orders, "o_totalprice", ">=", "100000")
    return rows.filter_rows(df, "o_orderpriority", "contains", "HIGH").select("o_orderkey", "o_totalprice")


HOLES = """SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderstatus END AS a,
 CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice END AS b, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey END AS c FROM orders"""


def holes(t):
    return t.orders.selectExpr(
        "o_orderkey", "CASE WHEN o_orderkey % 3 <> 0 THEN o_orderstatus END AS a",
        "CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice END AS b",
        "CASE WHEN o_orderkey % 2 = 0 THEN o_custkey END AS c")


@query("filter_nulls", f"WITH s AS ({HOLES}) SELECT * FROM s WHERE a IS NOT NULL AND b IS NOT NULL")
def filter_nulls(t):
    return rows.filter_nulls(holes(t), ["a", "b"], "any")


@query("drop_rows_missing_threshold", f"""
WITH s AS ({HOLES}) SELECT * FROM s
WHERE 1 + (a IS NOT NULL)::INT + (b IS NOT NULL)::INT + (c IS NOT NULL)::INT >= 3""")
def drop_rows_missing_threshold(t):
    return rows.drop_rows_missing_threshold(holes(t), 0.25)


@query("outlier_remove", """
WITH f AS (SELECT quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.75) AS q3 FROM lineitem)
SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem, f
WHERE l_extendedprice BETWEEN q1 - 0.5 * (q3 - q1) AND q3 + 0.5 * (q3 - q1)""")
def outlier_remove(t):
    df = t.lineitem.select("l_orderkey", "l_linenumber", "l_extendedprice")
    return rows.outlier_remove(df, "l_extendedprice", "iqr", 0.5)


@query("page_rows", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 50 OFFSET 100")
def page_rows(t):
    return rows.page_rows(t.orders.select("o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"], 100, 150)


@query("preview")
def preview(t):
    return rows.preview(t.lineitem, 100)


@query("sample_random", "SELECT CAST(50 AS BIGINT) AS n, CAST(50 AS BIGINT) AS known")
def sample_random(t):
    sample = rows.sample_random(t.orders, n=50, keys="o_orderkey")
    known = sample.join(t.orders.select("o_orderkey"), "o_orderkey", "left_semi")
    return known.agg(F.count("*").alias("n"), F.count_distinct("o_orderkey").alias("known"))


@query("sample_stratified", "SELECT o_orderpriority, CAST(10 AS BIGINT) AS n FROM orders GROUP BY 1")
def sample_stratified(t):
    sample = rows.sample_stratified(t.orders, "o_orderpriority", 10, keys="o_orderkey")
    return sample.groupBy("o_orderpriority").agg(F.count("*").alias("n"))


@query("smart_sample", """
SELECT o_orderstatus, greatest(1, CAST(floor(1000.0 * count(*) / (SELECT count(*) FROM orders)) AS BIGINT)) AS n
FROM orders GROUP BY 1""")
def smart_sample(t):
    sample = rows.smart_sample(t.orders, 1000, "o_orderstatus", keys="o_orderkey")
    return sample.groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query("train_test_split", "SELECT count(*) AS n, true AS near_share, CAST(0 AS BIGINT) AS shared FROM lineitem")
def train_test_split(t):
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"]
    train, test = rows.split_frames(t.lineitem, 0.2, keys=keys)
    tagged = train.select(*keys, F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(
        test.select(*keys, F.lit(0).alias("a"), F.lit(1).alias("b")))
    per_key = tagged.groupBy(*keys).agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    share = F.sum("b") / F.sum(F.col("a") + F.col("b"))
    return per_key.agg(F.sum(F.col("a") + F.col("b")).alias("n"), share.between(0.18, 0.22).alias("near_share"),
                       F.count_if((F.col("a") > 0) & (F.col("b") > 0)).alias("shared"))


@query("top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 20")
def top_k(t):
    return rows.top_k(t.orders.select("o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"], 20)

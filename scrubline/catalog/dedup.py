"""Queries for exact and fuzzy duplicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dedup, profile
from .base import query


@query("remove_duplicates", "SELECT DISTINCT l_partkey, l_returnflag FROM lineitem")
def remove_duplicates(t):
    return dedup.remove_duplicates(t.lineitem.select("l_partkey", "l_returnflag"))


@query("remove_duplicates_subset", """
SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1""")
def remove_duplicates_subset(t):
    df = t.orders.select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate")
    return dedup.remove_duplicates(df, "o_custkey", order_by=["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query("remove_all_copies", """
SELECT o_custkey, o_orderstatus FROM orders GROUP BY ALL HAVING count(*) = 1""")
def remove_all_copies(t):
    return dedup.remove_duplicates(t.orders.select("o_custkey", "o_orderstatus"), keep=False)


@query("dedupe_by_key", """
SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1""")
def dedupe_by_key(t):
    return dedup.dedupe_by_key(t.orders.select("o_custkey", "o_orderkey", "o_totalprice"), "o_custkey", "o_totalprice", order_by="o_orderkey")


@query("duplicate_report", """
WITH g AS (SELECT count(*) AS n FROM lineitem GROUP BY l_partkey, l_returnflag)
SELECT sum(n)::BIGINT AS rows, sum(n - 1)::BIGINT AS duplicate_rows, count_if(n > 1) AS duplicate_groups, round(sum(n - 1) * 100 / sum(n), 2) AS duplicate_pct FROM g""")
def duplicate_report(t):
    return profile.duplicate_report(t.lineitem, ["l_partkey", "l_returnflag"])


@query("flag_duplicate_ids", """
SELECT 'o_orderkey' AS "column", count(*) AS rows, count(DISTINCT o_orderkey) AS "distinct", 1 - count(DISTINCT o_orderkey) / count(*) AS duplicate_share FROM orders
UNION ALL SELECT 'o_custkey', count(*), count(DISTINCT o_custkey), 1 - count(DISTINCT o_custkey) / count(*) FROM orders""")
def flag_duplicate_ids(t):
    return dedup.flag_duplicate_ids(t.orders)


def parts(t):
    """Part names and brands with misspellings."""
    return t.part.selectExpr("p_partkey", "CASE p_partkey % 4 WHEN 0 THEN replace(p_name, 'e', 'ee') WHEN 1 THEN upper(p_name) ELSE p_name END AS name", "p_type")


@query("find_fuzzy_duplicates")
def find_fuzzy_duplicates(t):
    return dedup.find_fuzzy_duplicates(parts(t), ["name", "p_type"], 85, "p_partkey")


@query("remove_fuzzy_duplicates")
def remove_fuzzy_duplicates(t):
    return dedup.remove_fuzzy_duplicates(parts(t), ["name", "p_type"], 85, "p_partkey")


@query("fuzzy_dedup_blocked")
def fuzzy_dedup_blocked(t):
    return dedup.fuzzy_dedup_blocked(parts(t), ["name"], 80, "p_type", "p_partkey")


@query("fuzzy_match_merge")
def fuzzy_match_merge(t):
    return dedup.fuzzy_match_merge(parts(t), "name", 85, strategy="map")


@query("fuzzy_find_replace")
def fuzzy_find_replace(t):
    return dedup.fuzzy_find_replace(parts(t), "name", {"Cold Widget": "widget (cold)", "small bolt": "bolt (small)", "large gear": "gear"}, 90)


@query("calculate_similarity")
def calculate_similarity(t):
    df = parts(t)
    for method in ("ratio", "partial", "token_sort", "token_set"):
        df = dedup.calculate_similarity(df, "name", "p_type", method, method)
    return df.withColumns({m: F.round(m, 6) for m in ("ratio", "partial", "token_sort", "token_set")})

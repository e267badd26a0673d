"""Queries for numeric transforms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import numeric
from .base import query
from .missing import rounded

KEYS = ["l_orderkey", "l_linenumber", "l_partkey"]


def prices(t):
    return t.lineitem.select(*KEYS, "l_extendedprice")


@query("clip_outliers", """
WITH q AS (SELECT quantile_cont(l_extendedprice, 0.25) AS a, quantile_cont(l_extendedprice, 0.75) AS b FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, round(least(greatest(l_extendedprice, a - 0.25 * (b - a)), b + 0.25 * (b - a)), 3) AS l_extendedprice FROM lineitem, q""")
def clip_outliers(t):
    return rounded(numeric.clip_outliers(prices(t), "l_extendedprice", iqr_factor=0.25), "l_extendedprice", digits=3)


@query("replace_outliers", """
WITH m AS (SELECT avg(l_extendedprice) AS a, stddev_samp(l_extendedprice) AS s FROM lineitem),
r AS (SELECT quantile_cont(l_extendedprice, 0.5) AS q FROM lineitem, m WHERE abs(l_extendedprice - a) <= s)
SELECT l_orderkey, l_linenumber, l_partkey, round(CASE WHEN abs(l_extendedprice - a) > s THEN q ELSE l_extendedprice END, 3) AS l_extendedprice FROM lineitem, m, r""")
def replace_outliers(t):
    out = numeric.replace_outliers(prices(t), "l_extendedprice", "zscore", "median", z_threshold=1.0)
    return rounded(out, "l_extendedprice", digits=3)


@query("winsorize", """
WITH q AS (SELECT quantile_cont(l_extendedprice, 0.05) AS a, quantile_cont(l_extendedprice, 0.95) AS b FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, round(least(greatest(l_extendedprice, a), b), 3) AS l_extendedprice FROM lineitem, q""")
def winsorize(t):
    return rounded(numeric.winsorize(prices(t), "l_extendedprice"), "l_extendedprice", digits=3)


@query("clip_sigma", """
WITH m AS (SELECT avg(l_extendedprice) AS a, stddev_samp(l_extendedprice) AS s FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, round(least(greatest(l_extendedprice, a - s), a + s), 3) AS l_extendedprice FROM lineitem, m""")
def clip_sigma(t):
    return rounded(numeric.clip_sigma(prices(t), "l_extendedprice", 1), "l_extendedprice", digits=3)


@query("round_numeric", "SELECT l_orderkey, l_linenumber, l_partkey, round_even(l_quantity / 4, 0) AS q FROM lineitem")
def round_numeric(t):
    return numeric.round_numeric(t.lineitem.select(*KEYS, (F.col("l_quantity") / 4).alias("q")), "q", 0)


@query("scale_numeric", """
SELECT l_orderkey, l_linenumber, l_partkey, round((l_extendedprice - min(l_extendedprice) OVER ()) / (max(l_extendedprice) OVER () - min(l_extendedprice) OVER ()), 6) AS l_extendedprice FROM lineitem""")
def scale_numeric(t):
    return rounded(numeric.scale_numeric(prices(t), "l_extendedprice"), "l_extendedprice", digits=6)


@query("normalize", """
WITH q AS (SELECT quantile_cont(l_extendedprice, 0.25) AS a, quantile_cont(l_extendedprice, 0.5) AS m, quantile_cont(l_extendedprice, 0.75) AS b FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, round((l_extendedprice - m) / (b - a), 6) AS l_extendedprice FROM lineitem, q""")
def normalize(t):
    return rounded(numeric.normalize(prices(t), "l_extendedprice", "robust"), "l_extendedprice", digits=6)


@query("zscore_normalize", """
WITH m AS (SELECT avg(l_extendedprice) AS a, stddev_samp(l_extendedprice) AS s FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, round((l_extendedprice - a) / s, 6) AS z FROM lineitem, m""")
def zscore_normalize(t):
    return rounded(numeric.zscore_normalize(prices(t), "l_extendedprice", "z"), "z", digits=6).drop("l_extendedprice")


@query("box_cox_transform")
def box_cox_transform(t):
    return rounded(numeric.box_cox_transform(prices(t), "l_extendedprice", "b"), "b", digits=6)


@query("bin_numeric", """
WITH m AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders),
q AS (SELECT quantile_cont(o_totalprice, [0.25, 0.5, 0.75]) AS e FROM orders)
SELECT o_orderkey, CASE WHEN o_totalprice <= lo + (hi - lo) / 3 THEN 'low' WHEN o_totalprice <= lo + 2 * ((hi - lo) / 3) THEN 'mid' ELSE 'high' END AS width_bin,
  CASE WHEN o_totalprice <= e[1] THEN 'q1' WHEN o_totalprice <= e[2] THEN 'q2' WHEN o_totalprice <= e[3] THEN 'q3' ELSE 'q4' END AS quantile_bin FROM orders, m, q""")
def bin_numeric(t):
    df = t.orders.select("o_orderkey", "o_totalprice")
    df = numeric.bin_numeric(df, "o_totalprice", 3, labels=["low", "mid", "high"], new_col="width_bin")
    return numeric.bin_numeric(df, "o_totalprice", 4, "quantile", ["q1", "q2", "q3", "q4"], "quantile_bin").drop("o_totalprice")


@query("one_hot_encode", """
SELECT o_orderkey, o_orderstatus, (o_orderstatus = 'F')::INT AS s_F, (o_orderstatus = 'O')::INT AS s_O, (o_orderstatus = 'P')::INT AS s_P FROM orders""")
def one_hot_encode(t):
    return numeric.one_hot_encode(t.orders.select("o_orderkey", "o_orderstatus"), "o_orderstatus", "s")


@query("label_encode", """
WITH s AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderpriority END AS p FROM orders)
SELECT o_orderkey, p, CASE WHEN p IS NULL THEN -1 ELSE dense_rank() OVER (ORDER BY p NULLS LAST) - 1 END AS code FROM s""")
def label_encode(t):
    df = t.orders.selectExpr("o_orderkey", "CASE WHEN o_orderkey % 5 <> 0 THEN o_orderpriority END AS p")
    return numeric.label_encode(df, "p", "code")

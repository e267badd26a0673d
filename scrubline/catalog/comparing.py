"""Queries for joins, comparison, integrity, lineage and correlations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import compare, lineage
from .base import query
from .missing import rounded


@query("merge_dataset", """
SELECT c_mktsegment, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1""")
def merge_dataset(t):
    joined = compare.merge_dataset(t.orders, t.customer, {"o_custkey": "c_custkey"})
    return joined.groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("merge_dataset_anti", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def merge_dataset_anti(t):
    return compare.merge_dataset(t.customer, t.orders.where("o_totalprice > 300000"), {"c_custkey": "o_custkey"}, "anti").select("c_custkey")


def versions(t):
    """Two states of the order book: rows dropped, added, repeated, and cells edited."""
    base = t.orders.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")
    before = base.where("o_orderkey % 11 <> 0")
    after = base.where("o_orderkey % 13 <> 0").selectExpr(
        "o_orderkey", "o_custkey", "CASE WHEN o_orderkey % 17 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice",
        "CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE o_orderstatus END AS o_orderstatus")
    return before, after


BOTH = """b AS (SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus FROM orders WHERE o_orderkey % 11 <> 0),
a AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 17 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice,
  CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE o_orderkey % 13 <> 0)"""


@query("compare_datasets", f"""
WITH {BOTH} SELECT 'rows_before' AS fact, '' AS detail, count(*) AS count FROM b UNION ALL SELECT 'rows_after', '', count(*) FROM a
UNION ALL SELECT 'rows_new', '', count(*) FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT 'rows_removed', '', count(*) FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)
UNION ALL SELECT 'column_added', 'extra', 1""")
def compare_datasets(t):
    before, after = versions(t)
    return compare.compare_datasets(before, after.withColumn("extra", F.lit(1)))


@query("changed_rows", f"WITH {BOTH} SELECT * FROM a EXCEPT ALL SELECT * FROM b")
def changed_rows(t):
    return compare.changed_rows(*versions(t))[0]


@query("diff_by_key", f"""
WITH {BOTH}, j AS (SELECT coalesce(b.o_orderkey, a.o_orderkey) AS o_orderkey, b.o_orderkey AS kb, a.o_orderkey AS ka, b.o_totalprice AS pb, a.o_totalprice AS pa, b.o_orderstatus AS sb, a.o_orderstatus AS sa
  FROM b FULL JOIN a ON a.o_orderkey = b.o_orderkey)
SELECT o_orderkey, 'added' AS change, NULL AS "column", NULL AS before, NULL AS after FROM j WHERE kb IS NULL UNION ALL
SELECT o_orderkey, 'removed', NULL, NULL, NULL FROM j WHERE ka IS NULL UNION ALL
SELECT o_orderkey, 'changed', 'o_totalprice', CAST(round(pb, 2) AS VARCHAR), CAST(round(pa, 2) AS VARCHAR) FROM j WHERE ka = kb AND pa <> pb UNION ALL
SELECT o_orderkey, 'changed', 'o_orderstatus', sb, sa FROM j WHERE ka = kb AND sa IS DISTINCT FROM sb""")
def diff_by_key(t):
    out = compare.diff_by_key(*versions(t), "o_orderkey")
    price = F.col("column") == "o_totalprice"
    return out.withColumns({c: F.when(price, F.round(F.col(c).try_cast("double"), 2).cast("string")).otherwise(F.col(c)) for c in ("before", "after")})


@query("merge_versions", f"""
WITH {BOTH} SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, coalesce(a.o_custkey, b.o_custkey) AS o_custkey, round(coalesce(a.o_totalprice, b.o_totalprice), 2) AS o_totalprice,
  coalesce(a.o_orderstatus, b.o_orderstatus) AS o_orderstatus FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey""")
def merge_versions(t):
    before, after = versions(t)
    return rounded(compare.merge_versions(after, before, "o_orderkey", "coalesce"), "o_totalprice", digits=2)


@query("audit_step", f"""
WITH {BOTH}, j AS (SELECT a.o_totalprice AS pa, b.o_totalprice AS pb, a.o_orderstatus AS sa, b.o_orderstatus AS sb FROM a JOIN b ON a.o_orderkey = b.o_orderkey)
SELECT 'edit' AS action, (SELECT count(*) FROM b) AS rows_before, (SELECT count(*) FROM a) AS rows_after, (SELECT count(*) FROM b) - (SELECT count(*) FROM a) AS rows_removed,
  count_if(pa <> pb) + count_if(sa IS DISTINCT FROM sb) AS cells_changed FROM j""")
def audit_step(t):
    return compare.audit_step(*versions(t), "edit", "o_orderkey").select("action", "rows_before", "rows_after", "rows_removed", "cells_changed")


@query("integrity_between", """
WITH c AS (SELECT CASE WHEN o_orderkey % 10 = 0 THEN NULL WHEN o_orderkey % 10 = 1 THEN -o_custkey - 1 ELSE o_custkey END AS fk FROM orders)
SELECT CAST(0 AS BIGINT) AS duplicate_pk, count_if(fk IS NULL) AS null_fk, count_if(fk IS NOT NULL AND fk NOT IN (SELECT c_custkey FROM customer)) AS orphan_fk FROM c""")
def integrity_between(t):
    child = t.orders.selectExpr("CASE WHEN o_orderkey % 10 = 0 THEN NULL WHEN o_orderkey % 10 = 1 THEN -o_custkey - 1 ELSE o_custkey END AS fk")
    return compare.integrity_between(child, t.customer, "fk", "c_custkey")


@query("referential_integrity", """
WITH s AS (SELECT o_orderkey AS order_id, CASE WHEN o_orderkey % 4 = 0 THEN NULL WHEN o_orderkey % 4 = 1 THEN -1 ELSE o_orderkey % 100 END AS parent_id FROM orders)
SELECT 'null_fk' AS type, 'parent_id' AS "column", NULL AS ref_column, count_if(parent_id IS NULL) AS count, 'medium' AS severity FROM s
UNION ALL SELECT 'orphaned_fk', 'parent_id', 'order_id', count_if(parent_id = -1), 'high' FROM s""")
def referential_integrity(t):
    df = t.orders.selectExpr("o_orderkey AS order_id", "CASE WHEN o_orderkey % 4 = 0 THEN NULL WHEN o_orderkey % 4 = 1 THEN -1 ELSE o_orderkey % 100 END AS parent_id")
    return compare.referential_integrity(df)


@query("column_similarity", """
WITH s AS (SELECT o_custkey AS customer_id, CASE WHEN o_orderkey % 100 = 0 THEN -o_orderkey ELSE o_custkey END AS CustomerID FROM orders),
u AS (SELECT DISTINCT customer_id AS v FROM s), w AS (SELECT DISTINCT CustomerID AS v FROM s)
SELECT 'customer_id' AS column_a, 'CustomerID' AS column_b, 100.0::DOUBLE AS name_score, 100.0::DOUBLE AS combined_score, 'drop_duplicate' AS suggestion,
 round((SELECT count(*) FROM u JOIN w USING (v)) / (SELECT count(*) FROM (SELECT v FROM u UNION SELECT v FROM w)), 3) AS value_overlap""")
def column_similarity(t):
    df = t.orders.selectExpr("o_custkey AS customer_id", "CASE WHEN o_orderkey % 100 = 0 THEN -o_orderkey ELSE o_custkey END AS CustomerID", "o_orderstatus")
    return compare.column_similarity(df)


PAIRS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("correlations", " UNION ALL ".join(
    f"SELECT '{a}' AS col_a, '{b}' AS col_b, round(corr({a}, {b}), 4) AS correlation, CASE WHEN corr({a}, {b}) > 0 THEN 'positive' ELSE 'negative' END AS direction FROM lineitem"
    for i, a in enumerate(PAIRS) for b in PAIRS[i + 1:]))
def correlations(t):
    return compare.correlations(t.lineitem.select(*PAIRS), "pearson", 0.0).select("col_a", "col_b", "correlation", "direction")


@query("correlations_spearman", """
WITH r AS (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS a,
  rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0 AS b FROM lineitem)
SELECT 'l_quantity' AS col_a, 'l_extendedprice' AS col_b, round(corr(a, b), 4) AS correlation FROM r""")
def correlations_spearman(t):
    return compare.correlations(t.lineitem.select("l_quantity", "l_extendedprice"), "spearman", 0.0).select("col_a", "col_b", "correlation")


@query("correlations_cramers_v", """
WITH c AS (SELECT l_returnflag AS x, l_linestatus AS y, count(*) AS o FROM lineitem GROUP BY ALL), r AS (SELECT x, sum(o) AS rx FROM c GROUP BY 1), k AS (SELECT y, sum(o) AS cy FROM c GROUP BY 1),
n AS (SELECT sum(o) AS n FROM c), f AS (SELECT sum((coalesce(o, 0) - rx * cy / n) ** 2 / (rx * cy / n)) AS chi2 FROM r CROSS JOIN k CROSS JOIN n LEFT JOIN c ON c.x = r.x AND c.y = k.y)
SELECT 'l_returnflag' AS col_a, 'l_linestatus' AS col_b, round(sqrt(chi2 / (n * (least((SELECT count(*) FROM r), (SELECT count(*) FROM k)) - 1))), 4) AS correlation FROM f, n""")
def correlations_cramers_v(t):
    return compare.correlations(t.lineitem.select("l_returnflag", "l_linestatus"), "cramers_v", 0.0).select("col_a", "col_b", "correlation")


def flows(t):
    """Edges of a lineage graph from part to supplier shipments: part brand -> type -> supplier."""
    a = t.part.selectExpr("'b:' || p_brand AS source", "'t:' || p_type AS target").distinct()
    b = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).selectExpr("'t:' || p_type AS source", "'s:' || l_suppkey AS target").distinct()
    return a.unionByName(b)


FLOW_SQL = """e AS (SELECT DISTINCT 'b:' || p_brand AS source, 't:' || p_type AS target FROM part UNION ALL
 SELECT DISTINCT 't:' || p_type, 's:' || l_suppkey FROM lineitem JOIN part ON l_partkey = p_partkey)"""


@query("column_lineage", f"""
WITH RECURSIVE {FLOW_SQL}, w(node, depth) AS (SELECT 's:3', 0 UNION SELECT e.source, depth + 1 FROM w JOIN e ON e.target = w.node)
SELECT node, min(depth) AS depth FROM w GROUP BY 1""")
def column_lineage(t):
    return lineage.column_lineage(flows(t), "s:3")


@query("impact_analysis", f"""
WITH RECURSIVE {FLOW_SQL}, w(node, depth) AS (SELECT 'b:Brand#13', 0 UNION SELECT e.target, depth + 1 FROM w JOIN e ON e.source = w.node)
SELECT node, min(depth) AS depth FROM w GROUP BY 1""")
def impact_analysis(t):
    return lineage.impact_analysis(flows(t), "b:Brand#13")


@query("lineage_reachable", f"""
WITH RECURSIVE {FLOW_SQL}, w(start, node, depth) AS (SELECT DISTINCT source, source, 0 FROM e WHERE source LIKE 'b:%' UNION SELECT start, e.target, depth + 1 FROM w JOIN e ON e.source = w.node)
SELECT start, node, min(depth) AS depth FROM w GROUP BY ALL""")
def lineage_reachable(t):
    edges = flows(t)
    return lineage.reachable(edges, edges.where("source LIKE 'b:%'").selectExpr("source AS node").distinct())

"""Queries for schema changes and projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregate, schema, text
from .base import query


@query("segment_totals", """
WITH dirty AS (
  SELECT o_orderkey, o_custkey, o_totalprice FROM orders
), cust AS (
  SELECT c_custkey, c_nationkey,
         CASE c_custkey % 3 WHEN 0 THEN '  ' || lower(c_mktsegment) WHEN 1 THEN c_mktsegment || ' '
              ELSE c_mktsegment END AS segment
  FROM customer
), trimmed AS (SELECT c_custkey, c_nationkey, trim(segment) AS segment FROM cust),
counts AS (SELECT lower(segment) AS k, segment, count(*) AS n FROM trimmed GROUP BY ALL),
best AS (SELECT k, segment FROM counts QUALIFY row_number() OVER (PARTITION BY k ORDER BY n DESC, segment) = 1)
SELECT n_name, b.segment, count(*) AS o_orderkey_count, round(sum(o_totalprice), 2) AS o_totalprice_sum
FROM dirty JOIN trimmed t ON o_custkey = c_custkey JOIN best b ON b.k = lower(t.segment)
JOIN nation ON n_nationkey = c_nationkey
GROUP BY n_name, b.segment""")
def segment_totals(t):
    customer = t.customer.select("c_custkey", "c_nationkey", F.expr(
        "CASE c_custkey % 3 WHEN 0 THEN '  ' || lower(c_mktsegment) WHEN 1 THEN c_mktsegment || ' ' "
        "ELSE c_mktsegment END AS segment"))
    cleaned = customer.transform(text.trim_whitespace, columns="segment").transform(
        text.normalise_categories, columns="segment")
    orders = t.orders.select("o_orderkey", "o_custkey", "o_totalprice")
    joined = orders.join(cleaned, orders.o_custkey == cleaned.c_custkey).join(
        t.nation, cleaned.c_nationkey == F.col("n_nationkey"))
    totals = aggregate.group_by(joined, ["n_name", "segment"], "o_orderkey:count, o_totalprice:sum")
    return totals.withColumn("o_totalprice_sum", F.round("o_totalprice_sum", 2))


@query("rename_column", "SELECT o_orderkey AS order_id, o_totalprice FROM orders")
def rename_column(t):
    return schema.rename_column(t.orders.select("o_orderkey", "o_totalprice"), "o_orderkey", "order_id")


@query("rename_columns_bulk", "SELECT o_orderkey AS order_id, o_custkey AS customer_id, o_orderstatus FROM orders")
def rename_columns_bulk(t):
    return schema.rename_columns_bulk(
        t.orders.select("o_orderkey", "o_custkey", "o_orderstatus"),
        {"o_orderkey": "order_id", "o_custkey": "customer_id", "absent": "x"})


@query("drop_column", "SELECT * EXCLUDE (o_orderpriority) FROM orders")
def drop_column(t):
    return schema.drop_column(t.orders, "o_orderpriority")


@query("drop_columns", "SELECT * EXCLUDE (o_orderpriority, o_orderstatus) FROM orders")
def drop_columns(t):
    return schema.drop_columns(t.orders, ["o_orderpriority", "o_orderstatus", "absent"])


@query("reorder_columns", "SELECT o_orderstatus, o_orderkey, o_custkey FROM orders")
def reorder_columns(t):
    return schema.reorder_columns(t.orders.select("o_orderkey", "o_custkey", "o_orderstatus"), ["o_orderstatus"])


@query("normalize_column_names",
       "SELECT o_orderkey AS order_key, o_custkey AS customer_id_ref, o_totalprice AS order_key_2 FROM orders")
def normalize_column_names(t):
    dirty = t.orders.select(F.col("o_orderkey").alias("  Order Key "), F.col("o_custkey").alias("Customer ID (ref)"),
                            F.col("o_totalprice").alias("order-key"))
    return schema.normalize_column_names(dirty)


DIRTY_CAST = """
SELECT o_orderkey,
  CASE o_orderkey % 4 WHEN 0 THEN CAST(o_custkey AS VARCHAR) WHEN 1 THEN ' ' || CAST(o_custkey AS VARCHAR) || ' '
       WHEN 2 THEN 'x' || CAST(o_custkey AS VARCHAR) ELSE NULL END AS n,
  CASE o_orderkey % 6 WHEN 0 THEN 'Yes' WHEN 1 THEN ' off' WHEN 2 THEN '1' WHEN 3 THEN 'FALSE' WHEN 4 THEN 'maybe' END AS b,
  CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y/%m/%d')
       ELSE 'soon' END AS d
FROM orders"""


def dirty_cast(t):
    return t.orders.selectExpr(
        "o_orderkey",
        "CASE o_orderkey % 4 WHEN 0 THEN CAST(o_custkey AS STRING) WHEN 1 THEN ' ' || o_custkey || ' ' "
        "WHEN 2 THEN 'x' || o_custkey END AS n",
        "CASE o_orderkey % 6 WHEN 0 THEN 'Yes' WHEN 1 THEN ' off' WHEN 2 THEN '1' WHEN 3 THEN 'FALSE' "
        "WHEN 4 THEN 'maybe' END AS b",
        "CASE o_orderkey % 3 WHEN 0 THEN date_format(o_orderdate, 'yyyy-MM-dd') WHEN 1 THEN "
        "date_format(o_orderdate, 'yyyy/MM/dd') ELSE 'soon' END AS d")


@query("cast_type", f"""
WITH s AS ({DIRTY_CAST})
SELECT o_orderkey, TRY_CAST(trim(n) AS BIGINT) AS n,
  CASE WHEN lower(trim(b)) IN ('yes','1') THEN true WHEN lower(trim(b)) IN ('off','false') THEN false END AS b,
  CASE WHEN d <> 'soon' THEN replace(d, '/', '-') END AS d
FROM s""")
def cast_type(t):
    df = dirty_cast(t)
    for name, kind in (("n", "int"), ("b", "bool"), ("d", "date")):
        df = schema.cast_type(df, name, kind)
    return df


@query("cast_type_bigint", """
SELECT o_orderkey, 9007199254740993 + o_orderkey AS from_text, 9007199254740993 + o_orderkey AS from_long, CAST(o_orderkey AS BIGINT) AS from_fraction FROM orders""")
def cast_type_bigint(t):
    df = t.orders.selectExpr("o_orderkey", "cast(9007199254740993 + o_orderkey AS string) AS from_text", "9007199254740993 + o_orderkey AS from_long", "o_orderkey || '.0' AS from_fraction")
    for name in ("from_text", "from_long", "from_fraction"):
        df = schema.cast_type(df, name, "int")
    return df


@query("apply_schema_suggestions", f"""
WITH s AS ({DIRTY_CAST})
SELECT o_orderkey, TRY_CAST(trim(n) AS DOUBLE) AS n,
  CASE WHEN lower(trim(b)) IN ('yes','1') THEN true WHEN lower(trim(b)) IN ('off','false') THEN false END AS b, d
FROM s""")
def apply_schema_suggestions(t):
    return schema.apply_schema_suggestions(dirty_cast(t), [
        {"column": "n", "suggested_dtype": "float"}, {"column": "b", "suggested_dtype": "bool"},
        {"column": "gone", "suggested_dtype": "int"}])


@query("coerce_numeric", f"WITH s AS ({DIRTY_CAST}) SELECT o_orderkey, TRY_CAST(trim(n) AS DOUBLE) AS n FROM s")
def coerce_numeric(t):
    return schema.coerce_numeric(dirty_cast(t).select("o_orderkey", "n"), "n")


@query("conditional_column", """
SELECT o_orderkey, o_totalprice,
  CASE WHEN o_totalprice > 200000 THEN 'big' ELSE 'small' END AS size,
  CASE WHEN contains(lower(o_orderpriority), 'urg') THEN 'yes' ELSE 'no' END AS o_orderpriority_flag
FROM orders""")
def conditional_column(t):
    df = t.orders.select("o_orderkey", "o_totalprice", "o_orderpriority")
    df = schema.conditional_column(df, "o_totalprice", "gt", 200000, "big", "small", "size")
    return schema.conditional_column(df, "o_orderpriority", "contains", "Urg").drop("o_orderpriority")


@query("map_values", """
SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'final' WHEN 'O' THEN 'open' ELSE o_orderstatus END AS o_orderstatus,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'now' ELSE 'later' END AS o_orderpriority FROM orders""")
def map_values(t):
    df = t.orders.select("o_orderkey", "o_orderstatus", "o_orderpriority")
    df = schema.map_values(df, "o_orderstatus", {"F": "final", "O": "open"})
    return schema.map_values(df, "o_orderpriority", {"1-URGENT": "now"}, default="later")


@query("edit_cells", """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'pending' ELSE o_orderstatus END AS o_orderstatus,
  CASE WHEN o_orderkey = 7 THEN 1.5 ELSE o_totalprice END AS o_totalprice FROM orders""")
def edit_cells(t):
    df = t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice")
    df = schema.edit_cells(df, "o_orderstatus", "pending", old="P")
    return schema.edit_cells(df, "o_totalprice", 1.5, key={"o_orderkey": 7})


@query("formula_column", """
SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 6) AS charge FROM lineitem""")
def formula_column(t):
    df = t.lineitem.select("l_orderkey", "l_linenumber", "l_extendedprice", "l_discount", "l_tax")
    return schema.formula_column(df, "charge", "round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 6)").drop(
        "l_extendedprice", "l_discount", "l_tax")


@query("cross_column_ratio", """
SELECT l_orderkey, l_linenumber, round(l_extendedprice / nullif(l_discount, 0), 4) AS l_extendedprice_div_l_discount
FROM lineitem""")
def cross_column_ratio(t):
    df = schema.cross_column_ratio(
        t.lineitem.select("l_orderkey", "l_linenumber", "l_extendedprice", "l_discount"), "l_extendedprice", "l_discount")
    return df.withColumn("l_extendedprice_div_l_discount", F.round("l_extendedprice_div_l_discount", 4)).drop(
        "l_extendedprice", "l_discount")


@query("cross_column_diff", """
SELECT l_orderkey, l_linenumber, round(l_extendedprice - l_quantity, 4) AS l_extendedprice_minus_l_quantity FROM lineitem""")
def cross_column_diff(t):
    df = schema.cross_column_diff(
        t.lineitem.select("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity"), "l_extendedprice", "l_quantity")
    return df.withColumn("l_extendedprice_minus_l_quantity", F.round("l_extendedprice_minus_l_quantity", 4)).drop(
        "l_extendedprice", "l_quantity")


@query("split_column", """
SELECT c_custkey, split_part(c_name, '#', 1) AS c_name_1, split_part(c_name, '#', 2) AS c_name_2 FROM customer""")
def split_column(t):
    return schema.split_column(t.customer.select("c_custkey", "c_name"), "c_name", "#")


@query("merge_columns", """
SELECT c_custkey, trim(coalesce(CASE WHEN c_custkey % 5 <> 0 THEN c_name END, '') || '-' || c_mktsegment, '-') AS label
FROM customer""")
def merge_columns(t):
    df = t.customer.selectExpr("c_custkey", "CASE WHEN c_custkey % 5 <> 0 THEN c_name END AS c_name", "c_mktsegment")
    return schema.merge_columns(df, "c_name", "c_mktsegment", "-", "label")


@query("drop_constant_columns", "SELECT o_orderkey, o_orderstatus FROM orders")
def drop_constant_columns(t):
    df = t.orders.selectExpr("o_orderkey", "o_orderstatus", "'x' AS same", "CAST(NULL AS STRING) AS empty")
    return schema.drop_constant_columns(df)


@query("drop_high_missing_columns", """
SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END AS half FROM orders""")
def drop_high_missing_columns(t):
    df = t.orders.selectExpr("o_orderkey", "CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END AS half",
                             "CASE WHEN o_orderkey % 4 = 0 THEN o_orderstatus END AS quarter")
    return schema.drop_high_missing_columns(df, 0.51)


@query("drop_index_columns", "SELECT o_orderkey + 2 AS id, o_orderstatus FROM orders")
def drop_index_columns(t):
    df = t.orders.selectExpr("o_orderkey + 1 AS RowNumber", "o_orderkey + 2 AS id", "o_orderstatus")
    return schema.drop_index_columns(df)


@query("transpose", """
WITH s AS (SELECT r_name, CAST(r_regionkey AS VARCHAR) AS v FROM region)
SELECT 'r_regionkey' AS index, max(v) FILTER (r_name = 'AFRICA') AS "AFRICA", max(v) FILTER (r_name = 'AMERICA') AS "AMERICA",
  max(v) FILTER (r_name = 'ASIA') AS "ASIA", max(v) FILTER (r_name = 'EUROPE') AS "EUROPE",
  max(v) FILTER (r_name = 'MIDDLE EAST') AS "MIDDLE EAST" FROM s""")
def transpose(t):
    return schema.transpose(t.region, "r_name")


@query("clean_headers", "SELECT o_orderkey AS order_key, o_custkey AS customer FROM orders")
def clean_headers(t):
    df = t.orders.select(F.col("o_orderkey").alias(" Order Key"), F.col("o_custkey").alias("Customer!"),
                         F.col("o_totalprice").alias("customer"), F.lit(None).cast("string").alias("Empty"))
    return schema.clean_headers(df)

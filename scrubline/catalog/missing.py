"""Queries for missing values."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import missing
from .base import query

GAPS = """SELECT o_orderkey, o_custkey, o_orderstatus, CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS price,
 CASE WHEN o_orderkey % 5 <> 0 THEN o_orderpriority END AS prio FROM orders"""


def gaps(t):
    return t.orders.selectExpr("o_orderkey", "o_custkey", "o_orderstatus", "CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS price",
                               "CASE WHEN o_orderkey % 5 <> 0 THEN o_orderpriority END AS prio")


def rounded(df, *names, digits=4):
    return df.withColumns({n: F.round(n, digits) for n in names})


@query("fill_missing_mean", f"WITH s AS ({GAPS}) SELECT o_orderkey, round(coalesce(price, avg(price) OVER ()), 4) AS price FROM s")
def fill_missing_mean(t):
    return rounded(missing.fill_missing(gaps(t).select("o_orderkey", "price"), "price", "mean"), "price")


@query("fill_missing_median", f"WITH s AS ({GAPS}) SELECT o_orderkey, round(coalesce(price, (SELECT quantile_cont(price, 0.5) FROM s)), 4) AS price FROM s")
def fill_missing_median(t):
    return rounded(missing.fill_missing(gaps(t).select("o_orderkey", "price"), "price", "median"), "price")


@query("fill_missing_mode", f"""
WITH s AS ({GAPS}), m AS (SELECT prio AS best FROM s WHERE prio IS NOT NULL GROUP BY prio ORDER BY count(*) DESC, prio LIMIT 1)
SELECT o_orderkey, coalesce(prio, best) AS prio FROM s, m""")
def fill_missing_mode(t):
    return missing.fill_missing(gaps(t).select("o_orderkey", "prio"), "prio", "mode")


@query("fill_missing_grouped", f"""
WITH s AS ({GAPS}), a AS (SELECT o_orderstatus, quantile_cont(price, 0.5) AS q, avg(price) AS m FROM s GROUP BY 1),
c AS (SELECT o_orderstatus, prio, count(*) AS n FROM s WHERE prio IS NOT NULL GROUP BY ALL),
b AS (SELECT o_orderstatus, prio FROM c QUALIFY row_number() OVER (PARTITION BY o_orderstatus ORDER BY n DESC, prio) = 1)
SELECT o_orderkey, o_orderstatus, round(coalesce(price, q), 4) AS price, coalesce(s.prio, b.prio) AS prio
FROM s JOIN a USING (o_orderstatus) JOIN b USING (o_orderstatus)""")
def fill_missing_grouped(t):
    df = gaps(t).drop("o_custkey")
    df = missing.fill_missing(df, "price", "median", group_by="o_orderstatus")
    return rounded(missing.fill_missing(df, "prio", "mode", group_by="o_orderstatus"), "price")


@query("fill_nulls", f"""
WITH s AS ({GAPS}) SELECT o_orderkey, coalesce(price, 0.5) AS price, coalesce(prio, '0.5') AS prio FROM s""")
def fill_nulls(t):
    return missing.fill_nulls(gaps(t).select("o_orderkey", "price", "prio"), ["price", "prio"], "constant", "0.5")


EVENT_GAPS = """SELECT event_id, user_id, ts, CASE WHEN event_id % 3 = 1 THEN value END AS v FROM events"""


def event_gaps(t):
    return t.events.selectExpr("event_id", "user_id", "ts", "CASE WHEN event_id % 3 = 1 THEN value END AS v")


@query("fill_missing_ffill", f"""
WITH s AS ({EVENT_GAPS})
SELECT event_id, user_id, last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS v FROM s""")
def fill_missing_ffill(t):
    return missing.fill_missing_ffill(event_gaps(t), "v", ["ts", "event_id"], "user_id").drop("ts")


@query("fill_missing_bfill", f"""
WITH s AS ({EVENT_GAPS})
SELECT event_id, first_value(v IGNORE NULLS) OVER (ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS v FROM s""")
def fill_missing_bfill(t):
    # no partition column: many buckets, carried by their edges
    return missing.fill_missing_bfill(event_gaps(t), "v", ["ts", "event_id"], rows_per_bucket=1500).select("event_id", "v")


@query("fill_missing_interpolate", f"""
WITH s AS ({EVENT_GAPS}), n AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) AS r FROM s),
b AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN r END IGNORE NULLS) OVER w AS r0, last_value(v IGNORE NULLS) OVER w AS v0,
  first_value(CASE WHEN v IS NOT NULL THEN r END IGNORE NULLS) OVER x AS r1, first_value(v IGNORE NULLS) OVER x AS v1 FROM n
  WINDOW w AS (ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), x AS (ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT event_id, round(CASE WHEN v IS NOT NULL THEN v WHEN r0 IS NULL THEN NULL WHEN r1 IS NULL THEN v0
  ELSE v0 + (v1 - v0) / (r1 - r0) * (r - r0) END, 4) AS v FROM b""")
def fill_missing_interpolate(t):
    out = missing.fill_missing_interpolate(event_gaps(t), "v", ["ts", "event_id"], rows_per_bucket=2500)
    return rounded(out.select("event_id", "v"), "v")


def _curve_sql(slope):
    """Cubics between neighbouring knots, whose slopes come from ``slope``, evaluated at the rows of each gap."""
    return f"""
WITH s AS ({EVENT_GAPS}), n AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) AS r FROM s),
k AS (SELECT CAST(r AS DOUBLE) AS x, v AS y, row_number() OVER (ORDER BY r) AS i, count(*) OVER () AS n FROM n WHERE v IS NOT NULL),
h AS (SELECT *, lead(x) OVER w - x AS h, (lead(y) OVER w - y) / (lead(x) OVER w - x) AS m FROM k WINDOW w AS (ORDER BY i)),
g AS (SELECT *, lag(h) OVER w AS h0, lag(m) OVER w AS m0, lag(h, 2) OVER w AS h00, lag(m, 2) OVER w AS m00, lead(h) OVER w AS h2, lead(m) OVER w AS m2 FROM h WINDOW w AS (ORDER BY i)),
d AS (SELECT *, {slope} AS d FROM g),
c AS (SELECT *, lead(d) OVER (ORDER BY i) AS d2 FROM d),
f AS (SELECT n.event_id, n.v, n.r - c.x AS t, c.* EXCLUDE (n) FROM n ASOF LEFT JOIN c ON n.r >= c.x),
l AS (SELECT arg_max(d, i) AS dl, arg_max(y, i) AS yl, arg_max(h0, i) AS hl, arg_max(m0, i) AS ml, arg_max(lag_d, i) AS dp FROM (SELECT *, lag(d) OVER (ORDER BY i) AS lag_d FROM c))
SELECT event_id, round(CASE WHEN v IS NOT NULL THEN v
  WHEN h IS NULL THEN yl + t * (dl + t * (((ml - dp) / hl - (dp + dl - 2 * ml) / hl) + 3 * (dp + dl - 2 * ml) / hl + t * (dp + dl - 2 * ml) / hl / hl))
  ELSE y + t * (d + t * ((m - d) / h - (d + d2 - 2 * m) / h + t * (d + d2 - 2 * m) / h / h)) END, 4) AS v FROM f, l"""


def _edge(h0, h1, m0, m1):
    d = f"((2 * {h0} + {h1}) * {m0} - {h0} * {m1}) / ({h0} + {h1})"
    return f"CASE WHEN sign({d}) <> sign({m0}) THEN 0 WHEN sign({m0}) <> sign({m1}) AND abs({d}) > 3 * abs({m0}) THEN 3 * {m0} ELSE {d} END"


PCHIP_SLOPE = f"""CASE WHEN i = 1 THEN {_edge('h', 'h2', 'm', 'm2')} WHEN i = n THEN {_edge('h0', 'h00', 'm0', 'm00')} WHEN m0 * m <= 0 THEN 0
  ELSE 3 * (h + h0) / ((2 * h + h0) / m0 + (h + 2 * h0) / m) END"""


@query("fill_missing_pchip", _curve_sql(PCHIP_SLOPE))
def fill_missing_pchip(t):
    out = missing.fill_missing_interpolate(event_gaps(t), "v", ["ts", "event_id"], method="pchip", rows_per_bucket=2500)
    return rounded(out.select("event_id", "v"), "v")


# one system over all knots has no SQL form; tests/test_curves.py holds it against a dense solve
@query("fill_missing_cubicspline")
def fill_missing_cubicspline(t):
    out = missing.fill_missing_interpolate(event_gaps(t), "v", ["ts", "event_id"], "user_id", method="cubicspline")
    return rounded(out.select("event_id", "v"), "v")


@query("impute_auto", f"""
WITH s AS (SELECT o_orderkey, price, prio, CASE WHEN o_orderkey % 9 <> 0 THEN CAST(o_custkey AS VARCHAR) END AS code FROM ({GAPS})),
m AS (SELECT quantile_cont(price, 0.5) AS p, quantile_cont(CAST(code AS DOUBLE), 0.5) AS c FROM s),
k AS (SELECT prio AS best FROM s WHERE prio IS NOT NULL GROUP BY prio ORDER BY count(*) DESC, prio LIMIT 1)
SELECT o_orderkey, round(coalesce(price, p), 4) AS price, coalesce(prio, best) AS prio, coalesce(CAST(code AS DOUBLE), c) AS code FROM s, m, k""")
def impute_auto(t):
    df = gaps(t).selectExpr("o_orderkey", "price", "prio", "CASE WHEN o_orderkey % 9 <> 0 THEN string(o_custkey) END AS code")
    return rounded(missing.impute_auto(df), "price")

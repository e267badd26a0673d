"""Queries for string cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.values import CURRENCY_TO_ISO, STOPWORDS
from ..operators import text
from .base import query


def title_sql(c: str) -> str:
    """ASCII title case in DuckDB."""
    return (f"coalesce(array_to_string(list_transform(regexp_extract_all(lower({c}), '[a-z]+|[^a-z]+'), "
            "lambda x: upper(x[1]) || x[2:]), ''), CASE WHEN " + c + " IS NOT NULL THEN '' END)")


@query("trim_whitespace", r"""
SELECT doc_id, regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g') AS text FROM documents""")
def trim_whitespace(t):
    return text.trim_whitespace(t.documents.select("doc_id", "text"), "text")


NAME_SQL = """SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN upper(p_name) WHEN 1 THEN 'o''' || p_name || '-2b' ELSE p_name END AS name FROM part"""


def names(t):
    return t.part.selectExpr("p_partkey", "CASE p_partkey % 3 WHEN 0 THEN upper(p_name) WHEN 1 THEN "
                             "\"o'\" || p_name || '-2b' ELSE p_name END AS name")


@query("standardise_capitalisation", f"WITH s AS ({NAME_SQL}) SELECT p_partkey, {title_sql('name')} AS name FROM s")
def standardise_capitalisation(t):
    return text.standardise_capitalisation(names(t), "name")


@query("convert_dirty_nulls", """
SELECT o_orderkey, CASE WHEN o_orderkey % 8 IN (0, 1, 2, 3) THEN NULL WHEN o_orderkey % 8 = 4 THEN 'N/A'
  ELSE o_orderpriority END AS v FROM orders""")
def convert_dirty_nulls(t):
    df = t.orders.selectExpr(
        "o_orderkey", "CASE o_orderkey % 8 WHEN 0 THEN 'n/a' WHEN 1 THEN '--' WHEN 2 THEN '' WHEN 3 THEN '-999' "
        "WHEN 4 THEN 'N/A' ELSE o_orderpriority END AS v")
    return text.convert_dirty_nulls(df)


@query("replace_error_placeholders", """
SELECT o_orderkey, CASE WHEN o_orderkey % 10 IN (0, 1) THEN NULL ELSE o_orderpriority END AS many,
  CASE WHEN o_orderkey = 5 THEN 'error' ELSE o_orderstatus END AS few FROM orders""")
def replace_error_placeholders(t):
    df = t.orders.selectExpr(
        "o_orderkey", "CASE o_orderkey % 10 WHEN 0 THEN '#N/A' WHEN 1 THEN ' Error' ELSE o_orderpriority END AS many",
        "CASE WHEN o_orderkey = 5 THEN 'error' ELSE o_orderstatus END AS few")
    return text.replace_error_placeholders(df)


@query("find_replace", r"""
SELECT doc_id, replace(text, 'the', 'THE') AS text,
  regexp_replace(source, 'SRC([0-9]+)', 'source-\1', 'gi') AS source FROM documents""")
def find_replace(t):
    df = text.find_replace(t.documents.select("doc_id", "text", "source"), "text", "the", "THE")
    return text.find_replace(df, "source", r"SRC(\d+)", r"source-\1", regex=True, case_sensitive=False)


@query("strip_characters", r"""
SELECT page_id, regexp_replace(html, '<[^>]+>', '', 'g') AS html, regexp_replace(url, '[^a-zA-Z0-9\s]', '', 'g') AS url FROM pages""")
def strip_characters(t):
    df = text.strip_characters(t.pages, "html", "html")
    return text.strip_characters(df, "url", "special")


@query("clean_special_chars", """
SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN o_orderpriority ELSE o_orderpriority END AS v, 'a?' || o_orderkey AS w
FROM orders WHERE false UNION ALL
SELECT o_orderkey, o_orderpriority, CASE WHEN o_orderkey = 3 THEN 'a?b' ELSE 'ab' END FROM orders""")
def clean_special_chars(t):
    df = t.orders.selectExpr("o_orderkey", "CASE WHEN o_orderkey % 5 = 0 THEN o_orderpriority || '??' ELSE o_orderpriority END AS v",
                             "CASE WHEN o_orderkey = 3 THEN 'a?b' ELSE 'ab' END AS w")
    return text.clean_special_chars(df)


@query("clean_text_noise", """
SELECT o_orderkey, o_orderpriority AS v, 'x#' || o_orderkey AS w FROM orders""")
def clean_text_noise(t):
    df = t.orders.selectExpr(
        "o_orderkey", "CASE o_orderkey % 20 WHEN 0 THEN o_orderpriority || '!!' WHEN 1 THEN o_orderpriority || ' http://a.b/c' "
        "WHEN 2 THEN '12345678901 ' || o_orderpriority ELSE o_orderpriority END AS v", "'x#' || o_orderkey AS w")
    return text.clean_text_noise(df)


@query("normalize_unicode", "SELECT doc_id, strip_accents(text) AS text FROM documents")
def normalize_unicode(t):
    return text.normalize_unicode(t.documents.select("doc_id", "text"), "text")


CATEGORY_SQL = """SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN lower(c_mktsegment) WHEN 1 THEN c_mktsegment || ' '
 ELSE c_mktsegment END AS seg, CASE c_custkey % 5 WHEN 0 THEN upper(c_mktsegment) ELSE lower(c_mktsegment) END AS seg2 FROM customer"""


def categories(t):
    return t.customer.selectExpr(
        "c_custkey", "CASE c_custkey % 4 WHEN 0 THEN lower(c_mktsegment) WHEN 1 THEN c_mktsegment || ' ' ELSE c_mktsegment END AS seg",
        "CASE c_custkey % 5 WHEN 0 THEN upper(c_mktsegment) ELSE lower(c_mktsegment) END AS seg2")


@query("normalise_categories", f"""
WITH s AS ({CATEGORY_SQL}), c AS (SELECT lower(trim(seg)) AS k, seg, count(*) AS n FROM s GROUP BY ALL),
b AS (SELECT k, seg FROM c QUALIFY row_number() OVER (PARTITION BY k ORDER BY n DESC, seg) = 1)
SELECT c_custkey, b.seg FROM s JOIN b ON b.k = lower(trim(s.seg))""")
def normalise_categories(t):
    return text.normalise_categories(categories(t).drop("seg2"))


@query("normalise_categories_shared", f"""
WITH s AS ({CATEGORY_SQL}), u AS (SELECT seg AS v FROM s UNION ALL SELECT seg2 FROM s),
c AS (SELECT lower(trim(v)) AS k, v, count(*) AS n FROM u GROUP BY ALL),
b AS (SELECT k, v FROM c QUALIFY row_number() OVER (PARTITION BY k ORDER BY n DESC, v) = 1)
SELECT c_custkey, b1.v AS seg, b2.v AS seg2 FROM s JOIN b b1 ON b1.k = lower(trim(seg)) JOIN b b2 ON b2.k = lower(trim(seg2))""")
def normalise_categories_shared(t):
    return text.normalise_categories_shared(categories(t), ["seg", "seg2"])


@query("extract_numeric", """
SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 3 THEN NULL ELSE CASE WHEN l_linenumber = 2 THEN -1 ELSE 1 END * l_quantity END AS v
FROM lineitem""")
def extract_numeric(t):
    df = t.lineitem.selectExpr(
        "l_orderkey", "l_linenumber", "CASE l_linenumber WHEN 3 THEN 'none' WHEN 2 THEN 'T: -' || l_quantity || ' kg' "
        "ELSE 'about ' || l_quantity || ' pieces' END AS v")
    return text.extract_numeric(df, "v")


@query("parse_currency", "SELECT o_orderkey, o_totalprice AS v_amount FROM orders")
def parse_currency(t):
    df = t.orders.selectExpr("o_orderkey", "CASE o_orderkey % 3 WHEN 0 THEN '$' || format_number(o_totalprice, 2) "
                             "WHEN 1 THEN '€ ' || format_number(o_totalprice, 2) ELSE format_number(o_totalprice, 2) || ' USD' END AS v")
    return text.parse_currency(df, "v").drop("v")


@query("parse_number_formatted", "SELECT o_orderkey, o_totalprice AS us_parsed, o_totalprice AS eu_parsed FROM orders")
def parse_number_formatted(t):
    df = t.orders.selectExpr("o_orderkey", "format_number(o_totalprice, 2) AS us",
                             "translate(format_number(o_totalprice, 2), ',.', '.,') AS eu")
    df = text.parse_number_formatted(df, "us")
    return text.parse_number_formatted(df, "eu", "eu").drop("us", "eu")


@query("clean_dirty_numeric", """
WITH m AS (SELECT quantile_cont(l_quantity, 0.5) AS q FROM lineitem WHERE l_orderkey % 10 <> 0)
SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 10 = 0 THEN q ELSE l_quantity END AS v, l_returnflag FROM lineitem, m""")
def clean_dirty_numeric(t):
    df = t.lineitem.selectExpr(
        "l_orderkey", "l_linenumber", "CASE l_orderkey % 10 WHEN 0 THEN 'lost' WHEN 1 THEN '$' || l_quantity "
        "WHEN 2 THEN l_quantity || ' lbs' WHEN 3 THEN '\"' || l_quantity || '\"' ELSE l_quantity || ' Units each' END AS v", "l_returnflag")
    return text.clean_dirty_numeric(df)


@query("parse_percentage", "SELECT l_orderkey, l_linenumber, round(l_discount, 6) AS f, round(l_discount * 100, 6) AS p FROM lineitem")
def parse_percentage(t):
    df = t.lineitem.selectExpr("l_orderkey", "l_linenumber", "round(l_discount * 100, 2) || '%' AS f", "round(l_discount * 100, 2) || ' %' AS p")
    df = text.parse_percentage(text.parse_percentage(df, "f"), "p", as_fraction=False)
    return df.withColumns({"f": F.round("f", 6), "p": F.round("p", 6)})


@query("parse_scientific", "SELECT o_orderkey, CAST(o_custkey AS DOUBLE) * 1000 AS v FROM orders")
def parse_scientific(t):
    return text.parse_scientific(t.orders.selectExpr("o_orderkey", "o_custkey || 'e3' AS v"), "v")


@query("strip_leading_zeros", r"SELECT c_custkey, regexp_replace(split_part(c_name, '#', 2), '^0+', '') AS code FROM customer")
def strip_leading_zeros(t):
    return text.strip_leading_zeros(t.customer.selectExpr("c_custkey", "split_part(c_name, '#', 2) AS code"), "code")


@query("normalize_boolean", """
SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true WHEN 3 THEN false END AS b FROM orders""")
def normalize_boolean(t):
    df = t.orders.selectExpr("o_orderkey", "CASE o_orderkey % 6 WHEN 0 THEN ' Yes' WHEN 1 THEN 'INACTIVE' WHEN 2 THEN 't' "
                             "WHEN 3 THEN 'off ' WHEN 4 THEN 'perhaps' END AS b")
    return text.normalize_boolean(df, "b")


@query("normalize_phone", """
SELECT o_orderkey, CASE o_orderkey % 2 WHEN 0 THEN '+44' || lpad(CAST(o_orderkey AS VARCHAR), 10, '0')
  ELSE '+1' || '555' || lpad(CAST(o_orderkey AS VARCHAR), 7, '0') END AS phone FROM orders""")
def normalize_phone(t):
    df = t.orders.selectExpr("o_orderkey", "CASE o_orderkey % 2 WHEN 0 THEN ' +44 ' || lpad(o_orderkey, 10, '0') "
                             "ELSE '(555) ' || lpad(o_orderkey, 7, '0') END AS phone")
    return text.normalize_phone(df, "phone", "+1")


@query("extract_email_domain", "SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 THEN lower(c_mktsegment) || '.org' END AS email_domain FROM customer")
def extract_email_domain(t):
    df = t.customer.selectExpr("c_custkey", "CASE WHEN c_custkey % 3 <> 0 THEN 'a' || c_custkey || '@' || lower(c_mktsegment) || '.org' "
                               "ELSE 'none' END AS email")
    return text.extract_email_domain(df, "email").drop("email")


@query("extract_url_parts", """
SELECT page_id, nullif(regexp_extract(url, 'https?://([^/]+)', 1), '') AS url_domain,
  nullif(regexp_extract(url, 'https?://[^/]+(/[^?]*)', 1), '') AS url_path, nullif(regexp_extract(url, '(https?)://', 1), '') AS url_protocol FROM pages""")
def extract_url_parts(t):
    return text.extract_url_parts(t.pages.select("page_id", "url"), "url").drop("url")


@query("clean_urls", r"""
SELECT page_id, rtrim(regexp_replace(regexp_replace(regexp_replace(trim(url), '\?.*', ''), '^https?://', ''), '^www\.', ''), '/') AS url FROM pages""")
def clean_urls(t):
    return text.clean_urls(t.pages.select("page_id", "url"), "url")


@query("clean_emails", "SELECT c_custkey, 'a' || c_custkey || '@' || lower(c_mktsegment) || '.org' AS email FROM customer")
def clean_emails(t):
    df = t.customer.selectExpr("c_custkey", "' A' || c_custkey || '@ ' || c_mktsegment || '.ORG ' AS email")
    return text.clean_emails(df, "email")


@query("clean_html", r"""
SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS html FROM pages""")
def clean_html(t):
    return text.clean_html(t.pages.select("page_id", "html"), "html")


@query("clean_log_lines", """
SELECT event_id, ' ' || event_type || ' by ' || user_id AS line FROM events""")
def clean_log_lines(t):
    df = t.events.selectExpr("event_id", "' [' || ts || '] ' || CASE WHEN event_type = 'error' THEN 'ERROR ' ELSE 'INFO  ' END || "
                             "event_type || '   by ' || user_id AS line")
    return text.clean_log_lines(df, "line")


@query("clean_names", f"""SELECT s_suppkey, {title_sql("'j p ' || replace(s_name, '#', ' ')")} AS name FROM supplier""")
def clean_names(t):
    df = t.supplier.selectExpr("s_suppkey", "'  j. p.   ' || replace(s_name, '#', '  ') AS name")
    return text.clean_names(df, "name")


@query("clean_addresses", f"""SELECT s_suppkey, s_suppkey || ' ' || {title_sql("split_part(s_name, '#', 1)")} || ' St, Apt 5' AS address FROM supplier""")
def clean_addresses(t):
    df = t.supplier.selectExpr("s_suppkey", "s_suppkey || '  ' || split_part(s_name, '#', 1) || ' STREET, , apartment 5 ' AS address")
    return text.clean_addresses(df, "address", abbreviate=True)


@query("clean_city", f"""SELECT n_nationkey, {title_sql("regexp_replace(n_name, '[^a-zA-Z -]', '', 'g')")} AS city FROM nation""")
def clean_city(t):
    # nations as places, with digits and marks mixed in
    return text.clean_city(t.nation.selectExpr("n_nationkey", "' 1' || n_name || '!' AS city"), "city")


@query("clean_postal_codes", """
SELECT c_custkey, lpad(CAST(c_custkey AS VARCHAR), CAST(greatest(5, length(CAST(c_custkey AS VARCHAR))) AS INT), '0') AS us, 'AB' || c_custkey || 'CD' AS uk FROM customer""")
def clean_postal_codes(t):
    df = t.customer.selectExpr("c_custkey", "'#' || c_custkey AS us", "'ab' || c_custkey || ' cd' AS uk")
    return text.clean_postal_codes(text.clean_postal_codes(df, "us"), "uk", "UK")


@query("clean_codes", """
SELECT c_custkey, 'GB' || c_custkey || 'X' AS iban, 'A' || c_custkey || '.1' AS icd, CAST(c_custkey AS VARCHAR) AS cpt FROM customer""")
def clean_codes(t):
    df = t.customer.selectExpr("c_custkey", "' gb' || c_custkey || ' x' AS iban", "'a' || c_custkey || '.1!' AS icd", "'cpt ' || c_custkey AS cpt")
    return text.clean_codes(text.clean_codes(text.clean_codes(df, "iban", "iban"), "icd", "ICD10"), "cpt", "CPT")


@query("clean_handles", "SELECT c_custkey, lower(c_mktsegment) || c_custkey AS handle FROM customer")
def clean_handles(t):
    return text.clean_handles(t.customer.selectExpr("c_custkey", "' @' || c_mktsegment || c_custkey AS handle"), "handle")


@query("parse_coordinates", """
SELECT c_custkey, round((CASE WHEN c_custkey % 2 = 0 THEN -1 ELSE 1 END) * (c_custkey % 90 + 30 / 60.0 + 15 / 3600.0), 6) AS lat,
  round((CASE WHEN c_custkey % 2 = 0 THEN -1 ELSE 1 END) * (c_custkey % 180 + 10 / 60.0), 6) AS lon FROM customer""")
def parse_coordinates(t):
    df = t.customer.selectExpr(
        "c_custkey", "c_custkey % 90 || '°30\\'15\"' || CASE WHEN c_custkey % 2 = 0 THEN 'S' ELSE 'N' END AS lat",
        "c_custkey % 180 || '° 10\\' ' || CASE WHEN c_custkey % 2 = 0 THEN 'w' ELSE 'e' END AS lon")
    df = text.parse_coordinates(df, "lat", "lon", "dms", "dms")
    return df.withColumns({"lat": F.round("lat", 6), "lon": F.round("lon", 6)})


@query("extract_regex_groups", r"""
SELECT page_id, CASE WHEN regexp_matches(url, '://([^/]+)/([a-z]+)') THEN regexp_extract(url, '://([^/]+)/([a-z]+)', 1) END AS host,
  CASE WHEN regexp_matches(url, '://([^/]+)/([a-z]+)') THEN regexp_extract(url, '://([^/]+)/([a-z]+)', 2) END AS lang FROM pages""")
def extract_regex_groups(t):
    return text.extract_regex_groups(t.pages.select("page_id", "url"), "url", "://([^/]+)/([a-z]+)", ["host", "lang"]).drop("url")


@query("tokenize_text", """
SELECT conv_id, turn, array_to_string(string_split(text, ' '), '|') AS tokens, len(string_split(text, ' ')) AS n FROM conversations""")
def tokenize_text(t):
    df = text.tokenize_text(t.conversations.select("conv_id", "turn", "text"), "text", new_col="tokens")
    return df.select("conv_id", "turn", F.array_join("tokens", "|").alias("tokens"), F.size("tokens").cast("long").alias("n"))


STOP_SQL = ", ".join(f"'{w}'" for w in STOPWORDS["english"])


@query("remove_stopwords", rf"""
SELECT conv_id, turn, array_to_string(list_filter(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' '),
  lambda w: lower(w) NOT IN ({STOP_SQL})), ' ') AS text FROM conversations""")
def remove_stopwords(t):
    return text.remove_stopwords(t.conversations.select("conv_id", "turn", "text"), "text")


@query("detect_encoding", r"""
WITH c AS (SELECT count(*) AS n, count_if(NOT regexp_matches(text, '[^\x00-\x7F]')) AS a, count_if(regexp_matches(text, '[^\x00-\x7F]')) AS b,
  count_if(regexp_matches(text, '�|Ã[\x{0080}-¿]|â€')) AS c, count_if(regexp_matches(text, '[\x00-\x08\x0B\x0C\x0E-\x1F]')) AS d FROM documents)
SELECT 'text' AS "column", kind, hits, round(hits / n, 6) AS share FROM (
  SELECT 'ascii' AS kind, a AS hits, n FROM c UNION ALL SELECT 'non_ascii', b, n FROM c UNION ALL SELECT 'broken', c, n FROM c
  UNION ALL SELECT 'control', d, n FROM c)""")
def detect_encoding(t):
    return text.detect_encoding(t.documents, "text").withColumn("share", F.round("share", 6))


CURRENCY_VALUES = ", ".join(f"('{k}', '{v}')" for k, v in CURRENCY_TO_ISO.items())
MONEY_SQL = """SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN ' Dollar' WHEN 1 THEN '€' WHEN 2 THEN 'gbp' WHEN 3 THEN 'gold' ELSE o_orderpriority END AS cur FROM orders"""


def money(t):
    return t.orders.selectExpr("o_orderkey", "CASE o_orderkey % 5 WHEN 0 THEN ' Dollar' WHEN 1 THEN '€' WHEN 2 THEN 'gbp' "
                               "WHEN 3 THEN 'gold' ELSE o_orderpriority END AS cur")


@query("map_to_standard", f"""
WITH s AS ({MONEY_SQL}), v(k, w) AS (VALUES {CURRENCY_VALUES})
SELECT o_orderkey, coalesce(w, cur) AS cur FROM s LEFT JOIN v ON k = lower(trim(cur))""")
def map_to_standard(t):
    return text.map_to_standard(money(t), "cur", "currency")


@query("map_to_standard_counts", f"""
WITH s AS ({MONEY_SQL}), v(k, w) AS (VALUES {CURRENCY_VALUES})
SELECT count(w) AS mapped, count(*) - count(w) AS unmapped FROM s LEFT JOIN v ON k = lower(trim(cur))""")
def map_to_standard_counts(t):
    return text.mapping_counts(money(t), "cur", "currency")


@query("preview_mapping", f"""
WITH s AS ({MONEY_SQL}), v(k, w) AS (VALUES {CURRENCY_VALUES})
SELECT DISTINCT cur AS original, w AS mapped, CASE WHEN w IS NULL THEN 'unmapped' ELSE 'mapped' END AS status
FROM s LEFT JOIN v ON k = lower(trim(cur))""")
def preview_mapping(t):
    return text.preview_mapping(money(t), "cur", "currency")


@query("validate_json", "SELECT event_id, event_id % 3 <> 0 AS props_is_json FROM events")
def validate_json(t):
    df = t.events.selectExpr("event_id", "CASE WHEN event_id % 3 = 0 THEN substr(props, 2) ELSE props END AS props")
    return text.validate_json(df, "props").drop("props")


@query("flatten_json", "SELECT event_id, json_extract_string(props, '$.k') AS p_k FROM events")
def flatten_json(t):
    return text.flatten_json(t.events.select("event_id", "props"), "props", "p").drop("props")


@query("clean_mixed_formats", """
SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN CAST(o_custkey AS DOUBLE) END AS n,
  CASE WHEN o_orderkey % 3 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END AS d FROM orders""")
def clean_mixed_formats(t):
    df = t.orders.selectExpr(
        "o_orderkey", "CASE WHEN o_orderkey % 3 <> 0 THEN ' ' || o_custkey ELSE 'n' || o_custkey END AS n",
        "CASE o_orderkey % 3 WHEN 1 THEN date_format(o_orderdate, 'yyyy-MM-dd') WHEN 2 THEN date_format(o_orderdate, 'MMMM d, yyyy') ELSE '?' END AS d")
    df = text.clean_mixed_formats(text.clean_mixed_formats(df, "n", "numeric"), "d", "datetime")
    return df.withColumn("d", F.date_format("d", "yyyy-MM-dd HH:mm:ss"))


@query("parse_epoch", """
SELECT event_id, CASE event_id % 3 WHEN 0 THEN strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S')
  WHEN 1 THEN strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') ELSE 'n' || event_id END AS v FROM events""")
def parse_epoch(t):
    df = t.events.selectExpr("event_id", "CASE event_id % 3 WHEN 0 THEN string(unix_seconds(timestamp(ts))) "
                             "WHEN 1 THEN string(unix_millis(timestamp(ts))) ELSE 'n' || event_id END AS v")
    return text.parse_epoch(df, "v")

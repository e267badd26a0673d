"""Queries for validation flags, rule sets and named patterns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.values import PATTERNS
from ..operators import validate
from .base import query

CONTACT = """SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'a.b' || c_custkey || '@shop.org' WHEN 1 THEN 'bad@' WHEN 2 THEN 'x y@z.com' WHEN 3 THEN NULL ELSE 'u-1@a.co' END AS email,
 CASE c_custkey % 3 WHEN 0 THEN '(555) 123-4567' WHEN 1 THEN '12' ELSE '+44 1234 567890' END AS phone,
 CASE c_custkey % 4 WHEN 0 THEN '12345' WHEN 1 THEN '12345-6789' WHEN 2 THEN 'k1a 0b1' ELSE NULL END AS zip FROM customer"""


def contact(t):
    t.customer.createOrReplaceTempView("customer_contact")
    return t.spark.sql(CONTACT.replace("FROM customer", "FROM customer_contact"))


@query("validate_regex", "SELECT c_custkey, c_mktsegment, NOT regexp_matches(c_mktsegment, '^[A-M]') AS c_mktsegment_invalid_format FROM customer")
def validate_regex(t):
    return validate.validate_regex(t.customer.select("c_custkey", "c_mktsegment"), "c_mktsegment", "^[A-M]")


@query("validate_range", "SELECT c_custkey, NOT (c_acctbal BETWEEN 0 AND 5000) AS bad FROM customer")
def validate_range(t):
    return validate.validate_range(t.customer.select("c_custkey", "c_acctbal"), "c_acctbal", 0, 5000, "bad").drop("c_acctbal")


@query("validate_format", rf"""
SELECT c_custkey, coalesce(NOT regexp_matches(email, '^[^@\s]+@[^@\s]+\.[^@\s]+$'), true) AS email_bad,
  coalesce(NOT regexp_matches(zip, '^\d{{5}}(-\d{{4}})?$'), true) AS zip_bad FROM ({CONTACT})""")
def validate_format(t):
    df = validate.validate_format(contact(t), "email", "email", "email_bad")
    return validate.validate_format(df, "zip", "zip_code", "zip_bad").select("c_custkey", "email_bad", "zip_bad")


@query("validate_format_url", "SELECT page_id, NOT regexp_matches(url, '^https?://') AS url_invalid_format FROM pages")
def validate_format_url(t):
    return validate.validate_format(t.pages.select("page_id", "url"), "url", "url").drop("url")


@query("flag_invalid_emails", rf"""
SELECT c_custkey, coalesce(NOT regexp_matches(email, '^[\w\.-]+@[\w\.-]+\.\w{{2,}}$'), true) AS email_invalid,
  coalesce(regexp_matches(email, '^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{{2,}}$'), false) AS email_email_valid FROM ({CONTACT})""")
def flag_invalid_emails(t):
    df = validate.flag_invalid_emails(contact(t), "email")
    return validate.validate_email_advanced(df, "email").select("c_custkey", "email_invalid", "email_email_valid")


@query("validate_phone", rf"""
SELECT c_custkey, regexp_matches(phone, '^\+?1?[-.\s]?\(?\d{{3}}\)?[-.\s]?\d{{3}}[-.\s]?\d{{4}}$') AS us, regexp_matches(phone, '^\+?44[-.\s]?\d{{4}}[-.\s]?\d{{6}}$') AS uk FROM ({CONTACT})""")
def validate_phone(t):
    df = validate.validate_phone(contact(t), "phone", "US", "us")
    return validate.validate_phone(df, "phone", "UK", "uk").select("c_custkey", "us", "uk")


@query("validate_postal_code", rf"""
SELECT c_custkey, coalesce(regexp_matches(zip, '^\d{{5}}(-\d{{4}})?$'), false) AS us, coalesce(regexp_matches(zip, '(?i)^[A-Z]\d[A-Z]\s?\d[A-Z]\d$'), false) AS ca FROM ({CONTACT})""")
def validate_postal_code(t):
    df = validate.validate_postal_code(contact(t), "zip", "US", "us")
    return validate.validate_postal_code(df, "zip", "CA", "ca").select("c_custkey", "us", "ca")


RULES = [
    {"type": "not_null", "column": "email"}, {"type": "regex", "column": "zip", "pattern": r"^\d{5}"},
    {"type": "enum", "column": "zip", "values": ["12345", "K1A 0B1"]}, {"type": "unique", "column": "phone"},
    {"type": "max_length", "column": "phone", "max": 10}, {"type": "contains", "column": "email", "value": "SHOP"},
    {"type": "starts_with", "column": "phone", "value": "+"}, {"type": "range", "column": "c_custkey", "min": 10, "max": 900},
    {"type": "positive", "column": "c_custkey"}, {"type": "not_equal", "column": "phone", "value": "12"},
    {"type": "cross_column", "col_a": "c_custkey", "col_b": "limit", "op": "lt"},
    {"type": "predicate", "expression": "length(email) > 8"}, {"type": "pattern", "column": "email", "pattern_name": "email"},
    {"type": "enum", "column": "nope", "values": []},
]


@query("run_validation", rf"""
WITH s AS (SELECT *, 700 AS "limit" FROM ({CONTACT})), v AS (SELECT
  count_if(email IS NULL OR trim(email) = '') AS v0, count_if(NOT regexp_matches(coalesce(zip, ''), '^\d{{5}}')) AS v1,
  count_if(lower(coalesce(zip, '')) NOT IN ('12345', 'k1a 0b1')) AS v2, count(*) - count(DISTINCT phone) AS v3, count_if(length(phone) > 10) AS v4,
  count_if(NOT contains(coalesce(email, ''), 'shop')) AS v5, count_if(NOT starts_with(phone, '+')) AS v6, count_if(c_custkey NOT BETWEEN 10 AND 900) AS v7,
  count_if(c_custkey <= 0) AS v8, count_if(phone = '12') AS v9, count_if(c_custkey >= "limit") AS v10, count_if(NOT coalesce(length(email) > 8, false)) AS v11,
  count_if(NOT regexp_matches(coalesce(email, ''), '\b[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{{2,}}\b')) AS v12, 0 AS v13, count(*) AS n FROM s)
SELECT CAST(i - 1 AS INT) AS rule_id, x AS violations, round(x * 100.0 / n, 2) AS violation_pct, x = 0 AS passed FROM (
  SELECT unnest([v0, v1, v2, v3, v4, v5, v6, v7, v8, v9, v10, v11, v12, v13]) AS x, unnest(range(1, 15)) AS i, n FROM v)""")
def run_validation(t):
    df = contact(t).withColumn("limit", F.lit(700))
    return validate.run_validation(df, RULES).drop("rule", "note")


CHECKED = ["email", "ipv4", "ssn_us", "date_iso", "url", "zipcode_us", "credit_card", "uuid", "phone_us", "hex_color", "time_24h"]


def pattern_sql(name: str) -> str:
    return PATTERNS[name].replace("'", "''")


@query("pattern_validate", "WITH c AS (SELECT count(*) AS total, " + ", ".join(
    f"count_if(regexp_matches(text, '{pattern_sql(p)}')) AS {p}" for p in CHECKED) + " FROM documents) " + " UNION ALL ".join(
    f"""SELECT 'text' AS "column", '{p}' AS pattern_name, {p} AS matches, total, round({p} * 100 / total, 2) AS match_pct FROM c""" for p in CHECKED))
def pattern_validate(t):
    return validate.pattern_validate(t.documents, "text", CHECKED).drop("category")


@query("pattern_validate_all")
def pattern_validate_all(t):
    return validate.pattern_validate(t.documents, "text")


@query("pattern_extract", f"SELECT doc_id, nullif(regexp_extract(text, '{pattern_sql('email')}'), '') AS text_email FROM documents")
def pattern_extract(t):
    return validate.pattern_extract(t.documents.select("doc_id", "text"), "text", "email").drop("text")

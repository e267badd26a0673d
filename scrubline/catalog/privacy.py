"""Queries for personal data."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.values import PII_PATTERNS, REDACTION_LABELS
from ..operators import privacy
from .base import query

PEOPLE = """SELECT c_custkey, c_name, 'u' || c_custkey || '@shop.org' AS contact_mail, CASE WHEN c_custkey % 4 <> 0 THEN '10.0.0.' || c_custkey % 250 ELSE 'none' END AS source,
 c_mktsegment, '123-45-' || CAST(1000 + c_custkey % 9000 AS {text}) AS code, '1987-0' || 1 + c_custkey % 9 || '-11' AS birth_day FROM customer"""


def people(t):
    t.customer.createOrReplaceTempView("customer_people")
    return t.spark.sql(PEOPLE.format(text="STRING").replace("'1987-0' || 1 + c_custkey % 9 ||", "'1987-0' || (1 + c_custkey % 9) ||").replace(
        "FROM customer", "FROM customer_people"))


PEOPLE_SQL = PEOPLE.format(text="VARCHAR").replace("'1987-0' || 1 + c_custkey % 9 ||", "'1987-0' || (1 + c_custkey % 9) ||")


@query("detect_pii", f"""
WITH s AS ({PEOPLE_SQL})
SELECT 'c_name' AS "column", 'name' AS pii_type, 0.85::DOUBLE AS confidence, count(*) AS match_count FROM s UNION ALL
SELECT 'contact_mail', 'email', 0.95, count(*) FROM s UNION ALL SELECT 'birth_day', 'date_of_birth', 0.9, count(*) FROM s UNION ALL
SELECT 'source', 'phone', round(count_if(source <> 'none') / count(*), 2), count_if(source <> 'none') FROM s UNION ALL
SELECT 'code', 'phone', 1.0, count(*) FROM s""")
def detect_pii(t):
    return privacy.detect_pii(people(t))


@query("scan_pii_inventory", """
SELECT * FROM (VALUES ('c_name', 'ssn', 'sensitive', 1.0::DOUBLE), ('contact_mail', 'email', 'personal', 0.8), ('source', 'ip_address', 'location', 0.5),
 ('code', 'ssn', 'sensitive', 1.0), ('birth_day', 'age', 'personal', 0.3)) v("column", pii_type, category, sensitivity)
WHERE (SELECT count(*) FROM customer) > 0""")
def scan_pii_inventory(t):
    return privacy.scan_pii_inventory(people(t).withColumnRenamed("c_custkey", "k"))


@query("mask_pii", f"""
SELECT c_custkey, '[NAME_REDACTED]' AS c_name, 'HASH_' || left(sha256(contact_mail), 8) AS contact_mail FROM ({PEOPLE_SQL})""")
def mask_pii(t):
    df = privacy.mask_pii(people(t), "c_name", "name")
    return privacy.mask_pii(df, "contact_mail", "email", "hash").select("c_custkey", "c_name", "contact_mail")


@query("mask_pii_fake", f"""
WITH s AS (SELECT c_custkey, ('0x' || left(md5(c_name), 13))::BIGINT AS a, ('0x' || left(md5(birth_day), 13))::BIGINT AS b, ('0x' || left(md5(source), 13))::BIGINT AS i FROM ({PEOPLE_SQL}))
SELECT c_custkey, ['Alex', 'Jordan', 'Morgan', 'Taylor', 'Casey', 'Riley', 'Quinn', 'Cameron'][a % 8 + 1] || ' ' ||
  ['Smith', 'Jones', 'Williams', 'Brown', 'Davis', 'Miller', 'Wilson', 'Moore'][(a // 10) % 8 + 1] AS c_name,
  (1950 + b % 55) || '-' || lpad(CAST(b % 12 + 1 AS VARCHAR), 2, '0') || '-' || lpad(CAST(b % 28 + 1 AS VARCHAR), 2, '0') AS birth_day,
  '10.' || i % 254 + 1 || '.' || (i // 254) % 254 + 1 || '.' || (i // 64516) % 254 + 1 AS source FROM s""".replace(
    "'10.' || i % 254 + 1 || '.' || (i // 254) % 254 + 1 || '.' || (i // 64516) % 254 + 1",
    "'10.' || (i % 254 + 1) || '.' || ((i // 254) % 254 + 1) || '.' || ((i // 64516) % 254 + 1)"))
def mask_pii_fake(t):
    df = people(t)
    for name, kind in (("c_name", "name"), ("birth_day", "date_of_birth"), ("source", "ip_address")):
        df = privacy.mask_pii(df, name, kind, "fake")
    return df.select("c_custkey", "c_name", "birth_day", "source")


def mask_sql(c: str) -> str:
    # \\b knows ASCII letters only in this dialect: a marker of ASCII letters next
    # to the digits gives other letters the same word boundaries
    c = rf"regexp_replace(regexp_replace({c}, '(\pL)([0-9])', '\1qZq\2', 'g'), '([0-9][ \-]?)(\pL)', '\1qZq\2', 'g')"
    for kind in ("email", "credit_card", "ssn", "ip_address"):
        c = f"regexp_replace({c}, '{PII_PATTERNS[kind]}', '{REDACTION_LABELS[kind]}', 'g')"
    return f"replace({c}, 'qZq', '')"


@query("mask_pii_in_text", f"SELECT doc_id, {mask_sql('text')} AS text FROM documents")
def mask_pii_in_text(t):
    return privacy.mask_pii_in_text(t.documents.select("doc_id", "text"), "text", ["email", "credit_card", "ssn", "ip_address"])


@query("pii_counts_in_text", " UNION ALL ".join(
    f"SELECT '{k}' AS pii_type, count_if(regexp_matches(text, '{PII_PATTERNS[k]}')) AS rows, sum(len(regexp_extract_all(text, '{PII_PATTERNS[k]}')))::BIGINT AS matches FROM documents"
    for k in ("email", "ssn", "credit_card", "ip_address", "postcode_us")))
def pii_counts_in_text(t):
    return privacy.pii_counts_in_text(t.documents, "text", ["email", "ssn", "credit_card", "ip_address", "postcode_us"])


@query("hash_ids", "SELECT left(sha256('salt' || o_custkey), 16) AS o_custkey, o_orderkey FROM orders")
def hash_ids(t):
    return privacy.hash_ids(t.orders.select("o_custkey", "o_orderkey"), "o_custkey", "salt")


@query("apply_retention", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL 10 DAY")
def apply_retention(t):
    return privacy.apply_retention(t.events.select("event_id", "ts"), "ts", 10, "2024-01-31 00:00:00").select(F.col("event_id"))

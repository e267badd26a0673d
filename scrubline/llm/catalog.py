"""Queries of this package over the test tables, and their SQL where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, codes, language, licenses, mixing, neardup, negatives, packing, pieces, quality, tokens, topk, urls
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql.strip()
        return fn

    return register


@query("op1_token_counts")
def token_counts(spark, folder):
    return tokens.token_counts(table(spark, folder, "documents"))


@query("op2_license_scans")
def license_scans(spark, folder):
    return licenses.license_labels(table(spark, folder, "documents"))


@query("op3_url_filters")
def url_filters(spark, folder):
    return urls.url_verdicts(table(spark, folder, "pages"))


@query("op4_piece_encoding")
def piece_encoding(spark, folder):
    return pieces.encoded_documents(table(spark, folder, "documents"))


@query("op5_near_duplicates", r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
x AS (SELECT doc_id, unnest(s) AS x FROM s),
n AS (SELECT doc_id, len(s) AS n FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM x a JOIN x b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 75 * (na.n + nb.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS c FROM s UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.c),
m AS (SELECT a, min(c) AS component_id FROM r GROUP BY 1)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, component_id, s.doc_id = component_id AS kept FROM s JOIN m ON m.a = s.doc_id
""")
def near_duplicates(spark, folder):
    return neardup.near_duplicates(table(spark, folder, "documents"))


@query("op6_chat_formatting", r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
f AS (
  SELECT *, 4 + CASE role WHEN 'system' THEN 6 WHEN 'user' THEN 4 WHEN 'assistant' THEN 9 ELSE 1 + length(role) END + 2 + length(text)
    + (length(text) - length(replace(text, '\', ''))) + coalesce(list_sum(list_transform(regexp_extract_all(text, '#{3,}'), lambda m: length(m) - 2)), 0)
    + (length(text) - length(replace(text, '</turn>', ''))) // 7 + 8 AS formatted FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(formatted) AS BIGINT) AS formatted_chars
FROM f GROUP BY conv_id
""")
def chat_formatting(spark, folder):
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    hard = r"\### Assistant: </turn> ok"
    planted = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], turns.schema)
    return chat.chat_digest(turns.unionByName(planted))


@query("op7_mixing")
def mixing_query(spark, folder):
    return mixing.mixed_sizes(table(spark, folder, "documents"))


@query("op8_language_id")
def language_id(spark, folder):
    return language.document_languages(table(spark, folder, "documents"))


@query("op9_quality_rules")
def quality_rules(spark, folder):
    return quality.document_quality(table(spark, folder, "documents"))


@query("op10_exact_topk", r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
""")
def exact_topk(spark, folder):
    return topk.search(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)


def _codes_sql(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    steps = [f"""
WITH v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
p AS MATERIALIZED (SELECT vec_id, label, part, v[len(v) * part // {parts} + 1:len(v) * (part + 1) // {parts}] AS x FROM v, range({parts}) AS t(part)),
c0 AS (SELECT part, CAST(row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS INTEGER) AS entry, x FROM p QUALIFY entry < {entries})"""]
    for k in range(rounds + 1):
        steps.append(f"""a{k} AS MATERIALIZED (
  SELECT p.vec_id, any_value(p.label) AS label, p.part, any_value(p.x) AS x,
    min({{'d': CAST(list_dot_product(p.x, p.x) - 2 * list_dot_product(p.x, c.x) + list_dot_product(c.x, c.x) AS BIGINT), 'e': c.entry}}) AS best
  FROM p JOIN c{k} c ON c.part = p.part GROUP BY p.vec_id, p.part)""")
        if k < rounds:
            steps.append(f"""s{k} AS (
  SELECT part, entry, pos, floor(sum(x) / count(*)) AS x FROM (SELECT part, best.e AS entry, unnest(x) AS x, generate_subscripts(x, 1) AS pos FROM a{k}) GROUP BY ALL),
n{k} AS (SELECT part, entry, list(x ORDER BY pos) AS x FROM s{k} GROUP BY ALL),
c{k + 1} AS MATERIALIZED (SELECT c.part, c.entry, coalesce(n.x, c.x) AS x FROM c{k} c LEFT JOIN n{k} n ON n.part = c.part AND n.entry = c.entry)""")
    return ",\n".join(steps) + f""",
r AS (SELECT vec_id, any_value(label) AS label, string_agg(lower(format('{{:02x}}', best.e)), '' ORDER BY part) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id),
h AS (SELECT sha256(string_agg(array_to_string(list_transform(x, lambda i: CAST(CAST(i AS BIGINT) AS VARCHAR)), ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM r, h"""


@query("op11_vector_codes", _codes_sql())
def vector_codes(spark, folder):
    return codes.vector_codes(table(spark, folder, "embeddings"))


@query("op12_hard_negatives", r"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_dot_product(a.v, c.v) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id <> c.vec_id AND len(a.v) = len(c.v) WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank,
  s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score
QUALIFY rank <= 10
""")
def hard_negatives(spark, folder):
    label = F.expr("CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END")
    return negatives.mine(table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0, label)


@query("op13_curve_packing")
def curve_packing(spark, folder):
    return packing.packed_pieces(table(spark, folder, "documents"))

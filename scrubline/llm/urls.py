"""URL filters: rules first, and for URLs without one a ratio of two character language models.

URLs that the rules accept and reject train two Markov models over a fixed
alphabet of 40 symbols.  The models are of variable order: a context of up to
three symbols is interpolated with its shorter ones by Witten-Bell smoothing, so
a context counts as far as it has been seen.  A URL's score is the mean over its
symbols of log P(accepted) - log P(rejected); the threshold is the one with the
best balanced accuracy on a fifth of the labelled URLs, chosen by a hash of the
URL, which the models don't learn from.

Counts are gathered over all labelled URLs.  The table of counts has at most
40^4 entries for a class whatever the input, so it may pass through the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_batches

ALPHABET = "abcdefghijklmnopqrstuvwxyz0./-_?=&%:#+"
SYMBOLS, CONTEXT = 40, 3
_START, _OTHER = 39, 38
_BINS, _RANGE = 2048, 8.0


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: the rules of the contract
RULES = (Rule("net", "/", "block"), Rule("example.net", "/en/", "allow"), Rule("example.com", "/de/", "block"), Rule("org", "/fr/", "allow"))


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ``://``."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    url = F.coalesce(url, F.lit(""))
    host = F.translate(F.regexp_extract(url, pattern, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(url, pattern, 2)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, else null."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.text)):  # the last one that fits wins
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        text, verdict = F.when(fits, F.lit(rule.text)).otherwise(text), F.when(fits, F.lit(rule.verdict)).otherwise(verdict)
    return text, verdict


def _byte_codes() -> bytes:
    codes = [_OTHER] * 256
    for i, c in enumerate(ALPHABET):
        codes[ord(c)] = i
    for c in range(26):
        codes[65 + c] = c
    for c in range(10):
        codes[48 + c] = ALPHABET.index("0")
    return bytes(codes)


def grams(urls: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """For every symbol of every URL the number of its 4-gram, and where each URL begins."""
    codes, start = _byte_codes(), bytes([_START] * CONTEXT)
    coded = [u.encode("utf-8", "surrogatepass").translate(codes) for u in urls]
    sizes = np.array([len(c) for c in coded], np.int64)
    x = np.frombuffer(b"".join(start + c for c in coded), np.uint8).astype(np.int64)
    if not sizes.sum():
        return np.zeros(0, np.int64), sizes
    g = ((x[:-3] * SYMBOLS + x[1:-2]) * SYMBOLS + x[2:-1]) * SYMBOLS + x[3:]
    # 4-grams whose last symbol is padding belong to no URL
    return g[x[3:] != _START], sizes


def _counts(batches):
    """(class, 4-gram) counts of what a task reads; column 0: accepted or not, column 1: URL."""
    total = np.zeros((2, SYMBOLS ** 4), np.int64)
    for batch in batches:
        kinds, urls = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for kind in (0, 1):
            g, _ = grams([u for k, u in zip(kinds, urls, strict=True) if k == kind])
            total[kind] += np.bincount(g, minlength=SYMBOLS ** 4)
    for kind in (0, 1):
        seen = np.flatnonzero(total[kind])
        yield {"kind": [kind] * len(seen), "gram": seen.tolist(), "n": total[kind][seen].tolist()}


def log_probabilities(counts: np.ndarray) -> np.ndarray:
    """log P(symbol | up to three before it), Witten-Bell over orders 0 to 3; for each 4-gram."""
    n = counts.reshape((SYMBOLS,) * 4).astype(np.float64)
    p = np.full(SYMBOLS, 1.0 / SYMBOLS)
    for order in range(CONTEXT + 1):
        c = n.sum(axis=tuple(range(CONTEXT - order)))
        seen, kinds = c.sum(axis=-1, keepdims=True), (c > 0).sum(axis=-1, keepdims=True)
        p = np.where(seen > 0, (c + kinds * p) / np.maximum(seen + kinds, 1), p)
    return np.log(p).reshape(-1)


def _scored(ratio, keep: int):
    def run(batches):
        table = ratio.value
        for batch in batches:
            g, sizes = grams(batch.column(keep).to_pylist())
            total = np.concatenate([[0.0], np.cumsum(table[g])])
            ends = np.cumsum(sizes)
            score = np.where(sizes > 0, (total[ends] - total[ends - sizes]) / np.maximum(sizes, 1), 0.0)
            yield {**{name: batch.column(i) for i, name in enumerate(batch.schema.names[:keep])}, "score": score.tolist()}

    return run


def _threshold(held: DataFrame) -> float:
    """Of (kind, score): the cut with the best balanced accuracy, from a histogram of fixed size."""
    bins = F.least(F.greatest(F.floor((F.col("score") + _RANGE) * (_BINS / (2 * _RANGE))), F.lit(0)), F.lit(_BINS - 1))
    table = np.zeros((2, _BINS))
    for row in held.groupBy("kind", bins.alias("bin")).count().collect():
        table[row["kind"], row["bin"]] = row["count"]
    if not table.sum(axis=1).all():
        return 0.0
    share = table / table.sum(axis=1, keepdims=True)
    below = np.concatenate([np.zeros((2, 1)), np.cumsum(share, axis=1)], axis=1)
    gain = below[0] - below[1]  # rejected ones under the cut less accepted ones under it
    edges = np.arange(_BINS + 1) * (2 * _RANGE / _BINS) - _RANGE
    best = edges[gain >= gain.max() - 1e-12]
    return float((best.min() + best.max()) / 2)


def url_verdicts(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict, score) for every row; the rule's verdict, else the models'.

    ``score`` is the URL's mean log ratio less the threshold: 0 and more is
    allow.  Without URLs accepted by a rule, or without rejected ones, there is
    nothing to compare: score is null and URLs without a rule are allowed.

    A null URL, and one without ``://``, has an empty host and path and fits no
    rule; an empty one scores as many as the threshold says of a ratio of 0.
    Repeated rows are judged alike; equal or null ids stay apart; long URLs are
    taken whole.  Other columns are not read.  An empty table gives an empty
    result.
    """
    spark = pages.sparkSession
    host, path = url_parts(F.col(f"`{url_col}`"))
    ruled = pages.select(F.col(f"`{id_col}`").alias("id"), host.alias("host"), path.alias("path"), F.coalesce(F.col(f"`{url_col}`").cast("string"), F.lit("")).alias("url"))
    text, verdict = rule_of(F.col("host"), F.col("path"), rules)
    ruled = ruled.select("id", "host", "path", text.alias("rule"), verdict.alias("verdict"), "url")
    labelled = ruled.where("verdict IS NOT NULL").select((F.col("verdict") == "allow").cast("int").alias("kind"), "url")
    held = F.crc32(F.encode("url", "utf-8")) % 5 == 0
    counted = map_batches(labelled.where(~held), _counts, T.StructType([
        T.StructField("kind", T.IntegerType()), T.StructField("gram", T.LongType()), T.StructField("n", T.LongType())]))
    found = counted.groupBy("kind", "gram").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros((2, SYMBOLS ** 4), np.int64)
    counts[found["kind"], found["gram"]] = found["n"]
    columns = ["id", "host", "path", "rule", "verdict"]
    if not counts.sum(axis=1).all():
        return ruled.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("verdict", F.lit("allow")).alias("verdict"), F.lit(None).cast("double").alias("score"))
    ratio = spark.sparkContext.broadcast((log_probabilities(counts[1]) - log_probabilities(counts[0])).astype(np.float32))
    kind = T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("score", T.DoubleType())])
    cut = _threshold(map_batches(labelled.where(held), _scored(ratio, 1), kind))
    scored = map_batches(ruled, _scored(ratio, len(columns)), T.StructType([*(ruled.schema[c] for c in columns), T.StructField("score", T.DoubleType())]))
    score = F.col("score") - F.lit(cut)
    return scored.select(F.col("id").alias(id_col), "host", "path", "rule",
                         F.coalesce("verdict", F.when(score >= 0, "allow").otherwise("block")).alias("verdict"), score.alias("score"))

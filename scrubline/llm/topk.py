"""Exact top-k search by inner product, with a table of distances to pivots.

Vectors are compared in blocks: every block of queries meets every block of
candidates in a task of its own.  For each vector the distances to the pivots
are known.  By the triangle inequality a query and a candidate are at least
max over pivots |d(q, p) - d(c, p)| apart, so their inner product, which is
(|q|^2 + |c|^2 - distance^2) / 2, has an upper bound.  Candidates are evaluated in
the order of their bounds, in two steps: the ones with the highest bounds, and then
those whose bounds the k-th best score of the first ones doesn't exceed.  What each
block finds is merged to the k best.

The pivots are vectors of the table, chosen by a hash of the id, up to a stated
number; they only order and prune, the result doesn't depend on them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import _reach_package
from .vectors import whole_vector

PIVOTS = 32
QUERY_ROWS, CANDIDATE_ROWS = 1024, 8192
#: candidates of the highest bounds that are evaluated first, queries looked at together, part of candidates from which a matrix product pays
_STEP, _GROUP, _DENSE = 256, 32, 0.1
#: below this absolute value sums of products are exact in doubles
_EXACT = float(1 << 52)


def _matrix(rows: list, dim: int, kind=np.int64) -> np.ndarray:
    return np.array(rows, kind).reshape(len(rows), dim)


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = (x ** 2).sum(axis=1)[:, None] + (pivots ** 2).sum(axis=1)[None, :] - 2.0 * (x @ pivots.T)
    return np.sqrt(np.maximum(square, 0.0))


def _bounds(dq: np.ndarray, dc: np.ndarray, q_squares: np.ndarray, c_squares: np.ndarray) -> np.ndarray:
    """Queries x candidates: no inner product is above these, by the pivot that parts the two the most."""
    lower, gap = np.zeros((len(dq), len(dc))), np.empty((len(dq), len(dc)))
    for j in range(dq.shape[1]):
        np.subtract(dc[:, j][None, :], dq[:, j][:, None], out=gap)
        np.abs(gap, out=gap)
        np.maximum(lower, gap, out=lower)
    both = q_squares[:, None] + c_squares[None, :]
    # a little more than the bound, for rounding
    return (both - lower * lower) / 2 + 1e-6 * both + 1e-6


def block_topk(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, pivots: np.ndarray, k: int, seen: list | None = None):
    """(query, candidate, score) rows: for each query its k best of these candidates, ties to the smaller id.

    For each query the candidates with the highest bounds are evaluated first; the
    k-th best of their scores leaves the candidates whose bounds reach it, and only
    they are evaluated then.  Where more than a part ``_DENSE`` of a group of queries'
    candidates is left, one matrix product evaluates them.  ``seen`` gets the number
    of evaluated pairs and of all.
    """
    exact = max(float(np.abs(q).max(initial=0)), 1.0) * max(float(np.abs(c).max(initial=0)), 1.0) * max(q.shape[1], 1) < _EXACT
    qf, cf = q.astype(np.float64), c.astype(np.float64)
    qv, cv = (qf, cf) if exact else (q.astype(np.int64), c.astype(np.int64))
    dq, dc = _distances(qf, pivots), _distances(cf, pivots)
    q_squares, c_squares = (qf * qf).sum(axis=1), (cf * cf).sum(axis=1)
    out_q, out_c, out_s = [], [], []
    n = len(c)
    for at in range(0, len(q), _GROUP):
        group = slice(at, min(at + _GROUP, len(q)))
        bound = _bounds(dq[group], dc, q_squares[group], c_squares)
        bound[q_ids[group][:, None] == c_ids[None, :]] = -np.inf
        first = np.argpartition(-bound, _STEP - 1, axis=1)[:, :_STEP] if n > _STEP else np.broadcast_to(np.arange(n), (len(bound), n))
        scores = np.matmul(cv[first], qv[group][:, :, None])[:, :, 0]
        open_first = np.take_along_axis(bound, first, axis=1) > -np.inf
        rest = bound > -np.inf
        if first.shape[1] >= k:
            low = np.where(open_first, scores, np.iinfo(np.int64).min if scores.dtype.kind == "i" else -np.inf)
            rest &= bound >= np.partition(low, -k, axis=1)[:, -k][:, None]
        if n > _STEP:
            np.put_along_axis(rest, first, False, axis=1)
        else:
            rest[:] = False
        dense = rest.mean() > _DENSE if rest.size else False
        product = qv[group] @ cv.T if dense else None
        if seen is not None:
            seen.append((int(first.size + rest.sum()), int(rest.size)))
        for i in range(len(bound)):
            more = np.flatnonzero(rest[i])
            there = product[i, more] if dense else cv[more] @ qv[at + i]
            mine = first[i][open_first[i]]
            ids, found = np.concatenate([c_ids[mine], c_ids[more]]), np.concatenate([scores[i][open_first[i]], there])
            if len(ids) > k:
                # ties of the k-th score stay for the choice by id
                keep = found >= np.partition(found, len(found) - k)[len(found) - k]
                ids, found = ids[keep], found[keep]
            best = np.lexsort((ids, -found))[:k]
            out_q += [int(q_ids[at + i])] * len(best)
            out_c += ids[best].tolist()
            out_s += [int(s) for s in found[best]]
    return out_q, out_c, out_s


def search(vectors: DataFrame, queries, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64) -> DataFrame:
    """(query_id, rank, id, score): each query's k highest inner products of scaled vectors, ties to the smaller id.

    ``queries`` is a condition on the table that picks the queries; candidates
    are all rows with another id.  Vectors are compared with those of the same
    length.  Rows with a null id, a null vector, a null or non-finite component, or
    one so large that a score might not fit a long (``whole_vector``) take no part; vectors without a component score 0.  Repeated rows
    are candidates of their own; a repeated query is one query.  Other columns
    are not read.  An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    _reach_package(spark)
    rows = vectors.where(F.col(f"`{id_col}`").isNotNull()).select(F.col(f"`{id_col}`").cast("long").alias("id"), whole_vector(F.col(f"`{vector_col}`"), scale).alias("v"), queries.alias("query")).where("v IS NOT NULL")
    rows = rows.withColumn("dim", F.size("v"))
    n, n_queries = rows.agg(F.count("*"), F.count_if("query")).first()
    q_blocks, c_blocks = max(1, -(-n_queries // QUERY_ROWS)), max(1, -(-n // CANDIDATE_ROWS))
    chosen = rows.select("id", "dim", "v").orderBy(F.xxhash64("id"), "id").limit(PIVOTS).collect()
    pivots = spark.sparkContext.broadcast([(r["dim"], np.array(r["v"], np.float64)) for r in chosen])

    # block numbers have one type on both sides, as cogroup hashes each side's own
    asked = rows.where("query").select("dim", F.pmod(F.xxhash64("id"), F.lit(q_blocks)).cast("int").alias("qb"), "id", "v").dropDuplicates(["id", "v"])
    asked = asked.withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(c_blocks - 1))))
    found = rows.select("dim", F.pmod(F.xxhash64("id", "v"), F.lit(c_blocks)).cast("int").alias("cb"), "id", "v")
    found = found.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))))

    def compare(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        q, c, s = [], [], []
        if len(left) and len(right):
            dim = int(key[0])
            at = _matrix([p for size, p in pivots.value if size == dim], dim, np.float64)
            q, c, s = block_topk(left["id"].to_numpy(np.int64), _matrix(left["v"].tolist(), dim), right["id"].to_numpy(np.int64), _matrix(right["v"].tolist(), dim), at, k)
        return pd.DataFrame({"query_id": pd.Series(q, dtype="int64"), "id": pd.Series(c, dtype="int64"), "score": pd.Series(s, dtype="int64")})

    keys = ("dim", "qb", "cb")
    each = asked.groupBy(*keys).cogroup(found.groupBy(*keys)).applyInPandas(compare, T.StructType([
        T.StructField("query_id", T.LongType()), T.StructField("id", T.LongType()), T.StructField("score", T.LongType())]))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return each.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")

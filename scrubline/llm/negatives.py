"""Hard negatives by exact scores from subset-sum tables (the method of four Russians).

The dimensions of a vector are taken in groups of eight.  For each group an anchor
has a table with the sums of all 256 subsets of its eight components.  Candidates
are kept as bit planes: a plane holds one bit of every component, eight components
to a byte, in two's complement.  An anchor's score with a candidate is the sum over
planes of 2^bit x (table entries at the plane's bytes, added up over the groups),
the sign plane counting negative; planes are worked through from the top, doubling
the sum at each step.  Scores are whole integers, so nothing is estimated.

Candidates stand in blocks, sorted by label, whose planes are packed once.  Blocks
of anchors meet every block of candidates of the same length.  Two passes score
each pair once: the first scores an anchor with the rows of its own label, which
gives its positives; the second, which knows the ranges that they allow, with all
others.  Each block gives its own best rows only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.cut import cut
from .common import map_batches
from .vectors import Gathered, whole_vector

POSITIVES, NEGATIVES = 5, 10
ANCHOR_ROWS, CANDIDATE_ROWS = 256, 8192
#: candidates scored at once
_STEP = 1024


def bit_planes(x: np.ndarray) -> np.ndarray:
    """Planes x groups x rows of bytes; the top plane is the sign."""
    n, dim = x.shape
    bits = max(int(x.max(initial=0)).bit_length(), (-int(x.min(initial=0)) - 1).bit_length() if x.min(initial=0) < 0 else 0) + 1
    groups = -(-dim // 8)
    out = np.zeros((bits, groups, n), np.uint8)
    for b in range(bits):
        out[b] = np.packbits(((x >> b) & 1).astype(np.uint8), axis=1, bitorder="little").T
    return out


def subset_sums(anchors: np.ndarray, kind=np.int64) -> np.ndarray:
    """Groups x 256 x anchors: for each byte the sum of the components whose bit is set."""
    n, dim = anchors.shape
    groups = -(-dim // 8)
    wide = np.zeros((n, groups * 8), kind)
    wide[:, :dim] = anchors
    out = np.zeros((groups, 256, n), kind)
    for j in range(8):
        out[:, 1 << j:2 << j] = out[:, :1 << j] + wide[:, j::8].T[:, None, :]
    return out


def scores(tables: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """Rows x anchors of inner products."""
    bits, groups, n = planes.shape
    out = np.zeros((n, tables.shape[2]), tables.dtype)
    for at in range(0, n, _STEP):
        part = out[at:at + _STEP]
        for b in range(bits - 1, -1, -1):
            for g in range(groups):
                part += tables[g].take(planes[b, g, at:at + _STEP], axis=0)
            if b == bits - 1:
                np.negative(part, out=part)
            if b:
                part <<= 1
    return out


def _kind(anchors: np.ndarray, bits: int):
    most = max(int(np.abs(anchors).max(initial=0)), 1) * max(anchors.shape[1], 1) << (bits + 1)
    return np.int32 if most < 1 << 31 else np.int64


def _best(found: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """Of the rows the k with the highest scores, ties to the smaller id."""
    if len(rows) > k:
        values = found[rows]
        rows = rows[values >= np.partition(values, len(rows) - k)[len(rows) - k]]
    return rows[np.lexsort((ids[rows], -found[rows].astype(np.int64)))[:k]]


def _blocks(size: int, pack):
    """(id, label, vector, ...) rows -> blocks of rows of one vector length."""

    def run(batches):
        from pyspark import TaskContext

        gathered, number = Gathered(size), TaskContext.get().partitionId() << 32
        for batch in batches:
            for block in gathered.add(batch, 2):
                yield pack(number, *block)
                number += 1
        for block in gathered.rest():
            yield pack(number, *block)
            number += 1

    return run


def _candidate_block(number, dim, others, matrix):
    ids, labels = (others[i].to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
    order = np.lexsort((ids, labels))
    planes = bit_planes(matrix[order])
    return {"dim": [dim], "block": [number], "ids": [ids[order].tobytes()], "labels": [labels[order].tobytes()], "bits": [planes.shape[0]], "planes": [planes.tobytes()]}


_CANDIDATES = T.StructType([T.StructField("dim", T.IntegerType()), T.StructField("block", T.LongType()), T.StructField("ids", T.BinaryType()),
                            T.StructField("labels", T.BinaryType()), T.StructField("bits", T.IntegerType()), T.StructField("planes", T.BinaryType())])


def _anchor_block(number, dim, others, matrix):
    ids, labels = (others[i].to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
    extra = {}
    if len(others) > 3:
        extra = {"positives": pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), others[3])}
    return {"dim": [dim], "a_ids": [ids.tobytes()], "a_labels": [labels.tobytes()], "a_rows": [np.ascontiguousarray(matrix, np.int64).tobytes()], **extra}


_ANCHORS = [T.StructField("dim", T.IntegerType()), *(T.StructField(n, T.BinaryType()) for n in ("a_ids", "a_labels", "a_rows"))]


def _met(anchors: DataFrame, candidates: DataFrame, places: int) -> DataFrame:
    """Each block of anchors beside each block of candidates of its length: anchors go to every place, candidates have one."""
    there = anchors.withColumn("place", F.explode(F.sequence(F.lit(0), F.lit(places - 1))))
    here = candidates.withColumn("place", F.pmod(F.xxhash64("block"), F.lit(places)).cast("int"))
    return there.join(here, ["dim", "place"])


def _groups(row: dict):
    """For each label of a block of anchors: positions of its anchors, their tables, and the label's slice of the candidates."""
    a_ids, a_labels = (np.frombuffer(row[c], np.int64) for c in ("a_ids", "a_labels"))
    vectors = np.frombuffer(row["a_rows"], np.int64).reshape(len(a_ids), row["dim"])
    labels = np.frombuffer(row["labels"], np.int64)
    planes = np.frombuffer(row["planes"], np.uint8).reshape(row["bits"], -(-row["dim"] // 8), len(labels))
    kind = _kind(vectors, row["bits"])
    for label in np.unique(a_labels):
        mine = np.flatnonzero(a_labels == label)
        first, last = np.searchsorted(labels, label, "left"), np.searchsorted(labels, label, "right")
        yield a_ids, mine, subset_sums(vectors[mine], kind), planes, int(first), int(last)


def _positive_rows(k: int):
    def run(batches):
        for batch in batches:
            out = {"anchor_id": [], "id": [], "score": []}
            for n in range(batch.num_rows):
                row = {c: batch.column(i)[n].as_py() for i, c in enumerate(batch.schema.names)}
                ids = np.frombuffer(row["ids"], np.int64)
                for a_ids, mine, tables, planes, first, last in _groups(row):
                    if first == last:
                        continue
                    found, own = scores(tables, planes[:, :, first:last]), ids[first:last]
                    for j, anchor in enumerate(a_ids[mine].tolist()):
                        best = _best(found[:, j], own, np.flatnonzero(own != anchor), k)
                        out["anchor_id"] += [anchor] * len(best)
                        out["id"] += own[best].tolist()
                        out["score"] += found[best, j].tolist()
            yield out

    return run


def _negative_rows(k: int, low: int, high: int):
    def run(batches):
        for batch in batches:
            out = {c: [] for c in ("anchor_id", "place", "positive_id", "positive_score", "id", "score")}
            for n in range(batch.num_rows):
                row = {c: batch.column(i)[n].as_py() for i, c in enumerate(batch.schema.names)}
                ids = np.frombuffer(row["ids"], np.int64)
                for a_ids, mine, tables, planes, first, last in _groups(row):
                    others = np.concatenate([ids[:first], ids[last:]])
                    if not len(others):
                        continue
                    found = np.concatenate([scores(tables, planes[:, :, :first]), scores(tables, planes[:, :, last:])])
                    for j, at in enumerate(mine.tolist()):
                        here = np.ascontiguousarray(found[:, j])
                        for place, positive in enumerate(row["positives"][at]):
                            value = positive["score"]
                            # low * value <= 100 * negative <= high * value
                            best = _best(here, others, np.flatnonzero((here >= -(-low * value // 100)) & (here <= high * value // 100)), k)
                            out["anchor_id"] += [int(a_ids[at])] * len(best)
                            out["place"] += [place] * len(best)
                            out["positive_id"] += [positive["id"]] * len(best)
                            out["positive_score"] += [value] * len(best)
                            out["id"] += others[best].tolist()
                            out["score"] += here[best].tolist()
            yield out

    return run


def _longs(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.LongType()) for n in names])


def mine(vectors: DataFrame, anchors: Column, label: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = 30, high: int = 90,
         scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``anchors`` is a condition on the table, ``label`` an expression of a whole
    number.  A score is the inner product of vectors whose components are
    floor(scale * x).  An anchor's positives are its best other rows of the same
    label; for each of them the best rows of other labels are returned whose
    scores lie between ``low`` and ``high`` percent of the positive's.  Ties go to
    the smaller id.

    Rows take no part if the id, label or vector is null, or the vector holds null
    or non-finite components or some too large for exact sums (``whole_vector``).
    Vectors are compared with those of the same length; vectors without a
    component score 0.  If several rows have an anchor's id, the one with the least
    label, then vector, is the anchor; none of them is its positive.  As candidates repeated rows
    count one by one.  Other columns are not read.  Without anchors, or for an
    empty table, the result is empty.
    """
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), label.cast("long").alias("label"), whole_vector(F.col(f"`{vector_col}`"), scale).alias("v"),
                          F.coalesce(anchors, F.lit(False)).alias("anchor")).where("id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL")
    candidates = cut(map_batches(rows.select("id", "label", "v"), _blocks(CANDIDATE_ROWS, _candidate_block), _CANDIDATES))
    places = max(1, candidates.count())
    asked = cut(rows.where("anchor").groupBy("id").agg(F.min(F.struct("label", "v")).alias("x")).select("id", "x.label", "x.v"))

    blocks = map_batches(asked, _blocks(ANCHOR_ROWS, _anchor_block), T.StructType(_ANCHORS))
    same = map_batches(_met(blocks, candidates, places), _positive_rows(positives), _longs("anchor_id", "id", "score"))
    rank = F.row_number().over(W.partitionBy("anchor_id").orderBy(F.desc("score"), "id"))
    listed = same.withColumn("r", rank).where(F.col("r") <= positives).groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("r", "id", "score"))).alias("positives"))

    ready = asked.join(listed, F.col("id") == F.col("anchor_id")).select("id", "label", "v", "positives")
    blocks = map_batches(ready, _blocks(ANCHOR_ROWS, _anchor_block), T.StructType([*_ANCHORS, T.StructField("positives", T.ArrayType(ready.schema["positives"].dataType))]))
    other = map_batches(_met(blocks, candidates, places), _negative_rows(negatives, low, high), _longs("anchor_id", "place", "positive_id", "positive_score", "id", "score"))
    rank = F.row_number().over(W.partitionBy("anchor_id", "place").orderBy(F.desc("score"), "id"))
    return other.withColumn("rank", rank).where(F.col("rank") <= negatives).select(
        "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))

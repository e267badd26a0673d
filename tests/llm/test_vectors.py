"""Vector codes and hard negatives against brute force."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scrubline.llm import catalog, codes, negatives
from scrubline.llm.common import table

SMALL = "/root/testdata/sf0.001"
SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType()),
                       T.StructField("ID", T.StringType()), T.StructField("code", T.StringType()), T.StructField("Score", T.DoubleType())])


def hard_rows(seed, n, dim=8):
    """Rows with ties, repeats, nulls, other lengths and values that take no part."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, dim))
    rows = []
    for i in range(n):
        v = (centres[i % 5] + 0.2 * rng.normal(size=dim)).round(1).tolist()
        rows.append((i, v, int(rng.integers(0, 3)) if i % 11 else None, "x", "y", 0.5))
    hot = centres[0].round(1).tolist()
    rows += [(n + i, hot, 1, None, None, None) for i in range(n // 3)]
    rows += [(3, rows[3][1], 2, "x", "y", 1.0), (9001, None, 1, "x", "y", 1.0), (9002, [None] * dim, 1, "x", "y", 1.0), (9003, [float("nan")] * dim, 1, "x", "y", 1.0),
             (9004, [float("inf")] + hot[1:], 1, "x", "y", 1.0), (9005, [1e17] * dim, 1, "x", "y", 1.0), (9100, hot[:3], 1, "x", "y", 1.0), (9200, hot[:3], 2, "x", "y", 1.0),
             (9300, [], 0, "x", "y", 1.0), (9400, [], 1, "x", "y", 1.0), (None, hot, 1, "x", "y", 1.0)]
    return rows


def whole(v, scale):
    if v is None or any(x is None or not np.isfinite(x) or abs(x) > 1e9 for x in v):
        return None
    return [int(np.floor(scale * float(np.float32(x)))) for x in v]


def plain_codes(rows, parts=4, entries=256, rounds=4):
    by_dim = {}
    for i, v, label, *_ in rows:
        w = whole(v, 1024)
        if w is not None:
            by_dim.setdefault(len(w), []).append((i is None, i or 0, w, label))
    out, numbers = [], []
    for dim in sorted(by_dim):
        kept = sorted(by_dim[dim], key=lambda r: r[:3])
        cuts = codes.part_bounds(dim, parts)
        found = []
        for p in range(parts):
            x = [r[2][cuts[p]:cuts[p + 1]] for r in kept]
            book = [list(v) for v in x[:entries]]
            near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, e)), k) for k, e in enumerate(book))  # noqa: B023, E731
            for _ in range(rounds):
                owners = {}
                for v in x:
                    owners.setdefault(near(v)[1], []).append(v)
                for k, of in owners.items():
                    book[k] = [sum(c) // len(of) for c in zip(*of)]
            found.append([near(v) for v in x])
            numbers += [str(n) for e in book for n in e]
        for k, r in enumerate(kept):
            out.append((None if r[0] else r[1], r[3], "".join(f"{f[k][1]:02x}" for f in found), sum(f[k][0] for f in found)))
    totals = {}
    for _, label, _, error in out:
        totals[label] = totals.get(label, 0) + error
    digest = hashlib.sha256(",".join(numbers).encode()).hexdigest()
    return sorted(((i, c, e, totals[label], digest) for i, label, c, e in out), key=str)


@pytest.mark.parametrize("block", [4096, 40])
def test_codes_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(codes, "BLOCK_ROWS", block)
    rows = hard_rows(1, 400 if block > 40 else 150)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = codes.vector_codes(df)
    assert sorted((tuple(r[c] for c in ("vec_id", "code", "error", "label_error", "codebooks_sha256")) for r in found.collect()), key=str) == plain_codes(rows)


def test_codes_of_an_empty_table(spark):
    assert codes.vector_codes(spark.createDataFrame([], SCHEMA)).collect() == []


def test_tree_owns_every_point_once():
    rng = np.random.default_rng(2)
    points = np.concatenate([rng.integers(-900, 900, (700, 6)), np.zeros((300, 6), np.int64)])
    tree = codes.grow(points)
    assert sorted(tree["order"].tolist()) == list(range(1000))
    assert (tree["sums"][tree["root"][0]] == points.sum(axis=0)).all()
    for entries in (points[:1], points[:40], np.repeat(points[:5], 3, axis=0)):
        of = np.full(1000, -1)
        for entry, what in codes.owned(tree, entries):
            a, b = (tree["first"][what], tree["last"][what]) if isinstance(entry, int) else what
            assert (of[a:b] == -1).all()
            of[a:b] = entry
        far = ((tree["points"][:, None, :] - entries[None, :, :]) ** 2).sum(axis=2)
        assert (of == far.argmin(axis=1)).all()


def test_near_points_are_owned_as_balls():
    """Well-parted clusters: most points are taken by cached sums, without a look at them."""
    rng = np.random.default_rng(3)
    centres = rng.integers(-100_000, 100_000, (30, 16))
    points = (centres[rng.integers(0, 30, 3000)] + rng.integers(-50, 50, (3000, 16)))
    tree = codes.grow(points)
    taken = sum(int(tree["last"][w] - tree["first"][w]) for e, w in codes.owned(tree, centres) if isinstance(e, int))
    assert taken > 2900


def test_huge_components_stay_exact():
    x = np.array([[1 << 27, -(1 << 27)], [3, 5]])
    y = np.array([[-(1 << 27), (1 << 27) + 1]])
    assert codes._squares(x, y).tolist() == [[(1 << 28) ** 2 + ((1 << 28) + 1) ** 2], [((1 << 27) + 3) ** 2 + ((1 << 27) - 4) ** 2]]


def plain_negatives(rows, every=10, positives=5, negatives_=10):
    kept = [(i, label, whole(v, 256)) for i, v, label, *_ in rows if i is not None and label is not None and whole(v, 256) is not None]
    anchors = {}
    for i, label, v in sorted(kept, key=lambda r: (r[0], r[1], r[2])):
        if i % every == 0:
            anchors.setdefault(i, (label, v))
    out = []
    for a, (label, v) in anchors.items():
        scored = [(-sum(x * y for x, y in zip(v, w)), i, other) for i, other, w in kept if len(w) == len(v)]
        for score, positive, _ in sorted(s for s in scored if s[2] == label and s[1] != a)[:positives]:
            fit = sorted(s for s in scored if s[2] != label and 30 * -score <= 100 * -s[0] <= 90 * -score)
            out += [(a, positive, r + 1, s[1], -score, -s[0]) for r, s in enumerate(fit[:negatives_])]
    return sorted(out)


@pytest.mark.parametrize("size", [(256, 8192), (3, 50)])
def test_negatives_equal_brute_force(spark, monkeypatch, size):
    monkeypatch.setattr(negatives, "ANCHOR_ROWS", size[0])
    monkeypatch.setattr(negatives, "CANDIDATE_ROWS", size[1])
    rows = hard_rows(4, 300, 20)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = negatives.mine(df, F.col("vec_id") % 10 == 0, F.col("label"))
    columns = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    assert sorted(tuple(r[c] for c in columns) for r in found.collect()) == plain_negatives(rows)


def test_negatives_without_anchors(spark):
    df = spark.createDataFrame(hard_rows(5, 30), SCHEMA)
    assert negatives.mine(df, F.col("vec_id") < 0, F.col("label")).collect() == []
    assert negatives.mine(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 10 == 0, F.col("label")).collect() == []


@pytest.mark.parametrize("most", [1, 100, 1 << 20, 1 << 26])
def test_scores_are_inner_products(most):
    rng = np.random.default_rng(6)
    for dim in (0, 1, 7, 8, 64):
        a, c = rng.integers(-most, most, (5, dim)), rng.integers(-most, most, (3000, dim))
        planes = negatives.bit_planes(c)
        kind = negatives._kind(a, planes.shape[0])
        assert (negatives.scores(negatives.subset_sums(a, kind), planes) == c @ a.T).all()


def test_whole_tables(spark):
    n = table(spark, SMALL, "embeddings").count()
    assert catalog.QUERIES["op11_vector_codes"](spark, SMALL).count() == n
    assert catalog.QUERIES["op12_hard_negatives"](spark, SMALL).select("anchor_id").distinct().count() == 5

"""Operators that look at many rows together, against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from scrubline.llm import catalog, graphs, mixing, neardup, topk
from scrubline.llm.common import table

SMALL = "/root/testdata/sf0.001"


def shingles(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def components_of(rows):
    """{id: smallest linked id} of (id, text) rows by comparing all pairs."""
    sets = [(i, shingles(t)) for i, t in rows]
    up = {i: i for i, _ in rows}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, (a, s) in enumerate(sets):
        for b, t in sets[k + 1:]:
            if s and t and 100 * len(s & t) >= 75 * len(s | t):
                x, y = sorted((top(a), top(b)))
                up[y] = x
    return {i: top(i) for i in up}


def near_rows(seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    rows, passage = [], [word() for _ in range(60)]
    for _ in range(12):
        base = [word() for _ in range(rng.randint(60, 200))]
        for _ in range(rng.randint(1, 8)):
            copy = list(base)
            for _ in range(rng.randint(0, 6)):
                copy[rng.randrange(len(copy))] = word()
            rows.append(" ".join(copy))
    # a chain: each link holds, its ends are far apart
    chain = [word() for _ in range(120)]
    for _ in range(8):
        rows.append(" ".join(chain))
        at = rng.randrange(100)
        chain[at:at + 12] = [word() for _ in range(12)]
    # many documents with one passage in common
    rows += [" ".join(passage + [word() for _ in range(60)]) for _ in range(20)]
    rows += ["Four words Only here", "four  words\nonly HERE", "one", "ONE", "", None, " \t", "É a", "é a", "w " * 4000, "w " * 4001]
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_near_duplicates_equal_brute_force(spark):
    rows = near_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kept", F.lit("clash")).repartition(5)
    got = {r["doc_id"]: r for r in neardup.near_duplicates(df).collect()}
    want = components_of(rows)
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert all(r["n_shingles"] == len(shingles(dict(rows)[i])) and r["kept"] == (i == want[i]) for i, r in got.items())


def test_near_duplicates_odd_rows(spark):
    text = "one two three four five six seven"
    rows = [(None, text), (None, text), (3, text), (3, text), (5, text.upper()), (3, "other words than those of the first text"), (9, "other words than those of the first text")]
    got = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(None, None, True)] * 2 + [(3, 3, True)] * 3 + [(5, 3, False), (9, 3, False)], key=str)
    assert neardup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_estimate_is_close_to_the_similarity(spark):
    rng = random.Random(8)
    a = [str(rng.random()) for _ in range(2000)]
    rows = [(k, " ".join(a[:2000 - 100 * k] + [str(rng.random()) for _ in range(100 * k)])) for k in range(6)]
    batch = next(neardup._signatures([__import__("pyarrow").record_batch({"id": [r[0] for r in rows], "text": [r[1] for r in rows]})]))
    data = [tuple(int(batch[s][k]) for s in neardup._columns(neardup.MINIMA)) for k in range(6)]
    df = spark.createDataFrame([(k, *x, *data[0]) for k, x in enumerate(data)], "k int, " + ", ".join([f"a_{s} long" for s in neardup._columns(neardup.MINIMA)] + [f"b_{s} long" for s in neardup._columns(neardup.MINIMA)]))
    for r in df.select("k", neardup.estimate("a_", "b_").alias("e")).collect():
        s, t = shingles(rows[0][1]), shingles(rows[r["k"]][1])
        assert abs(r["e"] - len(s & t) / len(s | t)) < 0.13


def test_near_duplicates_take_batches_in_parts(spark):
    pa = __import__("pyarrow")
    n = 2 * neardup.ROWS + 3
    texts = [f"some words of text number {i}" for i in range(n)]
    sets = [neardup.shingle_set(t)[0].tobytes() for t in texts]
    wanted = spark.sparkContext.broadcast(neardup.np.full(1, 255, neardup.np.uint8))
    for run, columns in (
            (neardup._signatures, {"id": list(range(n)), "text": texts}),
            (neardup._sets_of(wanted), {"id": list(range(n)), "place": [i % 8 for i in range(n)], "text": texts}),
            (neardup._linked(75), {"a": list(range(n)), "b": list(range(n)), "x": sets, "y": sets})):
        parts = list(run([pa.record_batch(columns), pa.record_batch(columns).slice(0, 0)]))
        first = [p.get("id", p.get("a")).to_pylist() for p in parts]
        assert max(map(len, first)) <= neardup.ROWS and sum(first, []) == list(range(n))


def test_near_duplicates_join_a_signature_as_one_column(spark, monkeypatch):
    prefixed, widths = neardup._prefixed, []

    def seen(df, prefix):
        widths.append(len(df.columns))
        return prefixed(df, prefix)

    monkeypatch.setattr(neardup, "_prefixed", seen)
    assert neardup.near_duplicates(spark.createDataFrame(near_rows()[:40], "doc_id long, text string")).count() == 40
    assert widths and max(widths) <= 6


def test_components_of_paths_stars_and_cycles(spark):
    links = [(i, i + 1) for i in range(30)] + [(100, 100 + i) for i in range(1, 20)] + [(201, 202), (202, 203), (203, 201), (5, 5), (300, 299)]
    got = {r["node"]: r["component"] for r in graphs.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {got[i] for i in range(31)} == {0} and {got[100 + i] for i in range(20)} == {100} and {got[i] for i in (201, 202, 203)} == {201} and got[300] == 299


def test_components_of_links_that_come_later(spark):
    rng = random.Random(4)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)]
    whole = {r["node"]: r["component"] for r in graphs.components(spark.createDataFrame(links, "a long, b long")).collect()}
    found = None
    for part in (links[:60], [], links[60:100], links[100:]):
        found = graphs.joined_by(found, spark.createDataFrame(part, "a long, b long"))
    rows = found.collect()
    assert {r["node"]: r["component"] for r in rows} == whole and len(rows) == len(whole)


def targets_by_hand(sizes, weights=(5, 2, 1)):
    """Share by weight, stop at three times the size, share the excess again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    got, open_, left = dict.fromkeys(order, 0.0), set(order), float(sum(sizes.values()))
    while left > 1e-9 and open_:
        total = sum(weight[s] for s in open_)
        over = 0.0
        for s in list(open_):
            got[s] += left * weight[s] / total
            if got[s] >= 3 * sizes[s]:
                over += got[s] - 3 * sizes[s]
                got[s] = 3.0 * sizes[s]
                open_.discard(s)
        left = over
    return got


def mixing_rows():
    rng = random.Random(9)
    rows = [(i, " ".join(["w"] * rng.randint(0, 50)), rng.choice(["a", "b", "B", "é", None, "big", "big", "big", "big"])) for i in range(1500)]
    return rows + [(5000, None, "a"), (5001, "", "empty"), (6000, "again and again", "a"), (6000, "again and again", "a"), (None, "no id", "b"), (5002, "tiny", "zz")]


def test_mixing_meets_targets(spark):
    rows = mixing_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("clash"))
    got = [r.asDict() for r in mixing.mixed_sizes(df).collect()]
    again = [r.asDict() for r in mixing.mixed_sizes(df.repartition(7)).collect()]
    key = lambda r: str(sorted(r.items(), key=str))
    assert len(got) == len(rows) and sorted(map(key, got)) == sorted(map(key, again))
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += len((text or "").split())
    want = targets_by_hand(sizes)
    by_source = {i: s for i, _, s in rows}
    taken, longest = Counter(), 50
    for r in got:
        source = by_source[r["doc_id"]]
        assert abs(r["target"] - want[source]) < 1e-6 * max(1, want[source]) and r["source_size"] == sizes[source]
        assert 0 <= r["taken"] <= 3 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
        taken[source] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= longest for s in sizes)
    assert abs(sum(want.values()) - sum(sizes.values())) < 1e-6


def test_mixing_rows_are_repeated(spark):
    df = spark.createDataFrame(mixing_rows(), "doc_id long, text string, source string").withColumn("_copies", F.lit("clash"))
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns
    words = out.agg(F.sum(mixing.word_count(F.col("text")))).first()[0]
    assert words == mixing.mixed_sizes(df).agg(F.sum("taken")).first()[0]
    assert mixing.mixed_documents(df.limit(0)).count() == 0 and mixing.mixed_sizes(df.limit(0)).count() == 0
    assert mixing.mixed_sizes(df.where("text = ''")).agg(F.sum("taken")).first()[0] == 0


def test_pivotal_chances_are_kept(spark):
    rows = [(i, "s", "w " * (1 + i % 5)) for i in range(40)] + [(100, "t", "w " * 60)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    units = mixing._units(df, "doc_id", "source", "text")
    mean = Counter()
    for seed in range(12):
        for r in mixing.mix(units, seed=seed).where("source = 's'").collect():
            mean[r["id"]] += r["copies"] / 12
    share = mixing.mix(units).where("source = 's'").selectExpr("target / source_size").first()[0]
    assert abs(sum(mean.values()) / 40 - share) < 0.15


def vectors(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(400, 8)).astype(np.float32) / 3
    base[50:120] = base[0]
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    rows += [(1000, None), (1020, [None] + [0.1] * 7), (1040, [float("nan")] * 8), (1060, [float("inf")] + [0.0] * 7), (1080, [0.5] * 4), (1100, [0.25] * 4), (1120, []), (40, base[40].tolist()), (None, [0.1] * 8)]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash"))


def test_topk_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_ROWS", 7)
    monkeypatch.setattr(topk, "CANDIDATE_ROWS", 90)
    monkeypatch.setattr(topk, "_STEP", 16)
    # many partitions, so that both sides of a block have to be dealt alike
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    rows, df = vectors(spark)
    good = [(i, np.floor(64 * np.array(v, np.float32).astype(np.float64)).astype(int)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all()]
    want = {}
    for q, x in {i: v for i, v in good if i % 20 == 0}.items():
        scored = sorted(((-int(v @ x), c) for c, v in good if c != q and len(v) == len(x)))[:20]
        for rank, (s, c) in enumerate(scored, 1):
            want[q, rank] = (c, -s)
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in topk.search(df, F.col("vec_id") % 20 == 0).collect()}
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == want
    assert topk.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_large_components_stay_exact():
    q = np.array([[3_000_000_000, 1]])
    c = np.array([[1_000_000_001, 5], [1_000_000_000, 7]])
    got = topk.block_topk(np.array([1]), q, np.array([2, 3]), c, np.zeros((1, 2)), 2)
    assert got[2] == [3_000_000_003_000_000_005 - 0, 3_000_000_000_000_000_007]


def test_bounds_eliminate_where_vectors_cluster():
    rng = np.random.default_rng(8)
    centres = rng.integers(-300, 300, (40, 16))
    c = centres[rng.integers(0, 40, 6000)] + rng.integers(-4, 5, (6000, 16))
    seen = []
    got = topk.block_topk(np.arange(64), c[:64], np.arange(6000), c, centres[:32].astype(float), 20, seen)
    evaluated, pairs = np.sum(seen, axis=0)
    assert evaluated < 0.2 * pairs
    scores = c[:64] @ c.T
    np.fill_diagonal(scores[:, :64], -(10 ** 12))
    for i in range(64):
        best = np.lexsort((np.arange(6000), -scores[i]))[:20]
        assert got[1][20 * i:20 * i + 20] == best.tolist() and got[2][20 * i:20 * i + 20] == scores[i][best].tolist()


def test_huge_components_take_no_part(spark):
    df = spark.createDataFrame([(20, [1e17, 1.0]), (40, [1e300, 1.0]), (60, [1.0, 2.0]), (61, [2.0, 2.0])], "vec_id long, embedding array<double>")
    assert [(r["query_id"], r["vec_id"], r["score"]) for r in topk.search(df, F.col("vec_id") % 20 == 0).collect()] == [(60, 61, 6 * 64 * 64)]


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_queries_equal_their_sql(spark, name):
    from oracle import check, duck

    status, _, note = check(spark, duck(SMALL), SMALL, name, catalog.QUERIES[name], catalog.SQL[name])
    assert status == "ok", note


def test_pipeline_stages(spark, tmp_path):
    docs = table(spark, SMALL, "documents")
    before = docs
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, before, SMALL).write.parquet(str(tmp_path / str(number)))
        after = spark.read.parquet(str(tmp_path / str(number)))
        if number < 3:
            kept = [r["doc_id"] for r in after.collect()]
            assert after.columns == docs.columns and len(kept) == len(set(kept)) and set(kept) <= {r["doc_id"] for r in before.collect()}, name
        if number == 0:
            for r in before.collect():
                w = r["text"].split()
                if len(w) < 10:
                    assert r["doc_id"] not in kept
        if number == 2:
            want = components_of([(r["doc_id"], r["text"]) for r in before.collect()])
            assert set(kept) == set(want.values())
        if number == 3:
            copies = Counter(r["doc_id"] for r in after.collect())
            assert max(copies.values()) <= 3
            sizes = {r["doc_id"]: len(r["text"].split()) for r in before.collect()}
            total = sum(sizes.values())
            assert abs(sum(sizes[i] * n for i, n in copies.items()) - total) < 0.2 * total
        if number == 4:
            assert after.count() == before.count() and after.where("NOT round_trip").isEmpty()
        before = after


def test_pipeline_survives_odd_tables(spark, tmp_path):
    docs = table(spark, SMALL, "documents")
    odd = spark.createDataFrame([(None, None, None, None, None), (9001, "", "en", "s", 0), (9002, None, "xx", None, None)], docs.schema)
    for start in (docs.limit(0), odd, docs.limit(30).unionByName(odd)):
        here = start
        for _, stage in corpus_pipeline.STAGES:
            here = stage(spark, here, SMALL)
        assert here.columns == ["doc_id", "n_pieces", "piece_ids", "round_trip"] and here.count() >= 0

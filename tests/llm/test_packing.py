"""Packing along the Hilbert curve: round trips, whole sequences, neighbours."""

import itertools
import random
import zlib

import numpy as np
import pytest

from scrubline.llm import catalog, packing
from scrubline.llm.common import default_path, table

SMALL = "/root/testdata/sf0.001"
HARD = ["", " \n\t", "Don't STOP'S we'll 've", "<|endoftext|>x<|startoftext|> <|endoftext|", "É é É ß ÿ Ÿ ª µ º × ÷", "é ́a İSTANBUL ΣΑΣ ǅ ﬁ",
        "a\x1cb\x1d \x1e c\x1f", "x y z w\x85v", "12 3½ ٣ 一二三 日本語テキスト", "🙂🙂 a🙂b", "\x00\x01 \x7f", "w" * 5000, "Ab" * 200 + "é", "'s's'T #$%&*((", "naïve café, L'été"]


def library_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(default_path("word_bpe_49k.json"))
    return [e.ids + [2] for e in t.encode_batch(texts, add_special_tokens=False)]


def test_ids_equal_the_library():
    rng = random.Random(1)
    signs = "aB'éÉß1<|>x \t\xa0\x1ć🙂日Σst,.-"
    texts = HARD + ["".join(rng.choice(signs) for _ in range(rng.randint(0, 40))) for _ in range(2000)]
    with open(default_path("word_bpe_49k.json"), "rb") as file:
        ids = packing.Ids(file.read())
    assert ids.by_chunk
    for _ in range(2):
        for text, want in zip(texts, library_ids(texts)):
            assert np.frombuffer(ids.encode(text), ids.kind).tolist() == want[:-1], text


def check(pieces, rows):
    """Every id in exactly one piece, sequences full and without gaps."""
    want = {i: ids for (i, _), ids in zip(rows, library_ids([t or "" for _, t in rows]))}
    docs, sequences = {}, {}
    for p in pieces:
        docs.setdefault(p["doc_id"], []).append(p)
        sequences.setdefault(p["sequence_id"], []).append(p)
    assert docs.keys() == want.keys()
    for i, parts in docs.items():
        ids = []
        for p in sorted(parts, key=lambda p: p["start"]):
            assert p["start"] == len(ids) and p["doc_tokens"] == len(want[i])
            here = want[i][p["start"]:p["start"] + p["length"]]
            assert p["ids_crc32"] == zlib.crc32(np.array(here, "<u4").tobytes()) and len(here) == p["length"] > 0
            ids += here
        assert ids == want[i]
    for parts in sequences.values():
        at = 0
        for p in sorted(parts, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 4096 and at & (at - 1) == 0
    return sequences


def test_pieces_hold_every_id_once(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(i, t) for i, t in enumerate(HARD)] + [(100 + i, " ".join(rng.choice(["alpha", "Beta", "delta;", "öl"]) for _ in range(rng.randint(0, 3000)))) for i in range(60)]
    rows += [(1000 + i, "the same text " * 30) for i in range(50)] + [(2000, None), (2001, "long words " * 30_000)]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, ID string, `range` int").repartition(3)
    want = check(packing.packed_pieces(df).collect(), rows)
    assert sum(len(s) > 0 and sum(p["length"] for p in s) < 4096 for s in want.values()) <= 12
    monkeypatch.setattr(packing, "RANGE_TOKENS", 5000)
    check(packing.packed_pieces(df).collect(), rows)


def test_null_and_repeated_ids(spark):
    df = spark.createDataFrame([(None, "a b"), (None, "a b"), (1, "c"), (1, "c"), (1, None)], "doc_id long, text string")
    found = packing.packed_pieces(df).collect()
    assert sum(p["length"] for p in found) == 3 + 3 + 2 + 2 + 1
    assert packing.packed_pieces(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    with pytest.raises(ValueError):
        packing.pack(df, most=1000)


def test_pieces_carry_their_ids(spark):
    df = spark.createDataFrame([("x", "one two three")], "name string, body string")
    (p,) = packing.pack(df, most=64, id_col="name", text_col="body").collect()[:1]
    assert isinstance(p["name"], str) and len(p["ids"]) == 4 * p["length"]
    assert p.asDict().keys() == {"name", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"}


@pytest.mark.parametrize("dims,bits", [(1, 5), (2, 4), (3, 3), (4, 2)])
def test_hilbert_steps_to_a_neighbour(dims, bits):
    points = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
    key = packing.hilbert(points, bits)
    assert sorted(key.tolist()) == list(range(len(points)))
    steps = np.abs(np.diff(points[np.argsort(key)], axis=0)).sum(axis=1)
    assert (steps == 1).all()


def test_neighbours_are_alike(spark):
    rows = table(spark, SMALL, "documents").where("text IS NOT NULL").select("doc_id", "text").collect()
    ids = {r["doc_id"]: np.array(i[:-1], np.int64) for r, i in zip(rows, library_ids([r["text"] for r in rows]))}
    vectors = {d: packing.hashed_vector(i) for d, i in ids.items()}
    order = sorted(ids, key=lambda d: packing.hilbert(packing.grid(vectors[d][None, :] @ packing._PROJECTION))[0])
    near = np.mean([vectors[a] @ vectors[b] for a, b in itertools.pairwise(order)])
    mixed = random.Random(3).sample(order, len(order))
    assert near > np.mean([vectors[a] @ vectors[b] for a, b in itertools.pairwise(mixed)]) + 0.05


def test_whole_table(spark):
    rows = [(r["doc_id"], r["text"]) for r in table(spark, SMALL, "documents").select("doc_id", "text").collect()]
    check(catalog.QUERIES["op13_curve_packing"](spark, SMALL).collect(), rows)


def test_lengths():
    assert [packing.lengths(n, 8) for n in (0, 1, 7, 8, 13)] == [[], [1], [4, 2, 1], [8], [8, 4, 1]]

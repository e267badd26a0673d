"""Long rows: roles, texts full of notices, memos that change generations."""

import time

from scrubline.llm import chat, language, licenses, packing, pieces
from scrubline.llm.common import default_path


def test_a_very_long_role(spark):
    role = "a:b\\" * 25_000
    df = spark.createDataFrame([(1, 0, role, "x"), (1, 1, "assistant", "y" * 200_000)], "conv_id long, turn long, role string, text string")
    (row,) = chat.chat_digest(df).collect()
    assert (row["n_turns"], row["loss_chars"]) == (2, 200_000)
    (back,) = chat.format_chats(df).select(chat.read_back(chat.F.col("formatted")).alias("t")).collect()
    assert [(t["role"], len(t["text"])) for t in back["t"]] == [(role, 1), ("assistant", 200_000)]


def test_notices_in_linear_time(spark):
    n = 300_000
    df = spark.createDataFrame([(1, "cc by nc " * n), (2, "cc by ncc " * 20_000)], "doc_id long, text string").repartition(2)
    licenses.license_spans(df.limit(0)).collect()
    start = time.time()
    rows = {r["doc_id"]: r for r in licenses.license_labels(df).collect()}
    assert time.time() - start < 40
    assert (rows[1]["n_words"], rows[1]["n_base"], rows[1]["first_word"], rows[1]["last_word"]) == (3 * n, n, 0, 3 * n - 3)
    assert rows[2]["n_base"] == 0


def test_pieces_outlive_a_generation(monkeypatch):
    with open(default_path("piece_bpe_32k.model"), "rb") as file:
        data = file.read()
    whole, small = pieces.Pieces._read(data), pieces.Pieces._read(data)
    texts = [f"Some words {i % 7} and others{i} again" for i in range(200)]
    want = [whole.encode(t) for t in texts]
    monkeypatch.setattr(pieces, "CHUNKS_KEPT", 5)
    assert [small.encode(t) for t in texts] == want and len(small.older) < 20


def test_packed_ids_outlive_a_generation(monkeypatch):
    with open(default_path("word_bpe_49k.json"), "rb") as file:
        data = file.read()
    texts = [f"Some words {i % 7} and others{i}, again!" for i in range(200)]
    want = [packing.Ids(data).encode(t) for t in texts]
    monkeypatch.setattr(packing, "CHUNKS_KEPT", 4)
    monkeypatch.setattr(packing, "WORDS_KEPT", 3)
    small = packing.Ids(data)
    assert [small.encode(t) for t in texts] == want and len(small.chunks.old) <= 4


def test_languages_outlive_a_generation(spark, monkeypatch):
    rows = [(i, f"der kleine hund {i}" if i % 2 else f"the little dog {i}", "de" if i % 2 else "en") for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(1)
    want = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.document_languages(df).collect()}
    monkeypatch.setattr(language, "REMEMBERED", 3)
    assert {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.document_languages(df).collect()} == want


def test_runs_give_the_sums_of_whole_words():
    import numpy as np

    with open(default_path("piece_bpe_32k.model"), "rb") as file:
        model = pieces.Pieces.load(file.read())
    rng = np.random.default_rng(4)
    p = rng.random((model.size + 1, 3))
    p /= p.sum(axis=0)
    for word in ("plain", "Word,&&&", "l'été!", "3rd", "a-b-c", "12.5", "x²y", "日本語。テキスト", "a▁b,c", "...", "हिन्दी"):
        whole = language.Lattices(model, [pieces.BLANK + word])
        parts = language.Lattices(model, sorted(language._runs_of(model)(word), key=len))
        assert np.allclose(parts.log_sums(p[parts.ids]).sum(axis=0), whole.log_sums(p[whole.ids])[0], rtol=1e-12), word

"""Operators that look at each text by itself, against the libraries and brute force."""

import hashlib
import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from scrubline.llm import chat, language, licenses, pieces, quality, tokens, urls
from scrubline.llm.common import default_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long, Text_ string"
HARD = ["", " ", "\n\n", "a", "  two  words ", "don't stop  <|endoftext|>now<|endoftext|>", "été à la plage", "日本語 テキスト😀", "\x00\x1f ctrl", "a\u00a0b\u2003c",
        "▁sign▁ of blank", "x" * 700, "12345 67,89", "tabs\t\tand\r\nlines", "’s ‘quoted’"]


def documents(spark, texts, **more):
    rows = [(i, t, more.get("lang", "en"), f"s{i % 3}", None if t is None else len(t), "clash") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def random_texts(n, seed=1, words=("the", "of", "rain", "Spain", "falls", "mainly", "plain", "é", "ça", "2,000")):
    rng = random.Random(seed)
    return [" ".join(rng.choice(words) for _ in range(rng.randint(0, 60))) for _ in range(n)]


def test_token_counts_equal_the_library(spark):
    from tokenizers import Tokenizer

    texts = [*HARD, None, *random_texts(40), "long " * 20_000, HARD[5], HARD[5]]
    got = {r["doc_id"]: r for r in tokens.token_counts(documents(spark, texts).repartition(3)).collect()}
    library = Tokenizer.from_file(default_path("byte_bpe_50k.json"))
    for i, text in enumerate(texts):
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        assert (got[i]["n_tokens"], got[i]["n_bytes"], got[i]["over_limit"]) == (n, len((text or "").encode()), n > 512), text


def test_token_counts_of_equal_ids_and_no_rows(spark):
    df = spark.createDataFrame([(None, "one two"), (7, "one"), (7, "one"), (7, "one two three")], "doc_id long, text string")
    assert sorted(r["n_tokens"] for r in tokens.token_counts(df).collect()) == [1, 1, 2, 3]
    empty = tokens.token_counts(df.limit(0))
    assert empty.count() == 0 and empty.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]


def test_frequent_pre_tokens_are_dealt_by_block(spark, monkeypatch):
    monkeypatch.setattr(tokens, "BLOCK_DOCS", 16)
    texts = [f"the common word {i} the" for i in range(200)]
    got = tokens.token_counts(documents(spark, texts)).groupBy().sum("n_tokens").first()[0]
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(default_path("byte_bpe_50k.json"))
    assert got == sum(len(library.encode(t).ids) for t in texts)


def test_license_base_places_and_edits(spark):
    texts = ["Released UNDER the-MIT license; cc BY nc", "under the mit license under the mit license", "under teh mit license is fine", "under the mpl license", "apache license version 1",
             "apache licence version 2", "cc by nd", "ccby nc", "the gnu genral public license", None, "", "nothing here", "prefixunder the mit license", "x " * 30_000 + "under the mit license"]
    got = {r["doc_id"]: r for r in licenses.license_labels(documents(spark, texts)).collect()}
    assert [got[i]["base_labels"] for i in range(14)] == ["cc-by-nc,mit", "mit", "", "", "", "", "", "", "", "", "", "", "", "mit"]
    assert [got[i]["labels"] for i in range(14)] == ["cc-by-nc,mit", "mit", "mit", "", "", "apache-2", "", "cc-by-nc", "gpl", "", "", "", "", "mit"]
    assert (got[1]["n_base"], got[1]["first_word"], got[1]["last_word"]) == (2, 0, 4)
    assert (got[13]["n_words"], got[13]["first_word"]) == (30_004, 30_000)
    assert got[9]["first_word"] is None and got[9]["score"] == 0.0 and 0 < got[2]["score"] < 1
    assert licenses.license_labels(documents(spark, texts).limit(0)).count() == 0


def test_seeds_find_what_a_whole_text_search_finds():
    rng = random.Random(5)
    patterns = licenses._patterns(licenses.NOTICES)
    for _ in range(300):
        notice = rng.choice(licenses.NOTICES)
        chars = list(notice.phrase)
        for _ in range(rng.randint(0, notice.edits + 1)):
            at = rng.randrange(len(chars))
            chars[at:at + 1] = rng.choice([[], ["q"], [chars[at], "q"]])
        words = " ".join(("lorem ipsum " + "".join(chars) + " dolor").split())
        found = any(s[0].label == notice.label for s in licenses.spans_of(words, licenses.NOTICES, patterns))
        whole = any(n.label == notice.label and any(licenses._fixed_kept(m.group(), n) for m in p.finditer(words))
                    for n, p in zip(licenses.NOTICES, patterns, strict=True))
        assert found == whole, words


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_all_damaged_notices_in_a_row_are_found():
    patterns = licenses._patterns(licenses.NOTICES)

    def found(words):
        return [(n.label, words[a:b], edits) for n, a, b, edits in licenses.spans_of(words, licenses.NOTICES, patterns)]

    got = found("gnu generl publc licens " * 5 + "gnu genral public license")
    assert sorted(got) == [("gpl", "gnu generl publc licens", 3)] * 5 + [("gpl", "gnu genral public license", 1)]
    assert found("apache lisense versiom 2 apache license version 1") == [("apache-2", "apache lisense versiom 2", 2)]
    rng = random.Random(8)
    for _ in range(60):
        notice = rng.choice(licenses.NOTICES)
        parts = []
        for _ in range(rng.randint(2, 4)):
            chars = list(notice.phrase)
            for _ in range(rng.randint(0, notice.edits + 1)):
                at = rng.randrange(len(chars))
                chars[at:at + 1] = rng.choice([[], ["q"], [chars[at], "q"], [" "]])
            parts.append("".join(chars))
        words = " ".join(" ".join(parts).split())
        starts = [0, *(i + 1 for i, c in enumerate(words) if c == " ")]
        ends = [*(i for i, c in enumerate(words) if c == " "), len(words)]
        near = sorted((d, a, b) for a in starts for b in ends if b > a and abs(b - a - len(notice.phrase)) <= notice.edits
                      for d in [edit_distance(words[a:b], notice.phrase)] if d <= notice.edits and (not d or licenses._fixed_kept(words[a:b], notice)))
        want = []
        for d, a, b in near:
            if not d or all(b <= x or y <= a for _, x, y in want):
                want.append((d, a, b))
        got = licenses.spans_of(words, [notice], licenses._patterns([notice]))
        assert sorted((edits, a, b) for _, a, b, edits in got) == want, words


def test_url_rules_hosts_and_models(spark):
    rows = [(1, "http://a.NET/x"), (2, "https://example.net/en/1"), (3, "https://www.example.net/en/1"), (4, "http://example.com/de/?q"), (5, "http://Sub.Org/fr/a#b"), (6, "ftp://x.net"),
            (7, None), (8, ""), (9, "no scheme/net/"), (10, "http://badnet/x"), (11, "http://net/x?y"), (11, "http://net/x?y"), (12, "http://u@h:1/p;a?b://c")]
    rows += [(100 + i, f"http://site{i}.net/buy/cheap{i}") for i in range(60)] + [(200 + i, f"http://s{i}.org/fr/article/{i}") for i in range(60)]
    rows += [(300, "http://x.com/buy/cheap77"), (301, "http://x.com/fr/article/9")]
    df = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit("clash"))
    got = {r["page_id"]: r for r in urls.url_verdicts(df).collect()}
    assert [got[i]["rule"] for i in range(1, 13)] == ["net/", "example.net/en/", "example.net/en/", "example.com/de/", "org/fr/", None, None, None, None, None, "net/", None]
    assert (got[1]["host"], got[1]["path"]) == ("a.net", "/x") and (got[6]["host"], got[6]["path"]) == ("x.net", "") and (got[7]["host"], got[9]["path"]) == ("", "")
    assert (got[12]["host"], got[12]["path"]) == ("u@h:1", "/p;a")
    assert got[300]["verdict"] == "block" and got[301]["verdict"] == "allow"
    assert {r["verdict"] for r in got.values()} == {"allow", "block"}
    unlabelled = urls.url_verdicts(spark.createDataFrame([(1, "http://x.com/"), (2, None)], "page_id long, url string")).collect()
    assert [(r["verdict"], r["score"]) for r in unlabelled] == [("allow", None)] * 2
    assert urls.url_verdicts(df.limit(0)).count() == 0


def test_markov_probabilities_sum_to_one():
    g, sizes = urls.grams(["http://a.net/b", "http://a.net/c", ""])
    assert sizes.tolist() == [14, 14, 0] and len(g) == 28
    p = np.exp(urls.log_probabilities(np.bincount(g, minlength=urls.SYMBOLS ** 4))).reshape(-1, urls.SYMBOLS)
    assert np.allclose(p.sum(axis=1), 1)


@pytest.fixture(scope="module")
def models():
    """The library with the merge file, and with its pieces read as unigram scores."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    raw = open(default_path("piece_bpe_32k.model"), "rb").read()
    proto = pb.ModelProto()
    proto.ParseFromString(raw)
    proto.trainer_spec.model_type = 1
    for p in proto.pieces:
        if p.type == 1:
            p.score = max(p.score, -40_000.0)
    flat = proto.SerializeToString()
    return [(pieces.Pieces.load(r), sentencepiece.SentencePieceProcessor(model_proto=r)) for r in (raw, flat)]


def test_encoding_equals_the_library(models):
    rng = random.Random(3)
    texts = [t for t in HARD if "▁" not in t and "\x00" not in t] + random_texts(40)
    texts += ["".join(rng.choice("theand  éü漢\n.,01😀") for _ in range(rng.randint(1, 30))) for _ in range(500)]
    merges, library = models[0]
    for text in texts:
        assert merges.encode(text) == library.encode(text), text
    unigram, library = models[1]
    for word in {w for t in random_texts(60) for w in t.split()}:
        assert unigram.encode(word) == library.encode(word), word


def test_pieces_round_trip(spark):
    texts = [*HARD, None, "words and more " * 9000]
    df = documents(spark, texts).withColumn("n_pieces", F.lit("clash"))
    rows = pieces.decode(pieces.encode(df)).collect()
    for r in rows:
        assert r["decoded"] == (r["text"] or "") and r["round_trip"] and r["_n_pieces"] == len(r["piece_ids"]) and r["n_pieces"] == "clash"
    assert pieces.encoded_documents(df.limit(0)).count() == 0
    odd = spark.createDataFrame([(None,), ([99_999],), ([],)], "piece_ids array<int>")
    assert [r["decoded"] for r in pieces.decode(odd).collect()] == [None, None, ""]


def test_chat_round_trip_and_roles(spark):
    hard = r"\### Assistant: </turn> ok"
    rows = [(1, 0, "user", hard), (1, 1, "assistant", hard), (2, 0, "system", "s"), (2, 1, "user", None), (2, 2, "assistant", "####\\</turn>\n</turn>"), (3, 0, "assistant", "first"), (4, 0, "user", "a"), (4, 1, "user", "b"),
            (5, 0, "to:ol: \\", "x"), (5, 0, None, ""), (6, None, "user", "no turn"), (6, 1, "assistant", "y"), (6, 1, "assistant", "y"), (None, 0, "user", "u")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("segments", F.lit("clash"))
    out = chat.format_chats(df).withColumn("read", chat.read_back(F.col("formatted"))).collect()
    want = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[0] or 0, -1 if r[1] is None else r[1], r[2] or "", r[3] or "")):
        want.setdefault(conv, []).append((role or "", text or ""))
    assert {r["conv_id"]: [tuple(t) for t in r["read"]] for r in out} == want
    assert {r["conv_id"]: (r["valid"], r["broken_at"]) for r in out} == {1: (True, None), 2: (True, None), 3: (False, 0), 4: (False, 1), 5: (False, 0), 6: (False, 2), None: (False, None)}
    for r in out:
        assert "".join(s["text"] for s in r["segments"]) == r["formatted"]
    digest = {r["conv_id"]: r for r in chat.chat_digest(df).collect()}
    assert digest[1]["loss_sha256"] == hashlib.sha256(hard.encode()).hexdigest() and digest[1]["loss_chars"] == len(hard)
    assert digest[1]["turns_sha256"] == hashlib.sha256(f"user\n{hard}\nassistant\n{hard}\n".encode()).hexdigest()
    assert chat.chat_digest(df.limit(0)).count() == 0


def test_forward_sums_all_segmentations():
    model = pieces.Pieces.load(open(default_path("piece_bpe_32k.model"), "rb").read())
    p = np.random.default_rng(1).random(model.size + 1)
    known = {piece: i for piece, (i, _, _) in model.automaton.items()}

    def brute(word):
        total = 0.0
        for cuts in itertools.product([0, 1], repeat=len(word) - 1):
            parts, start = [], 0
            for i, c in enumerate(cuts, 1):
                if c:
                    parts.append(word[start:i])
                    start = i
            parts.append(word[start:])
            ids = [known.get(x, model.size if len(x) == 1 else None) for x in parts]
            if None not in ids:
                total += np.prod([p[i] for i in ids])
        return total

    words = ["▁the", "▁rainy", "▁a\u0378b", "▁", "\u0378\u0378", "▁straße"]
    lattice = language.Lattices(model, words)
    got = lattice.forward(p[lattice.ids][:, None])[lattice.last][:, 0]
    assert np.allclose(got, [brute(w) for w in words])
    back = lattice.backward(p[lattice.ids])
    assert np.allclose(back[lattice.first], got)


def test_long_runs_of_unseen_characters_keep_their_likelihood(spark):
    model = pieces.Pieces.load(open(default_path("piece_bpe_32k.model"), "rb").read())
    words = ["▁" + "\u0e01" * 47, "▁" + "\u0e01\u3042\u0639" * 1500, "▁" + "thequickbrownfox" * 300, "▁the", "▁rainy"]
    lattice = language.Lattices(model, words)
    rng = np.random.default_rng(3)
    p = np.stack([np.full(model.size + 1, 0.5 / 6e9), rng.random(model.size + 1) * 1e-12 + 1e-14, rng.random(model.size + 1)], axis=1)
    got = lattice.log_sums(p[lattice.ids])
    # word by word in logarithms
    for w, word in enumerate(words):
        for k in range(p.shape[1]):
            best = [0.0] + [-np.inf] * len(word)
            for s, e, i in zip(lattice.starts, lattice.ends, lattice.ids, strict=True):
                if lattice.owner_of[s] == w:
                    at, to = s - lattice.first[w], e - lattice.first[w]
                    best[to] = np.logaddexp(best[to], best[at] + np.log(p[i, k]))
            assert abs(got[w, k] - best[-1]) <= 1e-9 * abs(best[-1]) + 1e-9, (w, k)
    short = language.Lattices(model, words[3:])
    assert np.allclose(np.exp(short.log_sums(p[short.ids])), short.forward(p[short.ids])[short.last])
    flat = p[:, 1]
    each = short.forward(flat[short.ids])
    back = short.backward(flat[short.ids])
    owner = short.owner_of[short.starts]
    assert np.allclose(short.shares(flat[short.ids]), each[short.starts] * flat[short.ids] * back[short.ends] / each[short.last][owner])
    share = lattice.shares(flat[lattice.ids])
    lengths = lattice.ends - lattice.starts
    assert np.allclose(np.bincount(lattice.owner_of[lattice.starts], share * lengths), lattice.sizes)


def test_unseen_run_does_not_decide_a_text(spark, monkeypatch):
    run = "\u0e01\u0e02\u0e03\u0e04" * 12
    words = {"en": "the house water tree green under light", "zz": "haus wasser baum grün unter licht morgen"}
    train = spark.createDataFrame([(k, v) for k, v in words.items()], "lang string, text string")
    docs = spark.createDataFrame([(0, f"haus {run} wasser baum"), (1, f"the house {run} tree"), (2, run), (3, "wasser" + run * 80)], "doc_id long, text string")
    fit = language.fit

    def large(*args):
        langs, p = fit(*args)
        return langs, np.where(p <= p.min(axis=1, keepdims=True) * 1.01, 0.5 / 6e9, p)

    monkeypatch.setattr(language, "fit", large)
    got = {r["doc_id"]: r for r in language.identify(docs, train).collect()}
    assert [got[i]["lang_pred"] for i in (0, 1)] == ["zz", "en"]
    assert all(0 < r["score"] <= 1 for r in got.values())


def test_language_held_out_accuracy_and_undetermined(spark):
    words = {"en": "the of and house water tree green under light morning", "fr": "le la et maison eau arbre vert sous lumière matin", "de": "der die und haus wasser baum grün unter licht morgen"}
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(words[lang].split()) for _ in range(12)), lang) for i, lang in enumerate(rng.choice(list(words)) for _ in range(300))]
    rows += [(1000, None, "en"), (1001, "", "en"), (1002, "12 34 !?", "fr"), (1003, "the" * 5000, "en"), (None, "the house", "en"), (5, "la maison", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    got = language.document_languages(df).collect()
    truth = {r[0]: r[2] for r in rows[:300]}
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth and r["doc_id"] < 300 and r["doc_id"] != 5]
    assert len(held) > 40 and sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.97 * len(held)
    by = {r["doc_id"]: r for r in got if r["doc_id"] != 5}
    assert [by[i]["lang_pred"] for i in (1000, 1001, 1002)] == ["und"] * 3 and by[1000]["score"] == 0.0 and by[1003]["lang_pred"] == "en"
    assert all(0 <= r["score"] <= 1 for r in got) and by[None]["held_out"] is False
    assert language.document_languages(df.limit(0)).count() == 0
    assert {r["lang_pred"] for r in language.document_languages(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def counts_of(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if grams[tuple(w[i:i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_quality_counts_and_distances(spark):
    rng = random.Random(4)
    repeats = [" ".join(rng.choice("a b c d e f".split()) for _ in range(rng.randint(5, 80))) for _ in range(60)]
    texts = [*HARD, None, *repeats, "same line\nsame line\n\n\nother\r\nsame line", "#*$%&|<> [x] \\ ^ é É ß 9", "word " * 8000]
    df = documents(spark, texts).withColumn("kept", F.lit("clash"))
    got = {r["doc_id"]: r for r in quality.document_quality(df).collect()}
    for i, text in enumerate(texts):
        want = counts_of(text or "")
        assert tuple(got[i][c] for c in quality.BASE) == want, text
        assert got[i]["base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (got[i]["base_failed"] and got[i]["kept"])
    judged = quality.judge(df)
    assert "clash" in {r["kept"] for r in judged.collect()} and judged.columns[-1] == "_kept"
    assert quality.kept_documents(df).columns == df.columns
    assert {r["doc_id"] for r in quality.kept_documents(df).collect()} == {i for i, r in got.items() if r["kept"]}
    assert quality.document_quality(df.limit(0)).count() == 0


def test_js_distance_and_rejection(spark):
    p, q = np.array([3, 0, 1, 6]), np.array([0.1, 0.2, 0.3, 0.4])
    got = spark.range(1).select(F.expr(quality.js_distance("array(3, 0, 1, 6)", q.tolist()))).first()[0]
    x = p / p.sum()
    m = (x + q) / 2
    want = np.sqrt((sum(a * np.log2(a / b) for a, b in zip(x, m) if a) + (q * np.log2(q / m)).sum()) / 2)
    assert abs(got - want) < 1e-12
    rng = random.Random(6)
    plain = [" ".join(rng.choice("the of and to in is that house tree water light road stone".split()) for _ in range(200)) for _ in range(40)]
    noise = ["".join(rng.choice("0123456789ABCDEF#|{}") for _ in range(9)) for _ in range(200)]
    rows = [(i, t, "en") for i, t in enumerate(plain)] + [(99, " ".join(noise), "en")]
    got = {r["doc_id"]: r["kept"] for r in quality.document_quality(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert not got[99] and sum(got.values()) >= 38


def test_quality_references_for_every_language(spark):
    rng = random.Random(7)
    vocabulary = {"en": "the of and to in is that", "it": "di che è il per non sono", "pl": "i w nie na się do jest", "el": "και το να του η της με", "o'x": "d'a \\'b ${c} #d"}

    def text(lang, n):
        return " ".join(rng.choice(vocabulary[lang].split()) if rng.random() < 0.4 else "".join(rng.choice("abcdefgh" if lang != "el" else "αβγδεζηθ") for _ in range(6)) for _ in range(n))

    rows = [(100 * k + i, text(lang, 200), lang) for k, lang in enumerate(vocabulary) for i in range(20)]
    noise = " ".join("".join(rng.choice("0123456789ABCDEF#|{}") for _ in range(9)) for _ in range(200))
    rows += [(900, text("pl", 139), "single"), (901, text("it", 139), None), (902, noise, "en"), (903, noise, "it"), (904, "", "empty"), (905, None, "none")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    refs = quality.references(df)
    assert set(refs.shares) == {*vocabulary, "single"} and {"che", "się", "και", "${c}", "\\'b", "the"} <= set(refs.words)
    assert all(abs(sum(x) - 1) < 1e-9 and min(x) > 0 for pair in refs.shares.values() for x in pair)
    got = {r["doc_id"]: r for r in quality.document_quality(df).collect()}
    assert all(got[r[0]]["kept"] for r in rows if r[0] < 902), [r for r in got.values() if not r["kept"]]
    assert got[901]["word_distance"] is None and got[901]["class_distance"] is None and got[900]["word_distance"] < 0.1
    assert [got[i]["kept"] for i in (902, 903, 904, 905)] == [False] * 4
    assert {r["doc_id"] for r in quality.kept_documents(df).collect()} == {i for i, r in got.items() if r["kept"]}
    four = df.where("lang IN ('en', 'de') OR lang IS NULL")
    assert quality.common_words(four) == quality.WORDS

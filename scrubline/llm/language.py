"""Language ID: unigrams over a fixed public vocabulary, summed over all segmentations.

A language is a distribution over the pieces of a public vocabulary.  A word's
probability is the sum over all its segmentations of the product of the piece
probabilities, which a forward pass over the word's lattice gives; a text's is
the product over its words, as a sum of logarithms; inside a word, products are
scaled before they get too small.  Piece probabilities come from expected piece counts
(a forward-backward pass) over the counted words of all learned documents,
starting from equal ones.

Words are counted for each language before anything is moved; the expected
counts are as many as languages x pieces whatever the input, so they may pass
through the driver.  Expected counts are added as whole numbers, so that the
result doesn't depend on how rows are dealt.
"""

from __future__ import annotations

from collections import Counter
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import default_path, free_name, map_batches, shared_bytes, text_of
from .pieces import BLANK, Pieces

#: words that a task counts before it writes them
WORDS_KEPT = 200_000
#: words whose likelihoods a worker remembers, in each of two generations
REMEMBERED = 200_000
#: texts that are taken apart at once
_ROWS = 500
#: characters of the words of one lattice; a longer word has one for itself
_CHARS = 200_000
#: added to each piece's expected count
SMOOTHING = 0.5
_UNIT = 1 << 16


def _slices(words: list[str]):
    """Bounds of runs of words with so many characters that one lattice holds them."""
    first, chars = 0, 0
    for i, word in enumerate(words):
        if chars + len(word) > _CHARS and i > first:
            yield first, i
            first, chars = i, 0
        chars += len(word)
    if words:
        yield first, len(words)


_NUMBERED: dict = {}


def _numbered(pieces: Pieces):
    """The automaton with bare piece numbers, and each piece's length."""
    if id(pieces) not in _NUMBERED:
        import ahocorasick

        automaton, length_of = ahocorasick.Automaton(), np.zeros(pieces.size, np.int64)
        for piece, (i, size, _) in pieces.automaton.items():
            automaton.add_word(piece, i)
            length_of[i] = size
        automaton.make_automaton()
        _NUMBERED[id(pieces)] = automaton, length_of
    return _NUMBERED[id(pieces)]


_PARTED: dict = {}


def _runs_of(pieces: Pieces):
    """A function that cuts a word into what its lattice falls into.

    If no piece of the vocabulary holds a letter next to another sign, every way
    through a word passes the border between a run of letters and what follows, so
    its sum is the product of the sums over its runs; the first run has the blank.
    Else, and with a blank sign inside, a word is one run.
    """
    import regex

    runs = regex.compile(r"\p{L}+|\P{L}+").findall
    if id(pieces) not in _PARTED:
        _PARTED[id(pieces)] = all(len(runs(p.lstrip(BLANK))) < 2 for p, _ in pieces.automaton.items())
    parted = _PARTED[id(pieces)]

    def cut(word: str) -> list[str]:
        found = [word] if not parted or word.isalpha() or BLANK in word else runs(word)
        found[0] = BLANK + found[0]
        return found

    return cut


class Remembered:
    """Rows of numbers by key, in two generations: what is used again comes back from the older one."""

    def __init__(self, width: int, size: int):
        self.size, self.place, self.older = size, {}, {}
        self.rows = self.older_rows = np.zeros((0, width))

    def turn(self) -> None:
        if len(self.place) > self.size:
            self.older, self.older_rows = self.place, self.rows
            self.place, self.rows = {}, np.zeros((0, self.rows.shape[1]))

    def put(self, keys: list[str], rows: np.ndarray) -> None:
        n = len(self.place)
        if n + len(keys) > len(self.rows):
            grown = np.empty((max(2 * len(self.rows), n + len(keys)), self.rows.shape[1]))
            grown[:n] = self.rows[:n]
            self.rows = grown
        self.rows[n:n + len(keys)] = rows
        self.place.update(zip(keys, range(n, n + len(keys)), strict=True))

    def missing(self, keys) -> list[str]:
        """Distinct keys without a row, shortest first."""
        unknown = [k for k in keys if k not in self.place]
        again = [k for k in unknown if k in self.older]
        if again:
            self.put(again, self.older_rows[[self.older[k] for k in again]])
        return sorted((k for k in unknown if k not in self.older), key=len)

    def of(self, keys) -> np.ndarray:
        place = self.place
        return self.rows[[place[k] for k in keys]]


class Lattices:
    """Edges of the segmentation lattices of many words, sorted for level-by-level sums."""

    def __init__(self, pieces: Pieces, words: list[str]):
        """Words hold no white space, so one pass of the automaton over all of them, line by line, finds every edge.

        A node is a place in that text; a word's last node is its line's end.
        """
        sizes = np.array([len(w) for w in words], np.int64)
        self.sizes = sizes
        self.last = np.cumsum(sizes + 1) - 1
        self.first = self.last - sizes
        self.nodes = int(self.last[-1]) + 1
        automaton, length_of = _numbered(pieces)
        found = np.fromiter(chain.from_iterable(automaton.iter("\n".join(words))), np.int64).reshape(-1, 2)
        ends, ids = found[:, 0] + 1, found[:, 1]
        lengths = length_of[ids]
        self.reach = int(length_of.max())
        alone = np.ones(self.nodes, bool)
        alone[self.last] = False
        alone[ends[lengths == 1] - 1] = False
        unknown = np.flatnonzero(alone)
        starts = np.concatenate([ends - lengths, unknown])
        ends, ids = np.concatenate([ends, unknown + 1]), np.concatenate([ids, np.full(len(unknown), pieces.size)])
        self.owner_of = np.repeat(np.arange(len(words)), sizes + 1)
        levels = ends - self.first[self.owner_of[ends]]
        order = np.argsort(levels * self.nodes + ends, kind="stable")
        self.starts, self.ends, self.ids = starts[order], ends[order], ids[order]
        self.steps = np.flatnonzero(np.diff(levels[order], prepend=-1)).tolist() + [len(order)]

    def forward(self, p: np.ndarray) -> np.ndarray:
        """p: (edges, ...) probabilities; sums over all ways to each node, which for a long word may be too small for a number."""
        alpha = np.zeros((self.nodes, *p.shape[1:]))
        alpha[self.first] = 1.0
        for a, b in zip(self.steps, self.steps[1:], strict=False):
            flow = alpha[self.starts[a:b]] * p[a:b]
            cuts = np.flatnonzero(np.diff(self.ends[a:b], prepend=-1))
            alpha[self.ends[a:b][cuts]] = np.add.reduceat(flow, cuts, axis=0)
        return alpha

    def backward(self, p: np.ndarray) -> np.ndarray:
        beta = np.zeros(self.nodes)
        beta[self.last] = 1.0
        for a, b in reversed(list(zip(self.steps, self.steps[1:], strict=False))):
            np.add.at(beta, self.starts[a:b], beta[self.ends[a:b]] * p[a:b])
        return beta

    def _scaled(self, p: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Sums over all ways to the last nodes, and the powers of two that they are to be taken times.

        Before products could get too small, the nodes that later edges start from
        are scaled so that the newest one is from 0.5 to 1; by powers of two, so
        that no digit changes.  ``weights`` gets each edge's part of the sum at its end.
        """
        alpha = np.zeros((self.nodes, *p.shape[1:]))
        alpha[self.first] = 1.0
        powers = np.zeros((len(self.sizes), *p.shape[1:]), np.int64)
        least = float(p.min()) if len(p) else 1.0
        every = max(1, int(-300 / np.log10(least))) if 0 < least < 1 else 1
        for level, (a, b) in enumerate(zip(self.steps, self.steps[1:], strict=False), 1):
            flow = alpha[self.starts[a:b]] * p[a:b]
            cuts = np.flatnonzero(np.diff(self.ends[a:b], prepend=-1))
            found = np.add.reduceat(flow, cuts, axis=0)
            alpha[self.ends[a:b][cuts]] = found
            if weights is not None:
                weights[a:b] = flow / np.repeat(found, np.diff(cuts, append=b - a), axis=0)
            if level % every == 0:
                longer = np.flatnonzero(self.sizes > level)
                newest = self.first[longer] + level
                power = np.frexp(alpha[newest])[1]
                used = newest[:, None] - np.arange(min(self.reach, level + 1))
                alpha[used] = np.ldexp(alpha[used], -power[:, None])
                powers[longer] += power
        return alpha[self.last], powers

    def log_sums(self, p: np.ndarray) -> np.ndarray:
        """p: (edges, ...) probabilities; logarithms of the sums over all ways through each word, however long."""
        alpha, powers = self._scaled(p)
        return np.log(alpha) + powers * np.log(2.0)

    def shares(self, p: np.ndarray) -> np.ndarray:
        """p: (edges,) probabilities; the part of all ways through its word that uses each edge."""
        share = np.empty(len(p))
        self._scaled(p, share)
        through = np.zeros(self.nodes)
        through[self.last] = 1.0
        for a, b in reversed(list(zip(self.steps, self.steps[1:], strict=False))):
            share[a:b] *= through[self.ends[a:b]]
            np.add.at(through, self.starts[a:b], share[a:b])
        return share


def _word_counts(model):
    """(language, run) counts of what a task reads; column 0: language, column 1: text."""

    def run(batches):
        cut = _runs_of(Pieces.load(model.value))
        found: dict[str, Counter] = {}

        def close():
            runs: dict[str, Counter] = {}
            for lang, words in found.items():
                here = runs[lang] = Counter()
                for word, n in words.items():
                    for part in cut(word):
                        here[part] += n
            found.clear()
            return {"lang": [k for k, c in runs.items() for _ in c], "word": [w for c in runs.values() for w in c], "n": [n for c in runs.values() for n in c.values()]}

        for whole in batches:
            for first in range(0, whole.num_rows, _ROWS):
                batch = whole.slice(first, _ROWS)
                for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    found.setdefault(lang, Counter()).update(text.split())
                if sum(map(len, found.values())) > WORDS_KEPT:
                    yield close()
        yield close()

    return run


def _expected(model, probabilities, langs: list[str]):
    """(language, word, n) -> expected piece counts of what a task reads, in units of 1 / 65536."""

    def run(batches):
        pieces, known = Pieces.load(model.value), {x: i for i, x in enumerate(langs)}
        p = probabilities.value
        total = np.zeros((len(langs), pieces.size + 1), np.int64)
        for batch in batches:
            lang, word, n = (batch.column(i).to_pylist() for i in range(3))
            words, lang, n = word, np.array([known[x] for x in lang], np.int64), np.array(n, np.float64)
            for first, end in _slices(words):
                lattice = Lattices(pieces, words[first:end])
                owner = lattice.owner_of[lattice.starts] + first
                share = lattice.shares(p[lang[owner], lattice.ids])
                np.add.at(total, (lang[owner], lattice.ids), np.rint(share * n[owner] * _UNIT).astype(np.int64))
        at = np.nonzero(total)
        yield {"lang": at[0].tolist(), "piece": at[1].tolist(), "n": total[at].tolist()}

    return run


def fit(texts: DataFrame, model, steps: int = 1) -> tuple[list[str], np.ndarray]:
    """Languages and their piece probabilities (languages, pieces + 1) from (lang, text); the last piece is any unknown character."""
    spark = texts.sparkSession
    counted = map_batches(texts.select("lang", "text"), _word_counts(model), T.StructType([
        T.StructField("lang", T.StringType()), T.StructField("word", T.StringType()), T.StructField("n", T.LongType())]))
    counted = counted.groupBy("lang", "word").agg(F.sum("n").alias("n"))
    langs = sorted(r[0] for r in texts.select("lang").distinct().collect())
    size = Pieces.load(model.value).size + 1
    p = np.full((max(1, len(langs)), size), 1.0 / size)
    for _ in range(steps if langs else 0):
        given = spark.sparkContext.broadcast(p)
        parts = map_batches(counted, _expected(model, given, langs), T.StructType([
            T.StructField("lang", T.IntegerType()), T.StructField("piece", T.IntegerType()), T.StructField("n", T.LongType())]))
        found = parts.groupBy("lang", "piece").agg(F.sum("n").alias("n")).toPandas()
        total = np.full((len(langs), size), SMOOTHING)
        total[found["lang"], found["piece"]] += found["n"].to_numpy(np.float64) / _UNIT
        p = total / total.sum(axis=1, keepdims=True)
    return langs, p


def _predictor(model, fitted, langs: list[str], text_at: int, names: list[str]):
    def run(batches):
        pieces = Pieces.load(model.value)
        p = np.ascontiguousarray(fitted.value.T)
        cut = _runs_of(pieces)
        known, parts = Remembered(len(langs), REMEMBERED), Remembered(len(langs), REMEMBERED)

        def learn(wanted):
            new = known.missing(wanted)
            if not new:
                return
            parts.turn()
            runs = [cut(w) for w in new]
            fresh = parts.missing(dict.fromkeys(chain.from_iterable(runs)))
            for first, end in _slices(fresh):
                lattice = Lattices(pieces, fresh[first:end])
                parts.put(fresh[first:end], lattice.log_sums(p[lattice.ids]))
            starts = np.cumsum([0, *map(len, runs)])[:-1]
            known.put(new, np.add.reduceat(parts.of(chain.from_iterable(runs)), starts, axis=0))

        for whole in batches:
            for first in range(0, whole.num_rows, _ROWS):
                batch = whole.slice(first, _ROWS)
                known.turn()
                counted = [Counter(t.split()) if t and langs and any(map(str.isalpha, t)) else None for t in batch.column(text_at).to_pylist()]
                learn(dict.fromkeys(w for c in counted if c for w in c))
                pred, score = [], []
                for c in counted:
                    if not c:
                        pred.append("und")
                        score.append(0.0)
                        continue
                    total = np.fromiter(c.values(), np.float64, len(c)) @ known.of(c)
                    best = int(total.argmax())
                    pred.append(langs[best])
                    score.append(float(1.0 / np.exp(total - total[best]).sum()))
                yield {**{n: batch.column(i) for i, n in enumerate(batch.schema.names)}, names[0]: pred, names[1]: score}

    return run


def identify(docs: DataFrame, train: DataFrame, path: str | None = None, text_col: str = "text", steps: int = 1) -> DataFrame:
    """The table with ``lang_pred`` and ``score`` (the prediction's share of the likelihoods, 0 to 1).

    ``train`` has columns lang and text; rows where either is null are left out.
    Predictions use the text alone.  A null text, one without a letter, and any
    text if nothing can be learned, is ``und`` with score 0; equal likelihoods go
    to the language that sorts first.  Texts are taken whole, rows one by one, and so
    are words, however long.  New columns give way to columns of the same name by
    leading underscores.  An empty table gives an empty result.
    """
    spark = docs.sparkSession
    model = shared_bytes(spark, path or default_path("piece_bpe_32k.model"))
    langs, p = fit(train.where("lang IS NOT NULL AND text IS NOT NULL"), model, steps)
    names = [free_name(docs, x) for x in ("lang_pred", "score")]
    return map_batches(docs, _predictor(model, spark.sparkContext.broadcast(p), langs, docs.columns.index(text_col), names),
                       T.StructType([*docs.schema, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())]))


def held_out(id_col: str = "doc_id"):
    """Whether crc32 of the id as text, modulo 4, is 2; never for a null id."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learned_from(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, text) of the documents to learn from: those with an id that isn't held out."""
    return docs.where(F.col(f"`{id_col}`").isNotNull() & ~held_out(id_col)).select(
        F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{text_col}`").cast("string").alias("text"))


def document_languages(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id, held_out, lang_pred, score) for every row, learned from those not held out."""
    narrow = docs.select(F.col(f"`{id_col}`").alias("id"), text_of(docs, text_col).alias("text"))
    return identify(narrow, learned_from(docs, id_col, text_col, lang_col), path).select(
        F.col("id").alias(id_col), held_out("id").alias("held_out"), "lang_pred", "score")

"""License scans: short notices found with a bounded number of edits.

A text is lower-cased (A-Z) and brought to words joined by single blanks.  If a
notice occurs with at most k edits, then one of k + 1 disjoint parts of it occurs
unchanged (pigeonhole), so exact search for the parts finds every candidate.
At each pair of word edges around a candidate the regex library's bounded-error
matching decides and gives the edits.  The numbers of one license must not be reached from
another by edits ("version 1" from "version 2"), so a notice names the words that
have to be there unchanged.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_batches, text_of


@dataclass(frozen=True)
class Notice:
    phrase: str
    label: str
    edits: int
    fixed: tuple[str, ...] = ()
    base: bool = False

    def seeds(self) -> list[tuple[int, str]]:
        """edits + 1 disjoint parts that together are the phrase, with their offsets."""
        n, parts = len(self.phrase), self.edits + 1
        cuts = [n * i // parts for i in range(parts + 1)]
        return [(a, self.phrase[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


#: notices of the contract, then those the method adds
NOTICES = (
    Notice("under the mit license", "mit", 2, ("mit",), True),
    Notice("apache license version 2", "apache-2", 2, ("2",), True),
    Notice("cc by nc", "cc-by-nc", 1, ("cc", "by", "nc"), True),
    Notice("gnu general public license", "gpl", 3),
    Notice("gnu lesser general public license", "lgpl", 3, ("lesser",)),
    Notice("mozilla public license", "mpl", 2, ("mozilla",)),
    Notice("permission is hereby granted free of charge", "mit", 4),
    Notice("redistribution and use in source and binary forms", "bsd", 4),
    Notice("creative commons attribution noncommercial", "cc-by-nc", 4),
)

#: lower case for A-Z, and a blank for what no word holds; bytes from 80 on belong to words
_TO_WORDS = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

SPAN = T.StructType([
    T.StructField("label", T.StringType()), T.StructField("base", T.BooleanType()), T.StructField("first_word", T.LongType()),
    T.StructField("n_words", T.LongType()), T.StructField("edits", T.IntegerType()), T.StructField("score", T.DoubleType()),
    T.StructField("text", T.StringType())])


def _fixed_kept(found: str, notice: Notice) -> bool:
    """The notice's fixed words stand in the match; for a phrase of fixed words only blanks may differ."""
    words = found.split(" ")
    if len(notice.fixed) == len(notice.phrase.split(" ")):
        return "".join(words) == "".join(notice.fixed)
    return all(w in words for w in notice.fixed)


def spans_of(words: str, notices, patterns) -> list[tuple]:
    """Notices in words joined by single blanks: (notice, start, end, edits), exact places first.

    Every pair of word edges that a seed allows is tried; of places that overlap,
    the one with fewer edits stays, then the earlier, then the shorter.
    """
    out = []
    for notice, pattern in zip(notices, patterns, strict=True):
        n, k = len(notice.phrase), notice.edits
        places, exact = set(), []
        for offset, seed in notice.seeds():
            at = words.find(seed)
            while at >= 0:
                # up to k edits before the seed move the place's start by up to k
                for a in range(max(0, at - offset - k), min(len(words), at - offset + k) + 1):
                    if a == 0 or words[a - 1] == " ":
                        places.update((a, b) for b in range(max(a + 1, a + n - k), min(len(words), a + n + k) + 1) if b == len(words) or words[b] == " ")
                at = words.find(seed, at + 1)
        if not places:
            continue
        near = []
        for a, b in sorted(places):
            if words[a:b] == notice.phrase:
                exact.append((a, b))
            elif k and words[a] != " " and words[b - 1] != " " and _fixed_kept(words[a:b], notice):
                m = pattern.fullmatch(words, a, b)
                if m:
                    near.append((sum(m.fuzzy_counts), a, b))
        out += [(notice, a, b, 0) for a, b in exact]
        if near:
            covered = bytearray(len(words))
            for a, b in exact:
                covered[a:b] = b"\x01" * (b - a)
            for edits, a, b in sorted(near):
                if covered.find(1, a, b) < 0:
                    covered[a:b] = b"\x01" * (b - a)
                    out.append((notice, a, b, edits))
    return out


def _patterns(notices):
    import regex

    return [regex.compile(rf"(?b)(?<![^ ])(?:{regex.escape(n.phrase, literal_spaces=True)}){{e<={n.edits}}}(?![^ ])") for n in notices]


def _scan(notices):
    def run(batches):
        patterns = _patterns(notices)
        seeds = sorted({seed.encode() for n in notices for _, seed in n.seeds()})
        for batch in batches:
            out = {"n_words": [], "spans": []}
            for text in batch.column(batch.num_columns - 1).to_pylist():
                raw = text.encode("utf-8", "surrogatepass").translate(_TO_WORDS).split()
                out["n_words"].append(len(raw))
                joined, spans = b" ".join(raw), []
                if any(s in joined for s in seeds):
                    words = joined.decode("utf-8", "surrogatepass")
                    places = spans_of(words, notices, patterns)
                    blanks = np.flatnonzero(np.frombuffer(words.encode("utf-32-le", "surrogatepass"), np.uint32) == 32) if places else None
                    for notice, a, b, edits in places:
                        found = words[a:b]
                        spans.append({
                            "label": notice.label, "base": notice.base, "first_word": int(np.searchsorted(blanks, a)), "n_words": found.count(" ") + 1,
                            "edits": edits, "score": 1.0 - edits / len(notice.phrase), "text": found})
                out["spans"].append(sorted(spans, key=lambda s: (s["first_word"], s["n_words"], s["label"])))
            out["id"] = batch.column(0)
            yield out

    return run


def license_spans(docs: DataFrame, notices=NOTICES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, spans) for every row; a span has label, place in words, edits, score and its words.

    Edits are inserted, deleted or changed characters, blanks included.  A match
    begins and ends at a word's edge.  Exact places are all reported, and all places
    with edits that overlap no exact one of the same notice and none with fewer edits.

    Null and empty texts have no words and no spans.  Rows are scanned one by
    one, so repeated rows and equal ids stay apart; long texts are taken whole.
    Other columns are not read.  An empty table gives an empty result.
    """
    kind = docs.schema[id_col].dataType
    return map_batches(
        docs.select(F.col(f"`{id_col}`").alias("id"), text_of(docs, text_col).alias("text")), _scan(tuple(notices)),
        T.StructType([T.StructField("id", kind), T.StructField("n_words", T.LongType()), T.StructField("spans", T.ArrayType(SPAN))]),
    ).withColumnRenamed("id", id_col)


def license_labels(docs: DataFrame, notices=NOTICES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The digest of ``license_spans``: base places, labels and the best score of each row."""
    base = F.filter("spans", lambda s: s["base"] & (s["edits"] == 0))
    label = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")
    return license_spans(docs, notices, id_col, text_col).select(
        F.col(f"`{id_col}`"), "n_words", F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda s: s["first_word"])).alias("first_word"),
        F.array_max(F.transform(base, lambda s: s["first_word"])).alias("last_word"),
        label(base).alias("base_labels"), label(F.col("spans")).alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["score"])), F.lit(0.0)).alias("score"))

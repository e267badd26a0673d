"""Quality rules: counts with limits, then divergence from language references, in SQL functions only.

The counts are those of the base rules.  The method compares a document's
histograms of character classes and of common words with those of each language,
gathered over all documents of that language, by Jensen-Shannon distance (base 2,
0 to 1).  Every language that a document is labelled with has a reference.  A
document that is far from every language fails.  Short texts have no reliable
histogram: below ``MIN_CHARS`` characters or ``MIN_WORDS`` words the respective
histogram has no say, nor has any for documents whose own language has no reference.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.cut import cut
from .common import free_name

#: common words of four languages (fixed values); those of any other are counted
COMMON = {
    "en": ["the", "of", "and", "to", "in", "is", "that", "for", "with", "this", "was", "on"],
    "fr": ["le", "la", "les", "de", "des", "et", "un", "une", "du", "que", "pour", "dans"],
    "de": ["der", "die", "das", "und", "ist", "ein", "nicht", "mit", "den", "von", "zu", "auf"],
    "es": ["el", "los", "las", "y", "en", "por", "con", "para", "una", "del", "se", "como"],
}
WORDS = sorted({w for words in COMMON.values() for w in words})

MIN_CHARS, MIN_WORDS = 300, 120
#: farthest a document may be from the nearest language, for either histogram
MAX_CLASS_DISTANCE, MAX_WORD_DISTANCE = 0.30, 0.29

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MIN_BASE_WORDS, REPEAT_PERCENT, WINDOW = 10, 20, 5
_PRIOR = 0.5
#: most that the prior may add to all counts of a language, so that it doesn't drown a language of few documents
_PRIOR_SHARE = 0.01
#: common words that are counted for a language without fixed ones, and parts in which they are ranked first
N_COMMON, _RANK_PARTS = 12, 64


class References(NamedTuple):
    """Class and common-word shares of each language, and the common words of all."""

    words: list[str]
    shares: dict[str, tuple[list[float], list[float]]]

_WORD_SQL = ", ".join(f"'{w}'" for w in WORDS)
_REPEATS = """CASE WHEN size({g}) = size(array_distinct({g})) THEN 0L ELSE
 transform(array(sort_array(transform({g}, (h, i) -> struct(h, i)))), s ->
  aggregate(sort_array(transform(filter(transform(sequence(0, size(s) - 1), j -> struct(s[j].i AS i,
     (j > 0 AND s[j - 1].h = s[j].h) OR (j < size(s) - 1 AND s[j + 1].h = s[j].h) AS twice)), x -> x.twice), x -> x.i)),
   named_struct('n', 0L, 'e', 0), (a, i) -> named_struct('n', a.n + (i + {w} - greatest(i, a.e)), 'e', i + {w})).n)[0] END"""


def _kept_chars(text: Column, kept: str) -> Column:
    """Number of characters of a class: what is left when the others go."""
    return F.char_length(F.regexp_replace(text, f"[^{kept}]+", "")).cast("long")


def _common_counts(words: str, common: list[str]) -> Column:
    """Counts of the common words, then of all other words."""
    if common == WORDS:
        found = f"filter({words}, x -> length(x) <= {max(map(len, WORDS))} AND lower(x) IN ({_WORD_SQL}))"
        each = ", ".join(f"size(c) - size(array_remove(c, '{w}'))" for w in WORDS)
        return F.expr(f"transform(array(transform({found}, x -> lower(x))), c -> array({each}, size({words}) - size(c)))[0]")
    # counted words may hold any sign, so they are values instead of SQL text
    found = F.transform(F.filter(F.col(words), lambda x: F.lower(x).isin(*common)), lambda x: F.lower(x))
    each = F.array(*map(F.lit, common))
    return F.transform(F.array(found), lambda c: F.concat(
        F.transform(each, lambda w: F.size(c) - F.size(F.array_remove(c, w))), F.array(F.size(F.col(words)) - F.size(c))))[0]


def common_words(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> list[str]:
    """The fixed common words, and the ``N_COMMON`` most frequent ones of each other language of the table (equal counts: the word that sorts first).

    Words are ranked in parts before they are ranked by language, so no task has
    to take all words of a language.
    """
    lang = F.col(f"`{lang_col}`").cast("string")
    others = docs.where(lang.isNotNull() & ~lang.isin(*COMMON))
    if others.select(f"`{lang_col}`").isEmpty():
        return WORDS
    words = F.array_remove(F.split(F.lower(F.col(f"`{text_col}`").cast("string")), r"[\x20\x09-\x0D]+"), "")
    counted = others.select(lang.alias("lang"), F.explode(words).alias("word")).groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))
    counted = counted.withColumn("part", F.pmod(F.xxhash64("word"), F.lit(_RANK_PARTS)))
    for by in (["lang", "part"], ["lang"]):
        rank = F.row_number().over(W.partitionBy(*by).orderBy(F.desc("n"), "word"))
        counted = counted.withColumn("rank", rank).where(F.col("rank") <= N_COMMON).drop("rank")
    return sorted({*WORDS, *(r["word"] for r in counted.select("word").distinct().collect())})


def _measured(docs: DataFrame, keep: list[str], text_col: str, common: list[str]) -> tuple[DataFrame, dict[str, str]]:
    """The columns ``keep`` with the base counts and both histograms; names: what the new columns are called.

    Each count is a column of its own before others are made of it, so that
    nothing is counted twice.
    """
    names = {x: free_name(docs, x) for x in BASE} | {x: free_name(docs, f"_q_{x}") for x in ("text", "w", "h", "g", "n", "rest", "upper", "other", "digit", "sign", "classes", "common")}
    own = [F.col(f"`{c}`") for c in keep]
    c = {x: F.col(n) for x, n in names.items()}
    rows = docs.select(*own, F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias(names["text"]))
    lines = f"filter(split({names['text']}, '\\n'), x -> x RLIKE '[^\\\\x20\\\\x09-\\\\x0D]')"
    rows = rows.select(
        *own, F.array_remove(F.split(c["text"], r"[\x20\x09-\x0D]+"), "").alias(names["w"]), F.char_length(c["text"]).cast("long").alias(names["n"]),
        F.regexp_replace(c["text"], r"[a-z\x20\x09-\x0D]+", "").alias(names["rest"]),
        F.expr(f"transform(array({lines}), l -> size(l) - size(array_distinct(l)))[0]").cast("long").alias(names["n_dup_lines"]))
    rows = rows.select(
        *own, F.size(c["w"]).cast("long").alias(names["n_words"]), F.char_length(F.array_join(c["w"], "")).cast("long").alias(names["word_chars"]),
        c["n"], c["n_dup_lines"], F.char_length(c["rest"]).cast("long").alias(names["rest"]), F.transform(c["w"], lambda x: F.xxhash64(x)).alias(names["h"]),
        _common_counts(names["w"], common).alias(names["common"]), _kept_chars(c["rest"], "#*$%&|<>").alias(names["n_symbols"]), _kept_chars(c["rest"], "A-Z").alias(names["upper"]),
        _kept_chars(c["rest"], r"\p{L}&&[^A-Z]").alias(names["other"]), _kept_chars(c["rest"], "0-9").alias(names["digit"]), _kept_chars(c["rest"], "=_{}~^+/@").alias(names["sign"]))
    h = names["h"]
    grams = f"transform(sequence(0, size({h}) - {WINDOW}), i -> xxhash64({', '.join(f'{h}[i + {j}]' for j in range(WINDOW))}))"
    sign = c["sign"] + c["n_symbols"]
    # lower case, upper case, other letters, digits, signs, white space, rest
    classes = F.array(c["word_chars"] - c["rest"], c["upper"], c["other"], c["digit"], sign, c["n"] - c["word_chars"], c["rest"] - c["upper"] - c["other"] - c["digit"] - sign)
    rows = rows.select(
        *own, *(c[x] for x in BASE if x != "n_repeat_words"), c["n"], c["common"], classes.alias(names["classes"]),
        F.expr(f"CASE WHEN size({h}) < {WINDOW} THEN cast(array() AS array<bigint>) ELSE {grams} END").alias(names["g"]))
    repeats = F.expr(_REPEATS.format(g=names["g"], w=WINDOW))
    return rows.select(*own, *(repeats.alias(names[x]) if x == "n_repeat_words" else c[x] for x in BASE), c["n"], c["common"], c["classes"]), names


def _summed(rows: DataFrame, names: dict[str, str], lang: str, common: list[str]) -> References:
    kinds = (("classes", 7), ("common", len(common) + 1))
    sums = [F.sum(F.col(names[kind])[i]).alias(f"{kind[1]}{i}") for kind, size in kinds for i in range(size)]
    out = {}
    own = F.col(f"`{lang}`").cast("string")
    for row in rows.where(own.isNotNull()).groupBy(own.alias("lang")).agg(*sums).collect():
        shares = []
        for kind, size in kinds:
            n = [row[f"{kind[1]}{i}"] for i in range(size)]
            prior = min(_PRIOR, _PRIOR_SHARE * sum(n) / size)
            shares.append([(x + prior) / (sum(n) + prior * size) for x in n] if sum(n) else None)
        if None not in shares:
            out[row["lang"]] = (shares[0], shares[1])
    return References(common, out)


def references(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> References:
    """Class and common-word shares of each language that has words, summed over all its documents."""
    common = common_words(docs, text_col, lang_col)
    rows, names = _measured(docs.where(F.col(f"`{lang_col}`").isNotNull()), [lang_col], text_col, common)
    return _summed(rows, names, lang_col, common)


def js_distance(counts: str, reference: list[float]) -> str:
    """SQL for the Jensen-Shannon distance of an array of counts from a distribution."""
    q = "array(" + ", ".join(f"{x!r}D" for x in reference) + ")"
    total = f"greatest(aggregate({counts}, 0D, (a, x) -> a + x), 1D)"
    term = "(if(p > 0, p * ln(2 * p / (p + q)), 0D) + q * ln(2 * q / (p + q)))"
    summed = f"aggregate(zip_with(transform({counts}, x -> x / t), {q}, (p, q) -> {term}), 0D, (a, x) -> a + x)"
    return f"transform(array({total}), t -> sqrt(greatest({summed}, 0D) / (2 * ln(2D))))[0]"


def judge(docs: DataFrame, refs: References | None = None, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The table with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, class_distance, word_distance and kept.

    Distances are those from the nearest language; they are null for texts that
    are too short, and if the document's own language has no reference (a null one
    never has).  A null text has no words.
    A document without enough words, or with too many repeated ones, fails the
    base rules; one that is too far from every language fails the method.  Rows
    are judged one by one, texts are taken whole.  New columns give way to
    columns of the same name by leading underscores.  An empty table gives an
    empty result.
    """
    refs = references(docs, text_col, lang_col) if refs is None else refs
    rows, names = _measured(docs, docs.columns, text_col, refs.words)
    return _judged(rows, names, docs.columns, refs, lang_col)


def _judged(rows: DataFrame, names: dict[str, str], keep: list[str], refs: References, lang: str) -> DataFrame:
    known = F.col(f"`{lang}`").cast("string").isin(*refs.shares)

    def nearest(counts: str, which: int, enough: Column) -> Column:
        each = [F.expr(js_distance(counts, refs.shares[x][which])) for x in sorted(refs.shares)]
        return F.when(enough & known, F.array_min(F.array(*each))) if each else F.lit(None).cast("double")

    out = {x: free_name(rows, x) for x in ("base_failed", "class_distance", "word_distance", "kept")}
    own = [F.col(f"`{x}`") for x in (*keep, *(names[b] for b in BASE))]
    rows = rows.select(*own, nearest(names["classes"], 0, F.col(names["n"]) >= MIN_CHARS).alias(out["class_distance"]),
                       nearest(names["common"], 1, F.col(names["n_words"]) >= MIN_WORDS).alias(out["word_distance"]))
    failed = (F.col(names["n_words"]) < MIN_BASE_WORDS) | (100 * F.col(names["n_repeat_words"]) > REPEAT_PERCENT * F.col(names["n_words"]))
    far = F.coalesce(F.col(out["class_distance"]) > MAX_CLASS_DISTANCE, F.lit(False)) | F.coalesce(F.col(out["word_distance"]) > MAX_WORD_DISTANCE, F.lit(False))
    return rows.select(*own, failed.alias(out["base_failed"]), out["class_distance"], out["word_distance"], (~failed & ~far).alias(out["kept"]))


def kept_documents(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows that ``judge`` keeps, with their own columns.

    A filter on ``kept`` would be pushed below the counts and repeat them all, so
    the verdict becomes the length of an array that is exploded.
    """
    judged = judge(docs, None, text_col, lang_col)
    once = F.explode(F.when(F.col(f"`{judged.columns[-1]}`"), F.array(F.lit(0))).otherwise(F.array().cast("array<int>")))
    mark = free_name(docs, "_q_once")
    return judged.select(*(f"`{c}`" for c in docs.columns), once.alias(mark)).drop(mark)


def document_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id, counts, base_failed, distances, kept) for every row.

    Texts are read once, those of languages without fixed common words once more
    before: their counts are cut to a table, which gives the references and then
    the verdicts.
    """
    narrow = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{text_col}`").cast("string").alias("text"))
    common = common_words(narrow)
    rows, names = _measured(narrow, ["id", "lang"], "text", common)
    rows = cut(rows)
    return _judged(rows, names, ["id", "lang"], _summed(rows, names, "lang", common), "lang").drop("lang").withColumnRenamed("id", id_col)

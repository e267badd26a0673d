"""Exact and fuzzy duplicates.

Fuzzy search is an exact similarity join without all-pairs blocks:

* rows with the same comparison text collapse to one node first, so a hot text
  costs one node;
* a node is listed only under its rarest character pairs.  Two texts whose
  insert/delete ratio reaches the threshold must share one of them (prefix
  filter over bigram multisets; single characters for very short texts);
* nodes become canonical in order, as a sequential scan would do it.  In every
  round only the first ``PROBES`` undecided nodes of a list are compared with its
  members, so the pairs of a round grow linearly with the lists.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..core import action, as_list, col, string_columns
from ..functions.similarity import ratio
from ..plans.cut import cut
from .ordered import running

PROBES = 64


# ------------------------------------------------------------ exact duplicates

def _best_row(df: DataFrame, keys: list[str], order: Column, last: bool = False) -> DataFrame:
    """One row per key: an aggregate, so copies of a hot key are folded before the shuffle."""
    pick = (F.max_by if last else F.min_by)(F.struct(*[col(c).alias(c) for c in df.columns]), order)
    grouped = df.groupBy(*[col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(pick.alias("_row"))
    return grouped.select("_row.*")


def _tie_break(df: DataFrame, order_by) -> Column:
    """Total order: the given columns, then every other column."""
    first = as_list(order_by)
    return F.struct(*[col(c) for c in first + [c for c in df.columns if c not in first]])


@action("remove_duplicates", "remove_exact_duplicates", "drop_duplicates", "filter_duplicates")
def remove_duplicates(df: DataFrame, subset=None, keep: str | bool = "first", order_by=None) -> DataFrame:
    """Whole-row duplicates, or the first/last row per subset in ``order_by`` order.

    ``keep=False`` drops every row that has a copy.
    """
    keys = as_list(subset)
    if keep is False:
        names = keys or df.columns
        single = df.groupBy(*[col(n).alias(f"_k{i}") for i, n in enumerate(names)]).agg(F.count("*").alias("_n")).where("_n = 1")
        return df.join(single, [col(n).eqNullSafe(F.col(f"_k{i}")) for i, n in enumerate(names)], "left_semi")
    if not keys:
        return df.dropDuplicates()
    return _best_row(df, keys, _tie_break(df, order_by), keep == "last")


@action("dedupe_by_key")
def dedupe_by_key(df: DataFrame, key_column: str, score_column: str | None = None, keep: str = "max", order_by=None) -> DataFrame:
    """Best row per key by score; rows without a score come last."""
    if key_column not in df.columns:
        return df
    rest = [c for c in as_list(order_by) or df.columns if c not in (key_column, score_column)]
    if score_column not in df.columns:
        return _best_row(df, [key_column], F.struct(*[col(c) for c in rest]), keep == "last")
    score = col(score_column).cast("double")
    sort = F.coalesce(-score if keep != "min" else score, F.lit(float("inf")))
    return _best_row(df, [key_column], F.struct(sort.alias("_s"), *[col(c) for c in rest]))


def flag_duplicate_ids(df: DataFrame, columns=None) -> DataFrame:
    """``(column, rows, distinct, duplicate_share)`` of ID-like columns."""
    from .profile import union_all

    names = as_list(columns) or [c for c in df.columns if c.lower() == "id" or c.lower().endswith(("_id", "key"))]
    parts = []
    for n in names:
        values = df.where(col(n).isNotNull()).groupBy(col(n)).agg(F.count("*").alias("_c"))
        parts.append(values.agg(F.coalesce(F.sum("_c"), F.lit(0)).alias("rows"), F.count("*").alias("distinct"))
                     .select(F.lit(n).alias("column"), "rows", "distinct"))
    return union_all(parts).withColumn("duplicate_share", 1 - F.try_divide("distinct", "rows"))


# ------------------------------------------------------------ fuzzy duplicates

def _needed_pairs(length: int, share: float) -> float:
    """Least number of shared bigrams of a text with any text that reaches the ratio."""
    worst = max(
        length * (2 - 1.5 * share) + other * (1 - 1.5 * share)
        for other in (share / (2 - share) * length, (2 - share) / share * length)
    )
    return length - 1 - worst


def _signature(nodes: DataFrame, threshold: float) -> DataFrame:
    """``(g, nid)``: every node under its rarest bigrams (or characters when short)."""
    share = threshold / 100
    short = max([n for n in range(0, 400) if _needed_pairs(n, share) < 1 - 1e-9], default=0)
    only_characters = short >= 399
    reach = math.floor((2 - share) / share * short + 1e-9)
    size = F.length("text")

    def grams(q: int, keep: Column, kept: Column) -> DataFrame:
        pieces = F.transform(F.sequence(F.lit(1), F.col("_len") - (q - 1)), lambda i: F.substr(F.col("text"), i, F.lit(q)))
        listed = nodes.withColumn("_len", size).where(keep & (F.col("_len") >= q)).select(
            "nid", "block", kept.cast("int").alias("keep"), F.explode(pieces).alias("gram"))
        counted = listed.groupBy("nid", "block", "keep", "gram").agg(F.count("*").alias("c"))
        # the k-th occurrence of a gram is its own token (multiset overlap)
        each = counted.withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("c"))))
        return each.select("nid", "keep", F.struct(F.lit(q).alias("q"), F.col("block").alias("b"), F.col("gram").alias("t"), "k").alias("g"))

    length = F.col("_len")
    parts = []
    # length - needed bigrams = listed ones
    worst = F.greatest(*[
        length * (2 - 1.5 * share) + length * factor * (1 - 1.5 * share)
        for factor in (share / (2 - share), (2 - share) / share)
    ])
    needed = F.ceil(length - 1 - worst - 1e-9)
    if not only_characters:
        parts.append(grams(2, needed >= 1, length - needed))
    one = length - F.ceil(length * share / (2 - share) - 1e-9) + 1
    parts.append(grams(1, F.lit(True) if only_characters else length <= reach, one))
    tokens = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    common = tokens.groupBy("g").agg(F.count("*").alias("df"))
    # rarest first inside each text; the list is as long as the text, never longer
    rare = tokens.join(common, "g").groupBy("nid", F.col("g.q").alias("q"), "keep").agg(
        F.array_sort(F.collect_list(F.struct("df", "g"))).alias("all"))
    return rare.select("nid", F.explode(F.slice("all", F.lit(1), F.col("keep"))).alias("x")).select(
        F.xxhash64("x.g").alias("g"), "nid")


def _clusters(nodes: DataFrame, threshold: float, probes: int) -> DataFrame:
    """``(nid, cid)``: canonical node of every node (itself when it is canonical).

    ``nodes``: nid (dense, in scan order), text, block.
    """
    nodes = cut(nodes)
    lists = cut(_signature(nodes, threshold).distinct())
    texts = nodes.select("nid", "text", F.length("text").alias("len"))
    sizes = lists.groupBy("nid").agg(F.count("*").alias("lists"))
    share = threshold / 100
    low, high = share / (2 - share) - 1e-9, (2 - share) / share + 1e-9
    # cid null = undecided; settled rows are fixed for good
    state = cut(nodes.select("nid", F.lit(None).cast("long").alias("cid")).join(sizes, "nid", "left").withColumn(
        "lists", F.coalesce("lists", F.lit(0).cast("long"))))
    while True:
        undecided = state.where("cid is null").select("nid", "lists")
        if undecided.isEmpty():
            return state.select("nid", "cid")
        open_lists = lists.join(undecided, "nid")
        place = F.row_number().over(W.partitionBy("g").orderBy("nid"))
        first = open_lists.select("g", "nid", "lists", place.alias("r")).where(F.col("r") <= probes + 1)
        # a node is fully compared when all earlier undecided members of its lists are probes
        full = first.groupBy("nid", "lists").agg(F.count("*").alias("n")).where("n = lists").select("nid")
        alone = undecided.where("lists = 0").select("nid")
        full = full.unionByName(alone)
        targets = lists.join(state.where("cid is null or cid < nid").select("nid", F.coalesce("cid", "nid").alias("limit")), "nid")
        pairs = first.where(F.col("r") <= probes).select("g", F.col("nid").alias("p")).join(
            targets, "g").where("p < limit").select("p", "nid").distinct()
        scored = (
            pairs.join(texts.select(F.col("nid").alias("p"), F.col("text").alias("tp"), F.col("len").alias("lp")), "p")
            .join(texts, "nid").where((F.col("lp") >= F.col("len") * low) & (F.col("lp") <= F.col("len") * high))
            .where(ratio(F.col("tp"), F.col("text")) >= threshold - 1e-9).select("p", "nid")
        )
        edges = cut(scored)
        chosen = full.join(edges.select("nid"), "nid", "left_anti")
        taken = edges.join(chosen.select(F.col("nid").alias("p")), "p").groupBy("nid").agg(F.min("p").alias("new"))
        marks = chosen.select("nid", F.col("nid").alias("new")).unionByName(taken)
        state = cut(state.join(marks, "nid", "left").select("nid", F.least("cid", "new").alias("cid"), "lists"))


def _numbered(values: DataFrame, order: list[str]) -> DataFrame:
    return running(values, None, order, {"nid": ("count", F.lit(1))})


def _row_clusters(df: DataFrame, columns, threshold: float, order_by, block: Column | None, probes: int) -> DataFrame:
    """Rows with ``_text`` (comparison text), ``_block``, ``_cid`` and the text's first row position."""
    names = as_list(columns) or string_columns(df)
    order = as_list(order_by) or df.columns
    key = F.concat_ws(" | ", *[F.coalesce(col(c).cast("string"), F.lit("")) for c in names])
    text = F.array_join(F.array_sort(F.filter(F.split(key, r"\s+"), lambda w: w != "")), " ")
    tagged = df.withColumns({"_text": text, "_block": block if block is not None else F.lit("")})
    nodes = tagged.groupBy("_text", "_block").agg(F.min(F.struct(*[col(o).alias(f"o{i}") for i, o in enumerate(order)])).alias("_first"))
    numbered = _numbered(nodes.select("_text", "_block", "_first", "_first.*"), [f"o{i}" for i in range(len(order))])
    base = cut(numbered.select("nid", F.col("_text"), F.col("_block"), "_first"))
    found = _clusters(base.select("nid", F.col("_text").alias("text"), F.col("_block").alias("block")), threshold, probes)
    mapped = base.join(found, "nid")
    firsts = base.select(F.col("nid").alias("cid"), F.col("_first").alias("_canonical"))
    mapped = mapped.join(firsts, "cid").select("_text", "_block", "cid", "_canonical")
    here = F.struct(*[col(o).alias(f"o{i}") for i, o in enumerate(order)])
    return tagged.join(mapped, ["_text", "_block"]).withColumn("_here", here)


def find_fuzzy_duplicates(df: DataFrame, columns=None, threshold: float = 85, order_by=None, block: Column | None = None,
                          probes: int = PROBES) -> DataFrame:
    """``(group_id, order columns..., is_canonical)`` of rows in groups of two and more.

    ``order_by`` must identify a row; it defines which row is first.
    """
    order = as_list(order_by) or df.columns
    rows = _row_clusters(df, columns, threshold, order, block, probes)
    sizes = rows.groupBy("cid").agg(F.count("*").alias("_n")).where("_n > 1")
    return rows.join(sizes, "cid").select(
        F.col("cid").alias("group_id"), *[col(o) for o in order], (F.col("_here") == F.col("_canonical")).alias("is_canonical"))


@action("fuzzy_remove_duplicates")
def remove_fuzzy_duplicates(df: DataFrame, columns=None, threshold: float = 85, order_by=None, block: Column | None = None,
                            probes: int = PROBES) -> DataFrame:
    """Keep the first row of every group of near-duplicates."""
    rows = _row_clusters(df, columns, threshold, order_by, block, probes)
    return rows.where(F.col("_here") == F.col("_canonical")).select(*[col(c) for c in df.columns])


@action("fuzzy_dedup_blocked")
def fuzzy_dedup_blocked(df: DataFrame, columns=None, threshold: float = 85, blocking_col: str | None = None, order_by=None,
                        probes: int = PROBES) -> DataFrame:
    """Compare only rows whose blocking column starts with the same character."""
    name = blocking_col or (as_list(columns) or string_columns(df))[0]
    block = F.coalesce(F.upper(F.substring(col(name).cast("string"), 1, 1)), F.lit(""))
    return remove_fuzzy_duplicates(df, columns, threshold, order_by, block, probes)


@action("fuzzy_match_merge")
def fuzzy_match_merge(df: DataFrame, column: str, threshold: float = 85, strategy: str = "keep_first", order_by=None,
                      probes: int = PROBES) -> DataFrame:
    """Map similar values to the first of them (by ``order_by``, else by value), then drop equal rows."""
    if column not in df.columns:
        return df
    order = as_list(order_by) or [column]
    values = df.where(col(column).isNotNull()).groupBy(col(column).alias("_v")).agg(
        F.min(F.struct(*[col(o).alias(f"o{i}") for i, o in enumerate(order)])).alias("_o"))
    # values that differ in case only are one node
    nodes = values.groupBy(F.lower("_v").alias("text")).agg(F.min(F.struct("_o", "_v")).alias("_f"))
    numbered = _numbered(nodes.select("text", F.col("_f._v").alias("_best"), "_f._o.*"), [f"o{i}" for i in range(len(order))])
    base = cut(numbered.select("nid", "text", "_best"))
    found = _clusters(base.select("nid", "text", F.lit("").alias("block")), threshold, probes)
    best = found.join(base.select(F.col("nid").alias("cid"), "_best"), "cid").join(base.select("nid", "text"), "nid").select("text", "_best")
    joined = df.join(best, F.lower(col(column)) == F.col("text"), "left")
    out = joined.select(*[F.coalesce("_best", col(c)).alias(c) if c == column else col(c) for c in df.columns])
    return out.dropDuplicates() if strategy == "keep_first" else out


@action("fuzzy_find_replace")
def fuzzy_find_replace(df: DataFrame, column: str, mapping: dict, threshold: float = 90) -> DataFrame:
    """Replace a value by the entry of the best matching key at or above the threshold.

    Scores are computed once per distinct value, against the given dictionary only.
    """
    if column not in df.columns or not mapping:
        return df
    entries = F.array(*[
        F.struct(F.lit(str(k).lower()).alias("k"), F.lit(str(v)).alias("w"), F.lit(-i).alias("i")) for i, (k, v) in enumerate(mapping.items())
    ])
    values = df.where(col(column).isNotNull()).select(col(column).cast("string").alias("_v")).distinct()
    scored = values.withColumn("e", F.explode(entries)).withColumn("s", ratio(F.lower("_v"), F.col("e.k")))
    best = scored.where(F.col("s") >= threshold).groupBy("_v").agg(F.max_by("e.w", F.struct("s", "e.i")).alias("_w"))
    joined = df.join(best, col(column).cast("string") == F.col("_v"), "left")
    return joined.select(*[F.coalesce("_w", col(c).cast("string")).alias(c) if c == column else col(c) for c in df.columns])


@action("calculate_similarity", row_wise=True)
def calculate_similarity(df: DataFrame, column1: str, column2: str, method: str = "ratio", new_col: str = "similarity_score") -> DataFrame:
    """Score 0-1 of two columns: ratio, partial, token_sort or token_set."""
    from ..functions.similarity import SCORES

    if column1 not in df.columns or column2 not in df.columns:
        return df
    score = SCORES.get(method, SCORES["token_set"])
    return df.withColumn(new_col, score(col(column1).cast("string"), col(column2).cast("string")) / 100)

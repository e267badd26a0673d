"""Text similarity scores (0-100) on candidate pairs, in Arrow batches."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .text import squeeze


def _score_function():
    """100 * 2 * longest common subsequence / total length, by bit-parallel rows.

    Made inside a function so that it travels to workers by value.
    """
    def score(a, b):
        total = len(a) + len(b)
        if total == 0 or a == b:
            return 100.0
        masks = {}
        for i, ch in enumerate(a):
            masks[ch] = masks.get(ch, 0) | (1 << i)
        full = (1 << len(a)) - 1
        state = full
        for ch in b:
            hit = state & masks.get(ch, 0)
            state = ((state + hit) | (state - hit)) & full
        return 200.0 * (len(a) - bin(state).count("1")) / total

    return score


indel_ratio = _score_function()


def ratio(a: Column, b: Column) -> Column:
    """Exact insert/delete ratio of two texts."""
    score = _score_function()

    def batch(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([score(x, y) if x is not None and y is not None else None for x, y in zip(left, right)], dtype="float64")

    return F.pandas_udf(batch, DoubleType())(a, b)


def partial_ratio(a: Column, b: Column) -> Column:
    """Best ratio of the shorter text against any window of the longer one."""
    score = _score_function()

    def best(x, y):
        short, long = (x, y) if len(x) <= len(y) else (y, x)
        n = len(short)
        if n == 0:
            return 100.0 if not long else 0.0
        top = 0.0
        for start in range(1 - n, len(long)):
            window = long[max(start, 0):start + n]
            top = max(top, score(short, window))
            if top == 100.0:
                break
        return top

    def batch(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([best(x, y) if x is not None and y is not None else None for x, y in zip(left, right)], dtype="float64")

    return F.pandas_udf(batch, DoubleType())(a, b)


def tokens(c: Column) -> Column:
    return F.filter(F.split(squeeze(c), " "), lambda w: w != "")


def token_sort_ratio(a: Column, b: Column) -> Column:
    return ratio(F.array_join(F.array_sort(tokens(a)), " "), F.array_join(F.array_sort(tokens(b)), " "))


def token_set_ratio(a: Column, b: Column) -> Column:
    """Best ratio among the shared words and the shared words plus either rest."""
    ta, tb = F.array_distinct(tokens(a)), F.array_distinct(tokens(b))
    shared = F.array_join(F.array_sort(F.array_intersect(ta, tb)), " ")
    rest_a = F.array_join(F.array_sort(F.array_except(ta, tb)), " ")
    rest_b = F.array_join(F.array_sort(F.array_except(tb, ta)), " ")

    def joined(rest):
        return F.trim(F.concat(shared, F.lit(" "), rest))

    subset = (shared != "") & ((rest_a == "") | (rest_b == ""))
    with_shared = F.when(shared != "", F.greatest(ratio(shared, joined(rest_a)), ratio(shared, joined(rest_b)))).otherwise(0.0)
    return F.when((F.size(ta) == 0) | (F.size(tb) == 0), 0.0).when(subset, 100.0).otherwise(
        F.greatest(ratio(joined(rest_a), joined(rest_b)), with_shared))


SCORES = {"ratio": ratio, "partial": partial_ratio, "token_sort": token_sort_ratio, "token_set": token_set_ratio}

"""Seasonal decomposition by local regression, over overlapping chunks of the series.

A value is the sum of a trend, a seasonal part and a residual.  Each inner round
smooths every phase of the season by itself, takes a low-pass of that out of it,
and smooths what is left as the trend, all by local lines with tricube weights.
Outer rounds weigh values by their residual, so that outliers bend neither part.

The smoothers have a known reach, so chunks with a halo give the same values as
the whole series.  Only the weights need something of the whole series, the
median residual: a series in one chunk has it at hand, and for longer ones it is
found between two rounds, one number for each such series.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..core import as_list, col
from ..functions.stats import grouped_quantile, quantiles
from ..plans.cut import cut
from .chunks import each_chunk, overlapping
from .ordered import running

ROWS_PER_CHUNK = 100_000
#: numbers in one matrix of windows
WINDOW_CELLS = 1 << 21
#: numbers in a matrix of windows that is remembered
KNOWN_CELLS = 1 << 15

# --- fixed values: the usual parameters of this decomposition --------------------
SEASONAL = 7
INNER_PLAIN, INNER_ROBUST, ROBUST_ROUNDS = 5, 2, 15
NEAR, FAR, FLAT = 0.001, 0.999, 0.001
# --- end of fixed values ---------------------------------------------------------


def spans(period: int, seasonal: int = SEASONAL) -> tuple[int, int]:
    """Odd window lengths of the trend and of the low-pass."""
    trend = math.ceil(1.5 * period / (1 - 1.5 / seasonal))
    low = period + 1
    return trend + (trend % 2 == 0), low + (low % 2 == 0)


def reach(period: int, seasonal: int, rounds: int) -> int:
    """Rows that the edge of a chunk can spoil in ``rounds`` inner rounds."""
    trend, low = spans(period, seasonal)
    return rounds * ((seasonal // 2 + 1) * period + period + 2 + low // 2 + 1 + trend // 2 + 1)


def _windows(n: int, span: int, start: int, stop: int, ends: bool):
    """Places, and for each the rows of its window and their tricube weights."""
    used = min(span, n)
    if ends:
        x, left = np.array([-1.0, n])[:, None], np.array([0, n - used])[:, None]
    else:
        x = np.arange(start, stop, dtype=float)[:, None]
        left = np.clip(np.arange(start, stop) - span // 2, 0, n - used)[:, None]
    index = left + np.arange(used)
    far = np.maximum(x - left, left + used - 1 - x) + ((span - n) // 2 if span > n else 0)
    gap = np.abs(index - x)
    with np.errstate(divide="ignore", invalid="ignore"):
        w = np.where(gap <= NEAR * far, 1.0, (1 - (gap / far) ** 3) ** 3)
    w[gap > FAR * far] = 0.0
    return x, index, w, far > 0


#: windows of short series, which repeat in every round and from series to series
_known_windows = lru_cache(maxsize=32)(_windows)


def _fit(y, span, total, weights, ends=False):
    """Local lines at every place of each row of y (with ``ends``: one place before and one after); NaN where all weights are 0."""
    m, n = y.shape
    used, places = min(span, n), 2 if ends else n
    find = _known_windows if places * used <= KNOWN_CELLS else _windows
    step = max(1, WINDOW_CELLS // (used * m))
    out = np.empty((m, places))
    for a in range(0, places, step) if not ends else (0,):
        b = places if ends else min(places, a + step)
        x, index, base, wide = find(n, span, a, b, ends)
        w = base[None] if weights is None else base * weights[:, index]
        whole = w.sum(axis=2, keepdims=True)
        some = whole > 0
        w = w / np.where(some, whole, 1.0)
        centre = (w * index).sum(axis=2, keepdims=True)
        off = index - centre
        spread = (w * off * off).sum(axis=2, keepdims=True)
        sloped = wide & (np.sqrt(spread) > FLAT * (total - 1))
        slope = np.where(sloped, (x - centre) / np.where(sloped, spread, 1.0), 0.0)
        fitted = (w * (slope * off + 1) * y[:, index]).sum(axis=2)
        out[:, a:b] = np.where(some[:, :, 0], fitted, np.nan)
    return out


def smooth(y, span, total, weights=None, beyond=False):
    """Local regression at every place of each row of y; with ``beyond`` also one place before and one after.

    ``total`` is the length of the whole series, of which y may be a part.  A
    place where all weights are 0 keeps its value (beyond: its neighbour's).
    """
    out = _fit(y, span, total, weights)
    out = np.where(np.isnan(out), y, out)
    if not beyond:
        return out
    ends = _fit(y, span, total, weights, ends=True)
    ends = np.where(np.isnan(ends), out[:, [0, -1]], ends)
    return np.hstack([ends[:, :1], out, ends[:, 1:]])


def _means(y, span):
    sums = np.cumsum(np.concatenate([[0.0], y]))
    return (sums[span:] - sums[:-span]) / span


def _alike(n, total, period):
    """Phases with as many rows in the part, and in the whole series, as each other."""
    cuts = sorted({0, n % period, total % period, period})
    return [np.arange(a, b) for a, b in zip(cuts, cuts[1:])]


def inner(y, trend, weights, total, period, seasonal, rounds):
    """(seasonal part, trend) after ``rounds`` inner rounds from the given trend.

    y starts at a multiple of the period in its series of ``total`` values.
    """
    n = len(y)
    long, low = spans(period, seasonal)
    part, cycles = np.zeros(n), []
    for phases in _alike(n, total, period):
        cycles.append((phases, phases[:, None] + period * np.arange((n - phases[0] - 1) // period + 1)))
    for _ in range(rounds):
        plain = y - trend
        cycle = np.empty(n + 2 * period)
        # phases of one length are smoothed together
        for phases, lines in cycles:
            there = total // period + (phases[0] < total % period)
            held = None if weights is None else weights[lines]
            cycle[np.hstack([lines, lines[:, -1:] + period, lines[:, -1:] + 2 * period])] = smooth(plain[lines], seasonal, there, held, beyond=True)
        passed = smooth(_means(_means(_means(cycle, period), period), 3)[None], low, total)[0]
        part = cycle[period:period + n] - passed
        trend = smooth((y - part)[None], long, total, None if weights is None else weights[None])[0]
    return part, trend


def robust(gap, middle):
    """Weights of values by their distance from the fit; ``middle`` is the median distance."""
    scale = 6 * middle
    if scale == 0:
        return np.ones(len(gap))
    weights = np.where(gap <= NEAR * scale, 1.0, (1 - (gap / scale) ** 2) ** 2)
    weights[gap > FAR * scale] = 0.0
    return weights


def whole(y, period, seasonal, rounds, outer):
    """(seasonal part, trend, weights) of a series that lies in one chunk."""
    weights, trend, n = None, np.zeros(len(y)), len(y)
    for left in range(outer, -1, -1):
        part, trend = inner(y, trend, weights, n, period, seasonal, rounds)
        if left:
            gap = np.abs(y - trend - part)
            weights = robust(gap, float(np.median(gap)))
    return part, trend, np.ones(n) if weights is None else weights


def stl(df: DataFrame, order_by, value_col: str, period: int, partition_by=None, seasonal: int = SEASONAL, robust_rounds: int = ROBUST_ROUNDS,
        rows_per_chunk: int = ROWS_PER_CHUNK, rows_per_bucket: int | None = None) -> DataFrame:
    """Adds ``_row`` (from 1), ``trend``, ``seasonal``, ``residual`` and ``weight`` by local regression.

    Null and NaN values are left out, as are infinite ones.  A series with fewer than two
    whole periods and a row has no season: its rows come with nulls.  ``order_by``
    is unique within a series.  ``robust_rounds`` 0 weighs all values alike.
    """
    if period < 2:
        raise ValueError("a season has two rows at least")
    if seasonal < 3 or seasonal % 2 == 0:
        raise ValueError("the seasonal window is odd and 3 at least")
    keys, order = as_list(partition_by), as_list(order_by)
    rounds = INNER_ROBUST if robust_rounds else INNER_PLAIN
    halo = period * math.ceil(reach(period, seasonal, rounds * (robust_rounds + 1)) / period)
    width = period * math.ceil(max(rows_per_chunk, halo) / period)

    value = col(value_col).cast("double")
    data = df.where(value.isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(float("inf"))))
    # read by the counts, by the chunks and by the result
    numbered = cut(running(data, keys, order, {"_row": ("count", F.lit(1))}, rows_per_bucket=rows_per_bucket))
    slim = numbered.select(*[col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_row", value.alias("_y"))
    names = [f"_k{i}" for i in range(len(keys))]
    parts = _parts(slim, names, period, seasonal, rounds, robust_rounds, width, halo)
    same = [F.col("_row") == F.col("_at") + 1] + [col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    made = numbered.join(parts, same, "left")
    return made.select(*[col(c) for c in df.columns], "_row", F.col("_t").alias("trend"), F.col("_s").alias("seasonal"),
                       (value - F.col("_t") - F.col("_s")).alias("residual"), F.col("_w").alias("weight"))


def _parts(slim: DataFrame, keys: list[str], period: int, seasonal: int, rounds: int, outer: int, width: int, halo: int) -> DataFrame:
    """Keys, ``_at``, ``_s``, ``_t``, ``_w`` of every row of a series that is long enough."""
    counts = slim.groupBy(*keys).agg(F.count("*").alias("_n"))
    if keys:
        counts = counts.select(*[F.col(k).alias("c" + k) for k in keys], "_n")
        sized = slim.join(counts, [F.col(k).eqNullSafe(F.col("c" + k)) for k in keys])
    else:
        sized = slim.crossJoin(F.broadcast(counts))  # one row
    sized = sized.where(F.col("_n") >= 2 * period + 1)
    chunks = overlapping(sized, keys, F.col("_row") - 1, width, halo, ["_n", "_y"])

    kind = T.StructType(chunks.schema.fields + [T.StructField(c, T.DoubleType()) for c in ("_s", "_t", "_w")])

    def first(batches):
        def work(table):
            y, n = table["_y"].to_numpy(), table["_n"][0].as_py()
            if n <= width:
                part, trend, weights = whole(y, period, seasonal, rounds, outer)
            else:
                part, trend = inner(y, np.zeros(len(y)), None, n, period, seasonal, rounds)
                weights = np.ones(len(y))
            return _with(table, _s=part, _t=trend, _w=weights)

        return each_chunk(batches, work)

    state = chunks.mapInArrow(first, kind)
    if outer:
        state = cut(state)
        long = F.col("_n") > width
        if not state.where(long).isEmpty():
            short, state = state.where(~long), state.where(long)
            for _ in range(outer):
                state = _round(state, keys, period, seasonal, rounds, kind)
            state = state.unionByName(short)
    return state.where("_own").select(*keys, "_at", "_s", "_t", "_w")


def _with(table: pa.Table, **values) -> pa.Table:
    for name, array in values.items():
        column, index = pa.array(array), table.schema.get_field_index(name)
        table = table.append_column(name, column) if index < 0 else table.set_column(index, name, column)
    return table


def _round(state: DataFrame, keys: list[str], period: int, seasonal: int, rounds: int, kind: T.StructType) -> DataFrame:
    """Weights from the last fit, and the next one; only series of several chunks come here.

    There is one median a series, and a series here has more rows than a chunk,
    so the broadcast holds less than a row a chunk.
    """
    gap: Column = F.abs(F.col("_y") - F.col("_s") - F.col("_t"))
    own = state.where("_own")
    if keys:
        middle = grouped_quantile(own, keys, gap, 0.5).select(*[F.col(k).alias("m" + k) for k in keys], F.col("q").alias("_m"))
        ready = state.join(F.broadcast(middle), [F.col(k).eqNullSafe(F.col("m" + k)) for k in keys]).drop(*["m" + k for k in keys])
    else:
        ready = state.withColumn("_m", F.lit(quantiles(own, {"g": gap}, [0.5])["g"][0]))

    def next_fit(batches):
        def work(table):
            y, trend, n = table["_y"].to_numpy(), table["_t"].to_numpy(), table["_n"][0].as_py()
            weights = robust(np.abs(y - trend - table["_s"].to_numpy()), table["_m"][0].as_py())
            part, trend = inner(y, trend, weights, n, period, seasonal, rounds)
            return _with(table.drop_columns(["_m"]), _s=part, _t=trend, _w=weights)

        return each_chunk(batches, work)

    return cut(ready.select(*kind.names, "_m").mapInArrow(next_fit, kind))

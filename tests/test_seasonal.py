"""Seasonal decomposition against a plain sequential one, on series in one and in many chunks."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from scrubline.operators import anomalies, seasonal


def line_at(y, x, span, lo, weights, total):
    """Local line at x through span values from lo on, value by value."""
    n = len(y)
    used = min(span, n)
    far = max(x - lo, lo + used - 1 - x) + ((span - n) // 2 if span > n else 0)
    w = []
    for j in range(lo, lo + used):
        gap = abs(j - x)
        v = 0.0 if gap > 0.999 * far else 1.0 if gap <= 0.001 * far else (1 - (gap / far) ** 3) ** 3
        w.append(v * weights[j])
    if sum(w) <= 0:
        return None
    w = [v / sum(w) for v in w]
    mid = sum(v * j for v, j in zip(w, range(lo, lo + used)))
    spread = sum(v * (j - mid) ** 2 for v, j in zip(w, range(lo, lo + used)))
    if far > 0 and math.sqrt(spread) > 0.001 * (total - 1):
        w = [v * ((x - mid) / spread * (j - mid) + 1) for v, j in zip(w, range(lo, lo + used))]
    return sum(v * y[j] for v, j in zip(w, range(lo, lo + used)))


def loess(y, span, weights=None):
    n, weights = len(y), weights or [1.0] * len(y)
    out = []
    for i in range(n):
        lo = min(max(0, i - span // 2), max(0, n - span))
        v = line_at(y, i, span, lo, weights, n)
        out.append(y[i] if v is None else v)
    return out


def sequential(y, period, outer, inner, span=7):
    """Trend and seasonal part of one series, one value at a time."""
    n = len(y)
    trend, weights = [0.0] * n, [1.0] * n
    long = math.ceil(1.5 * period / (1 - 1.5 / span)) | 1
    low = (period + 1) | 1
    mean = lambda v, k: [sum(v[i:i + k]) / k for i in range(len(v) - k + 1)]
    for turn in range(outer + 1):
        for _ in range(inner):
            plain = [a - b for a, b in zip(y, trend)]
            cycle = [0.0] * (n + 2 * period)
            for p in range(period):
                sub, w = plain[p::period], weights[p::period]
                mids = loess(sub, span, w)
                k = len(sub)
                before = line_at(sub, -1, span, 0, w, k)
                after = line_at(sub, k, span, max(0, k - span), w, k)
                cycle[p::period] = [mids[0] if before is None else before, *mids, mids[-1] if after is None else after]
            passed = loess(mean(mean(mean(cycle, period), period), 3), low)
            part = [cycle[period + i] - passed[i] for i in range(n)]
            trend = loess([a - b for a, b in zip(y, part)], long, weights)
        if turn < outer:
            gap = [abs(a - b - c) for a, b, c in zip(y, trend, part)]
            scale = 6 * float(np.median(gap))
            weights = [0.0 if g > 0.999 * scale else 1.0 if g <= 0.001 * scale else (1 - (g / scale) ** 2) ** 2 for g in gap] if scale else [1.0] * n
    return trend, part, weights


def series(n, period, seed):
    rng = random.Random(seed)
    return [5 + 0.02 * i + 3 * math.sin(2 * math.pi * i / period) + rng.gauss(0, 0.4) + (25 if i % 61 == 40 else 0) for i in range(n)]


def table(spark, named):
    rows = [(k, i, v) for k, y in named.items() for i, v in enumerate(y)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "key string, t int, v double").repartition(4)


def close(rows, y, period, outer, inner):
    trend, part, weights = sequential(y, period, outer, inner)
    rows = sorted(rows, key=lambda r: r.t)
    assert len(rows) == len(y)
    for got, want in (("trend", trend), ("seasonal", part), ("weight", weights), ("residual", [a - b - c for a, b, c in zip(y, trend, part)])):
        assert np.abs(np.array([r[got] for r in rows]) - want).max() < 1e-6, got


@pytest.mark.parametrize("period,n", [(4, 90), (7, 200), (12, 100)])
def test_robust_equals_the_sequential_one(spark, period, n):
    y = series(n, period, period)
    out = seasonal.stl(table(spark, {"a": y}), "t", "v", period).collect()
    close(out, y, period, 15, 2)


@pytest.mark.parametrize("rounds", [0, 2])
def test_many_chunks_and_keys_equal_the_sequential_one(spark, rounds):
    named = {"long": series(1500, 4, 1), "short": series(60, 4, 2), None: series(700, 4, 3)}
    out = seasonal.stl(table(spark, named), "t", "v", 4, "key", robust_rounds=rounds, rows_per_chunk=1, rows_per_bucket=500).collect()
    assert seasonal.reach(4, 7, 6) < 500  # the long ones lie in several chunks
    for key, y in named.items():
        close([r for r in out if r.key == key], y, 4, rounds, 2 if rounds else 5)


def test_one_long_series_without_keys(spark):
    y = series(1200, 4, 9)
    out = seasonal.stl(table(spark, {"a": y}).drop("key"), "t", "v", 4, robust_rounds=2, rows_per_chunk=1).collect()
    close(out, y, 4, 2, 2)


def test_short_empty_and_missing(spark):
    df = table(spark, {"a": [1.0, None, float("nan"), 2.0, 3.0, float("inf")]})
    rows = seasonal.stl(df, "t", "v", 4).collect()
    assert sorted((r.t, r.trend) for r in rows) == [(0, None), (3, None), (4, None)]
    assert seasonal.stl(df.limit(0), "t", "v", 4, "key").count() == 0
    flat = seasonal.stl(table(spark, {"a": [2.0] * 30}), "t", "v", 4).collect()
    assert max(abs(r.residual) for r in flat) < 1e-9
    with pytest.raises(ValueError):
        seasonal.stl(df, "t", "v", 1)


def test_anomalies_by_local_regression(spark):
    y = series(400, 7, 4)
    df = table(spark, {"a": y})
    found = {r.t for r in anomalies.timeseries_anomalies(df, "t", "v", 7, method="stl").collect()}
    trend, part, _ = sequential(y, 7, 15, 2)
    residual = np.array(y) - trend - part
    q1, q3 = np.quantile(residual, [0.25, 0.75])
    want = set(np.flatnonzero((residual < q1 - 3 * (q3 - q1)) | (residual > q3 + 3 * (q3 - q1))))
    assert found == want >= {40, 101, 162, 223, 284, 345}
    row = anomalies.timeseries_summary(df, "t", "v", 7, method="stl").first()
    assert row.anomaly_count == len(want) and abs(row.trend_slope - np.polyfit(range(400), trend, 1)[0]) < 1e-6
    short = df.where(F.col("t") < 10)
    assert anomalies.timeseries_anomalies(short, "t", "v", 7, method="stl").count() == 0

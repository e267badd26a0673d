"""Interpolating curves: chunked knots against dense solves and known properties."""

import random

import numpy as np
import pytest

from scrubline.operators import curves, missing


def dense_spline(x, y):
    """Coefficients of all cubics from one dense system: values, two derivatives, same cubic at both ends."""
    n = len(x) - 1
    a, b = np.zeros((4 * n, 4 * n)), np.zeros(4 * n)
    row = 0
    for i in range(n):
        h = x[i + 1] - x[i]
        a[row, 4 * i] = 1
        b[row] = y[i]
        a[row + 1, 4 * i:4 * i + 4] = [1, h, h * h, h ** 3]
        b[row + 1] = y[i + 1]
        row += 2
        if i < n - 1:
            a[row, 4 * i:4 * i + 4], a[row, 4 * i + 5] = [0, 1, 2 * h, 3 * h * h], -1
            a[row + 1, 4 * i:4 * i + 4], a[row + 1, 4 * i + 6] = [0, 0, 2, 6 * h], -2
            row += 2
    a[row, 3], a[row, 7] = 1, -1
    a[row + 1, 4 * n - 5], a[row + 1, 4 * n - 1] = 1, -1
    return np.linalg.solve(a, b).reshape(n, 4)


def sparse(n, seed):
    rng = random.Random(seed)
    return [rng.uniform(-5, 5) if rng.random() < 0.4 else None for _ in range(n)]


def filled(spark, y, method, **params):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(y)], "t int, v double").repartition(4)
    return [r.v for r in missing.fill_missing_interpolate(df, "v", "t", method=method, **params).orderBy("t").collect()]


@pytest.mark.parametrize("method", ["cubic", "cubicspline"])
def test_spline_over_chunks_equals_the_dense_solve(spark, method):
    y = sparse(900, 3)
    x = [i for i, v in enumerate(y) if v is not None]
    parts = dense_spline(x, [y[i] for i in x])
    got = filled(spark, y, method, rows_per_bucket=100)
    assert len(x) > 3 * 100
    for i, v in enumerate(got):
        k = np.searchsorted(x, i, side="right") - 1
        if k < 0 or (method == "cubic" and i > x[-1]):
            assert v is None
            continue
        k = min(k, len(x) - 2)
        want = np.polyval(parts[k][::-1], i - x[k])
        assert abs(v - want) < 1e-8 * max(1, abs(want)), i


@pytest.mark.parametrize("method", ["pchip", "akima"])
def test_local_curves_do_not_depend_on_the_chunks(spark, method):
    y = sparse(600, 8)
    assert filled(spark, y, method, rows_per_bucket=7) == pytest.approx(filled(spark, y, method), nan_ok=True, abs=1e-12)


def test_pchip_keeps_the_shape_and_akima_keeps_lines():
    x, y = np.array([0.0, 2, 3, 7, 8, 11]), np.array([0.0, 1, 4, 4, 6, 5])
    d = curves.pchip(x, y)
    assert d[2] == 0 and d[3] == 0 and d[4] == 0 and d[1] > 0
    assert np.allclose(curves.akima(x, 3 * x - 1), 3) and np.allclose(curves.spline(x, 3 * x - 1), 3)
    cubic = x ** 3 - 2 * x
    assert np.allclose(curves.spline(x, cubic), 3 * x ** 2 - 2)
    # steps 1 1 4 9: slope in the middle (|9-4| * 1 + |1-1| * 4) / 5
    assert np.isclose(curves.akima(np.arange(5.0), np.array([0.0, 1, 2, 6, 15]))[2], 1.0)


def test_keys_few_values_and_empty(spark):
    rows = [("a", 0, 1.0), ("a", 1, None), ("a", 2, 3.0), ("a", 3, None), ("b", 0, None), ("b", 1, 5.0), ("b", 2, None), (None, 0, 2.0), (None, 1, None), (None, 2, 4.0), (None, 3, 8.0)]
    df = spark.createDataFrame(rows, "k string, t int, v double")
    for method, tail in (("cubicspline", 4.0), ("pchip", 4.0), ("akima", None), ("cubic", None)):
        got = {(r.k, r.t): r.v for r in missing.fill_missing_interpolate(df, "v", "t", "k", method).collect()}
        assert got[("a", 1)] == pytest.approx(2.0) and got[("a", 3)] == tail
        assert got[("b", 0)] is None and got[("b", 1)] == 5.0 and got[("b", 2)] is None
        assert len(got) == len(rows)
    assert got[(None, 1)] == pytest.approx(2.0)  # the parabola through three points
    assert missing.fill_missing_interpolate(df.limit(0), "v", "t", method="pchip").count() == 0

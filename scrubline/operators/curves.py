"""Piecewise cubic curves through the known values of ordered series.

Every known value is a knot, and a cubic leads from each knot to the next.  Its
coefficients come from the knot's neighbours, so knots are cut into overlapping
chunks: two neighbours on each side for ``pchip`` and ``akima``.  The slopes of
the spline solve one tridiagonal system over all knots; a row of it weighs its
own unknown twice as much as both others, so what lies ``SPLINE_REACH`` knots away
is halved that many times, and a chunk with such a halo gives the whole system's slopes
to the last digits of a double.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .chunks import each_chunk, overlapping

KNOTS_PER_CHUNK = 100_000
SPLINE_REACH = 80


def _edge_slope(h0, h1, m0, m1):
    """Slope at the end of a shape-preserving curve, from the two steps next to it."""
    d = ((2 * h0 + h1) * m0 - h0 * m1) / (h0 + h1)
    if np.sign(d) != np.sign(m0):
        return 0.0
    return 3 * m0 if np.sign(m0) != np.sign(m1) and abs(d) > 3 * abs(m0) else d


def pchip(x, y):
    """Slopes of the shape-preserving curve: weighted harmonic means of the steps, 0 where they turn."""
    h, m = np.diff(x), np.diff(y) / np.diff(x)
    if len(x) == 2:
        return np.repeat(m, 2)
    d = np.zeros(len(x))
    a, b = 2 * h[1:] + h[:-1], h[1:] + 2 * h[:-1]
    same = m[:-1] * m[1:] > 0
    with np.errstate(divide="ignore", invalid="ignore"):
        d[1:-1] = np.where(same, (a + b) / (a / m[:-1] + b / m[1:]), 0.0)
    d[0], d[-1] = _edge_slope(h[0], h[1], m[0], m[1]), _edge_slope(h[-1], h[-2], m[-1], m[-2])
    return d


def akima(x, y):
    """Slopes weighted by how much the steps on the other side change."""
    m = np.diff(y) / np.diff(x)
    if len(x) == 2:
        return np.repeat(m, 2)
    s = np.concatenate([[3 * m[0] - 2 * m[1], 2 * m[0] - m[1]], m, [2 * m[-1] - m[-2], 3 * m[-1] - 2 * m[-2]]])
    turn = np.abs(np.diff(s))
    left, right = turn[2:], turn[:-2]
    # the scale of flat places is their chunk's own knots': exact zeros decide
    flat = left + right == 0
    return np.where(flat, (s[1:-2] + s[2:-1]) / 2, (left * s[1:-2] + right * s[2:-1]) / np.where(flat, 1.0, left + right))


def spline(x, y):
    """Slopes of the curve with two continuous derivatives, its first two and last two cubics the same."""
    n, h, m = len(x), np.diff(x), np.diff(y) / np.diff(x)
    if n == 2:
        return np.repeat(m, 2)
    if n == 3:  # one parabola
        bend = (m[1] - m[0]) / (x[2] - x[0])
        return np.array([m[0] - bend * h[0], m[0] + bend * h[0], m[1] + bend * h[1]])
    low, mid, up, right = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
    low[1:-1], mid[1:-1], up[1:-1] = h[1:], 2 * (h[:-1] + h[1:]), h[:-1]
    right[1:-1] = 3 * (h[1:] * m[:-1] + h[:-1] * m[1:])
    d = x[2] - x[0]
    mid[0], up[0], right[0] = h[1], d, ((h[0] + 2 * d) * h[1] * m[0] + h[0] ** 2 * m[1]) / d
    d = x[-1] - x[-3]
    mid[-1], low[-1], right[-1] = h[-2], d, (h[-1] ** 2 * m[-2] + (2 * d + h[-1]) * h[-2] * m[-1]) / d
    mid, right = mid.tolist(), right.tolist()
    low, up = low.tolist(), up.tolist()
    for i in range(1, n):
        f = low[i] / mid[i - 1]
        mid[i] -= f * up[i - 1]
        right[i] -= f * right[i - 1]
    out = [0.0] * n
    out[-1] = right[-1] / mid[-1]
    for i in range(n - 2, -1, -1):
        out[i] = (right[i] - up[i] * out[i + 1]) / mid[i]
    return np.array(out)


#: name -> (slopes, knots that they depend on to each side, whether the last cubic goes on after the last knot)
CURVES = {
    "pchip": (pchip, 2, True), "akima": (akima, 3, False),
    "cubic": (spline, SPLINE_REACH, False), "cubicspline": (spline, SPLINE_REACH, True),
}


def curve(knots: DataFrame, keys: list[str], method: str, knots_per_chunk: int = KNOTS_PER_CHUNK) -> DataFrame:
    """Keys, ``_knot``, and ``_x _a _b _c _d`` of the cubic from each knot on: a + b t + c t^2 + d t^3 at x + t.

    ``knots`` has the keys, ``_knot`` (from 1 without gaps), ``_x`` (growing with it) and
    ``_y``.  The last knot's cubic is the one before it, carried on, or null.
    A series of one knot has none.
    """
    slopes, reach, goes_on = CURVES[method]
    # the last knot's cubic needs one knot more, which is right itself
    halo = reach + 1
    chunks = overlapping(knots, keys, F.col("_knot") - 1, max(knots_per_chunk, halo), halo, ["_knot", "_x", "_y"])
    names = ["_a", "_b", "_c", "_d"]
    kind = T.StructType(chunks.schema.fields + [T.StructField(c, T.DoubleType()) for c in names])

    def fit(batches):
        def work(table: pa.Table):
            x, y = table["_x"].to_numpy().astype(float), table["_y"].to_numpy().astype(float)
            parts = np.full((4, len(x)), np.nan)
            if len(x) > 1:
                s, h = slopes(x, y), np.diff(x)
                bend = (s[:-1] + s[1:] - 2 * np.diff(y) / h) / h
                c, d = (np.diff(y) / h - s[:-1]) / h - bend, bend / h
                parts[:, :-1] = y[:-1], s[:-1], c, d
                if goes_on:
                    t = h[-1]
                    parts[:, -1] = y[-1], s[-1], c[-1] + 3 * d[-1] * t, d[-1]
            for name, values in zip(names, parts):
                table = table.append_column(name, pa.array(values, mask=np.isnan(values)))
            return table

        return each_chunk(batches, work)

    return chunks.mapInArrow(fit, kind).where("_own").select(*keys, "_knot", "_x", *names)


def at(x: Column) -> Column:
    """The value at x of the cubic in ``_x _a _b _c _d``."""
    t = x - F.col("_x")
    return F.col("_a") + t * (F.col("_b") + t * (F.col("_c") + t * F.col("_d")))

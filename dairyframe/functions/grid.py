"""Grid days of lactations over an Arrow batch: yields along a standard curve, nearest known grid days, areas."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F

from dairyframe.functions.daily import flat, lists

#: Keys of lactation and day: a day is far smaller than this.
SPAN = 1 << 33


def _values(day: np.ndarray, first: np.ndarray, no_first: np.ndarray, lengths: np.ndarray, curve: np.ndarray, grid: np.ndarray):
    """Yield per (lactation, grid day), which are missing, and which grid days were measured.

    Days are distinct and ascend within a lactation, so one search over all of them finds the days around each grid day.
    """
    n, ends = len(lengths), np.cumsum(lengths)
    days = day.astype(np.int64)
    key = np.repeat(np.arange(n), lengths) * SPAN + days
    target = (np.arange(n) * SPAN)[:, None] + grid
    at = np.searchsorted(key, target.ravel()).reshape(target.shape)
    starts = (ends - lengths)[:, None]
    if not len(key):
        return np.zeros(target.shape), np.ones(target.shape, bool), np.zeros(target.shape, bool)
    last = len(key) - 1
    exact = (at < ends[:, None]) & (key[np.minimum(at, last)] == target)
    before, after = at - 1, at + exact
    inside = (before >= starts) & (after < ends[:, None])
    e, b, a = np.minimum(at, last), np.maximum(before, 0), np.minimum(after, last)
    inside &= days[a] < len(curve) - 1
    expected = [np.where((d >= 0) & (d < len(curve)), d, 0) for d in (days[b], days[a])]
    g1, g2, gi = curve[expected[0]], curve[expected[1]], curve[grid]
    with np.errstate(all="ignore"):
        slope = ((first[a] - first[b]) - (g2 - g1)) / (days[a] - days[b])
        between = gi + (slope * (grid - days[b]) + (first[b] - g1))
    missing = np.where(exact, no_first[e], ~inside | no_first[a] | no_first[b] | (days[b] < 0))
    return np.where(exact, first[e], between), missing, exact


def standard_values(days: Column, curve: Sequence[float], grid: Sequence[int]) -> Column:
    """Yields on the grid days along the standard curve, null where there is none; ``days`` ARRAY<STRUCT<day, first, last>> ascends."""
    line, points = np.asarray(curve, dtype=float), np.asarray(grid, dtype=np.int64)

    @F.arrow_udf("array<double>")
    def run(day: pa.Array, first: pa.Array, size: pa.Array) -> pa.Array:
        (d, _, lengths), (y, no_y, _) = flat(day), flat(first)
        values, missing, _ = _values(d, y, no_y, lengths, line, points)
        return lists(values.ravel(), missing.ravel(), np.full(len(day), len(points)))

    return run(days["day"], days["first"].cast("array<double>"), F.size(days))


def _nearest(known: np.ndarray, grid: np.ndarray) -> np.ndarray:
    """Per lactation and grid day the place of the nearest known grid day, the lower day on ties."""
    order = np.lexsort((np.broadcast_to(grid, (len(grid), len(grid))), np.abs(grid[:, None] - grid[None])), axis=-1)
    return order[np.arange(len(grid)), np.argmax(known[:, order], axis=2)]


def nearest_known(values: Column, grid: Sequence[int]) -> Column:
    """For each grid day without a value the nearest one that has a value, else null; ``values`` holds one entry per grid day."""
    points = np.asarray(grid, dtype=np.int64)

    @F.arrow_udf("array<int>")
    def run(x: pa.Array) -> pa.Array:
        _, null, _ = flat(x)
        known = ~null.reshape(len(x), len(points))
        nearest = points[_nearest(known, points)].astype(np.int32)
        return lists(nearest.ravel(), (known | ~known.any(axis=1)[:, None]).ravel(), np.full(len(x), len(points)))

    return run(values)


def filled_area(days: Column, curve: Sequence[float], grid: Sequence[int], factor: Sequence[Sequence[float]]) -> Column:
    """Trapezoids over the measured days (last record of a day) and the grid days; null without any known grid day.

    A grid day that was not measured has its value along the curve, else the expected one plus ``factor`` times the deviation of the nearest known day.
    """
    line, points, weights = np.asarray(curve, dtype=float), np.asarray(grid, dtype=np.int64), np.asarray(factor, dtype=float)

    @F.arrow_udf("double")
    def run(day: pa.Array, first: pa.Array, last: pa.Array, size: pa.Array) -> pa.Array:
        (d, _, lengths), (y, no_y, _), (z, no_z, _) = flat(day), flat(first), flat(last)
        n = len(day)
        values, missing, exact = _values(d, y, no_y, lengths, line, points)
        near = _nearest(~missing, points)
        rows = np.arange(n)[:, None]
        predicted = line[points] + weights[near, np.arange(len(points))] * (values[rows, near] - line[points[near]])
        at, added = np.nonzero(~exact)
        row = np.concatenate([np.repeat(np.arange(n), lengths), at])
        t = np.concatenate([d.astype(np.int64), points[added]])
        v = np.concatenate([z, np.where(missing, predicted, values)[at, added]])
        null = np.concatenate([no_z, np.zeros(len(at), bool)])
        order = np.argsort(row * SPAN + t)
        row, t, v, null = row[order], t[order], v[order], null[order]
        step = (row[1:] == row[:-1]) & ~null[1:] & ~null[:-1]
        with np.errstate(all="ignore"):
            area = np.where(step, (t[1:] - t[:-1]) * (v[:-1] + v[1:]) / 2, 0.0)
        return pa.array(np.bincount(row[1:], area, n), mask=missing.all(axis=1))

    return run(days["day"], days["first"].cast("array<double>"), days["last"].cast("array<double>"), F.size(days))

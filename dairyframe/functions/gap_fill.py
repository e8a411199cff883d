"""Gap filling of daily sequences over an Arrow batch.

Carrying values along an array has no cheap column form: growing an array step by step copies it every
time. One numpy pass over the flat values of a batch finds each day's previous and next value.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F, types as T

#: Sequences filled at a time, so that what is worked on stays near the processor.
ROWS = 256
METHODS = ("forward_fill", "backward_fill", "linear", "zero", "mean")


def _neighbours(values: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """Index of the nearest value at or before and at or after each day of its row; -1 for none."""
    index = np.arange(len(values))
    seen = ~np.isnan(values)
    before = np.maximum.accumulate(np.where(seen, index, -1))
    after = np.minimum.accumulate(np.where(seen, index, len(values))[::-1])[::-1]
    return np.where(before >= starts, before, -1), np.where(after < ends, after, -1)


def fill(values: np.ndarray, lengths: np.ndarray, methods: np.ndarray, edges: bool) -> np.ndarray:
    """Filled flat values; NaN marks a day that stays missing.

    ``edges`` is the display form: leading or trailing gaps take the nearest value and a row without
    values becomes zeros.
    """
    if not len(values):
        return values
    values = np.where(np.isfinite(values), values, np.nan)
    first = np.cumsum(lengths) - lengths
    starts, ends = np.repeat(first, lengths), np.repeat(first + lengths, lengths)
    names, code = np.unique(methods.astype(str), return_inverse=True)
    method = np.repeat(code, lengths)
    before, after = _neighbours(values, starts, ends)
    previous = np.where(before >= 0, values[before], np.nan)
    following = np.where(after >= 0, values[after], np.nan)
    nearest = np.where(before >= 0, previous, following)
    with np.errstate(divide="ignore", invalid="ignore"):
        share = (np.arange(len(values)) - before) / (after - before)
        sloped = previous + (following - previous) * share
    sloped = np.where((before >= 0) & (after >= 0) & (before != after), sloped, nearest)
    rows = np.repeat(np.arange(len(lengths)), lengths)
    count = np.bincount(rows, ~np.isnan(values), len(lengths))
    with np.errstate(divide="ignore", invalid="ignore"):
        mean = (np.bincount(rows, np.nan_to_num(values), len(lengths)) / count)[rows]
    if edges:
        previous, following = nearest, np.where(after >= 0, following, previous)
    out = np.select(
        [method == (list(names).index(m) if m in names else -1) for m in METHODS],
        [previous, following, sloped, np.nan_to_num(values), np.where(np.isnan(values), mean, values)],
    )
    return np.nan_to_num(out) if edges else out


def fill_lists(x: pa.Array, methods: np.ndarray, *, edges: bool = False, zeros: bool = False) -> pa.Array:
    """Filled sequences of an Arrow array by the method of each; a null sequence stays null."""
    lengths = np.asarray(x.value_lengths().fill_null(0), dtype=np.int64)
    values = np.asarray(x.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False), dtype=float)
    ends = np.cumsum(lengths)
    runs = [(i, min(i + ROWS, len(lengths))) for i in range(0, len(lengths), ROWS)]
    parts = [fill(values[ends[i] - lengths[i] : ends[j - 1]], lengths[i:j], methods[i:j], edges) for i, j in runs]
    out = np.concatenate([values[:0], *parts])
    if zeros:
        out = np.where(np.isfinite(out), out, 0.0)
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    missing = x.is_null() if x.null_count else None
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(out, mask=np.isnan(out)), mask=missing)


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def _fill(x: pa.Array, size: pa.Array, method: pa.Array, edges: pa.Array, zeros: pa.Array) -> pa.Array:
    shown, zero = (len(f) > 0 and bool(f[0].as_py()) for f in (edges, zeros))
    return fill_lists(x, np.asarray(method.to_pylist(), dtype=object), edges=shown, zeros=zero)


def fill_gaps(x: Column, method: Column, *, edges: bool = False, zeros: bool = False) -> Column:
    """Fill a sequence by the method named in ``method``; ``zeros`` reads what stays missing as 0."""
    # The second use of ``x`` also keeps the optimizer from folding this call into the result list of an
    # aggregate that computes ``x``, where a Python function cannot run.
    return _fill(x, F.size(x), method, F.lit(edges), F.lit(zeros))

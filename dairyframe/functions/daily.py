"""Daily arrays over an Arrow batch: curves laid out by day, sparse records spread over days, sums over days.

Spark walks a lambda over an array element by element without generated code. One numpy pass over the flat values of a batch does
the same arithmetic in the same order, so sums have the same value to the last bit.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from dairyframe.functions import curves

#: Curves laid out at a time: their matrices stay small.
RUN = 512


def flat(x: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values (NaN for null), whether each is null, and the length of each list (0 for a null list)."""
    lengths = np.asarray(x.value_lengths().fill_null(0), dtype=np.int64)
    values = x.flatten()
    null = np.asarray(values.is_null()) if values.null_count else np.zeros(len(values), bool)
    return np.asarray(values.cast(pa.float64()).to_numpy(zero_copy_only=False), dtype=float), null, lengths


def lists(values: np.ndarray, null: np.ndarray, lengths: np.ndarray, missing: np.ndarray | None = None) -> pa.Array:
    """Lists of the flat ``values``; rows marked in ``missing`` become null."""
    offsets = pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32))
    mask = None if missing is None or not missing.any() else pa.array(missing)
    return pa.ListArray.from_arrays(offsets, pa.array(values, mask=null if null.any() else None), mask=mask)


def _fields(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in kinds.items()])


def _struct(null_rows: np.ndarray, **fields: tuple[np.ndarray, np.ndarray | bool]) -> pa.Array:
    """A struct array; each field is (values, null), and a null list has null fields."""
    columns = [pa.array(v, mask=null_rows | null) for v, null in fields.values()]
    return pa.StructArray.from_arrays(columns, names=list(fields))


def _laid_out(model: pa.Array, parameters: Sequence[pa.Array], days: np.ndarray, usable: np.ndarray, models: Sequence[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of usable rows of one model: the rows, their yields on days 1 to the longest horizon among them, and which are null.

    Rows of like horizons are in one run.
    """
    names = model.dictionary_encode()
    code = np.asarray(names.indices.fill_null(-1))
    columns = {n: np.asarray(x.to_numpy(zero_copy_only=False), dtype=float) for n, x in zip("abcdk", parameters)}
    nulls = {n: np.asarray(x.is_null()) for n, x in zip("abcdk", parameters)}
    for i, name in enumerate(names.dictionary.to_pylist()):
        rows = np.flatnonzero(usable & (code == i)) if name in models else np.zeros(0, int)
        rows = rows[np.argsort(days[rows], kind="stable")]
        for first in range(0, len(rows), RUN):
            part = rows[first : first + RUN]
            t = np.arange(1.0, days[part].max() + 1)[None, :]
            yield part, *curves.curve_values(name, t, {n: x[part][:, None] for n, x in columns.items()}, {n: x[part] for n, x in nulls.items()})


def _usable(model: pa.Array, horizon: pa.Array, models: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """The rows that have a curve, and the last day of each row."""
    return np.asarray(pc.is_in(model, pa.array(models, model.type))) & np.asarray(horizon.is_valid()), np.asarray(horizon.fill_null(0), dtype=np.int64)


def _daily_curves(models: Sequence[str]):
    @F.arrow_udf("array<double>")
    def run(model: pa.Array, a: pa.Array, b: pa.Array, c: pa.Array, d: pa.Array, k: pa.Array, horizon: pa.Array) -> pa.Array:
        usable, days = _usable(model, horizon, models)
        lengths = np.where(usable, days, 0)
        starts = np.cumsum(lengths) - lengths
        out, empty = np.empty(int(lengths.sum())), np.zeros(int(lengths.sum()), bool)
        for rows, values, null in _laid_out(model, (a, b, c, d, k), days, usable, models):
            each = np.arange(values.shape[1])
            inside = each < days[rows][:, None]
            at = (starts[rows][:, None] + each)[inside]
            out[at], empty[at] = values[inside], null[inside]
        return lists(out, empty, lengths, ~usable)

    return run


def daily_curve(model: Column, parameters: Sequence[Column], horizon: Column, models: Sequence[str]) -> Column:
    """Yields of days 1..horizon of the row's model; null for a model not among ``models``."""
    return _daily_curves(list(models))(model, *[p.cast("double") for p in parameters], horizon.cast("int"))


WALKED = _fields(_top=T.DoubleType(), _day=T.IntegerType(), _trapezoid=T.DoubleType(), _last=T.DoubleType(), _gamma=T.DoubleType())


def walk_curves(rows: DataFrame, models: Sequence[str]) -> DataFrame:
    """Adds what the daily curve of each row (model, a, b, c, d, k, _horizon, _end) shows, without handing out the curve.

    ``_top`` is the highest yield of days 1.._horizon and ``_day`` its first day, ``_trapezoid`` the area from day 1 to ``_end`` and ``_last`` the
    yield of that day. Days without a value are passed over by the first two and leave the area null. ``_gamma`` is the incomplete
    gamma function in the integral of a wood curve up to ``_end``.
    """

    def run(batches):
        for batch in batches:
            columns = dict(zip(batch.schema.names, batch.columns))
            usable, days = _usable(columns["model"], columns["_horizon"], models)
            end, no_end = np.asarray(columns["_end"].fill_null(1), dtype=np.int64), np.asarray(columns["_end"].is_null())
            if (end[usable] < 1).any():
                raise ValueError("the last day has to be 1 or later")
            found = {name: (np.zeros(len(usable)), np.ones(len(usable), bool)) for name in WALKED.names}
            for at, values, null in _laid_out(columns["model"], [columns[p] for p in curves.PARAMETERS], days, usable, models):
                each, line, last = np.arange(values.shape[1]), np.arange(len(at)), end[at] - 1
                gone, none = no_end[at], np.zeros(len(at), bool)
                # NaN counts as the largest value
                if null.any() or days[at].min() < len(each):
                    held = ~null & (each < days[at][:, None])
                    none = ~held.any(axis=1)
                    day = np.argmax(np.where(held, values, -np.inf), axis=1)
                    day = np.where(held[line, day], day, np.argmax(held, axis=1))
                else:
                    day = np.argmax(values, axis=1)
                with np.errstate(all="ignore"):
                    if null.any() or (last != last[0]).any():
                        until = each < end[at][:, None]
                        gone = gone | (null & until).any(axis=1)
                        area = np.where(until, values, 0.0).sum(axis=1)
                    else:
                        area = values[:, : last[0] + 1].sum(axis=1)
                    area -= (values[:, 0] + values[line, last]) / 2
                results = (values[line, day], none), (day + 1, none), (area, gone), (values[line, last], null[line, last] | no_end[at])
                for name, (value, missing) in zip(WALKED.names, results):
                    found[name][0][at], found[name][1][at] = value, missing
            at = np.flatnonzero(np.asarray(pc.fill_null(pc.equal(columns["model"], "wood"), False)) & usable & ~no_end)
            b, c = (columns[p].take(pa.array(at)) for p in "bc")
            value, without = curves.lower_gammas(np.asarray(b.fill_null(np.nan)) + 1, np.asarray(c.fill_null(np.nan)) * end[at])
            found["_gamma"][0][at], found["_gamma"][1][at] = value, without | np.asarray(b.is_null()) | np.asarray(c.is_null())
            added = [pa.array(v.astype(np.int32) if n == "_day" else v, mask=m) for n, (v, m) in found.items()]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*batch.schema.names, *found])

    schema = T.StructType([*rows.schema.fields, *WALKED.fields])
    return rows.mapInArrow(run, schema)


def _spread(length: int, gap: float | None):
    @F.arrow_udf("array<double>")
    def run(dim: pa.Array, milk: pa.Array, size: pa.Array) -> pa.Array:
        day, no_day, lengths = flat(dim)
        value, no_value, widths = flat(milk)
        row = np.repeat(np.arange(len(dim)), lengths)
        # days and values are paired from the end
        from_end = np.cumsum(lengths)[row] - 1 - np.arange(len(day))
        paired = from_end < widths[row]
        source = np.where(paired, np.cumsum(widths)[row] - 1 - from_end, 0)
        with np.errstate(invalid="ignore"):
            inside = ~no_day & (day >= 1) & (day <= length) & (day == np.floor(day))
        at = row[inside] * length + day[inside].astype(np.int64) - 1
        out = np.full(len(dim) * length, 0.0 if gap is None else gap)
        null = np.full(len(out), gap is None)
        found = paired[inside]
        values, nothing = np.zeros(len(at)), np.ones(len(at), bool)
        values[found], nothing[found] = value[source[inside][found]], no_value[source[inside][found]]
        # the last of a repeated day stays
        out[at], null[at] = values, nothing
        return lists(out, null, np.full(len(dim), length, dtype=np.int64))

    return run


def spread_days(dim: Column, milk: Column, length: int, *, missing: float | None) -> Column:
    """Sparse (dim, milk) to an array of days 1..length; days outside are dropped, the last of a day wins, empty days are ``missing``."""
    # The second use of ``dim`` keeps the optimizer from folding this call into an aggregate that computes it (see gap_fill).
    return _spread(length, missing)(dim.cast("array<double>"), milk.cast("array<double>"), F.size(dim))


@F.arrow_udf(_fields(seen=T.LongType(), positive=T.LongType(), total=T.DoubleType(), weighted=T.DoubleType()))
def _tally(x: pa.Array, size: pa.Array) -> pa.Array:
    values, null, lengths = flat(x)
    n = len(x)
    row = np.repeat(np.arange(n), lengths)
    day = np.arange(len(values)) - (np.cumsum(lengths) - lengths)[row] + 1
    held = np.where(null, 0.0, values)
    above = ~null & ((values > 0) | np.isnan(values))
    counts = [np.bincount(row[m], minlength=n) for m in (~null, above)]
    sums = [np.bincount(row, v, n) for v in (held, day * held)]
    return _struct(np.asarray(x.is_null()), seen=(counts[0], False), positive=(counts[1], False), total=(sums[0], False), weighted=(sums[1], False))


def tally(x: Column) -> Column:
    """STRUCT<seen, positive, total, weighted> of a daily array: values, values above 0, their sum, and the sum of day times value."""
    return _tally(x, F.size(x))


def sums(x: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The sum of each list over its values, and whether a value is null; not the sum of a null list."""
    values, null, lengths = flat(x)
    row = np.repeat(np.arange(len(x)), lengths)
    return np.bincount(row, np.where(null, 0.0, values), len(x)), np.bincount(row[null], minlength=len(x)) > 0


@F.arrow_udf(_fields(**dict.fromkeys(("mean", "std", "top", "low", "total", "plain"), T.DoubleType())))
def _summary(x: pa.Array, size: pa.Array) -> pa.Array:
    values, null, lengths = flat(x)
    n = len(x)
    row = np.repeat(np.arange(n), lengths)
    total, gaps = sums(x)
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        mean = total / lengths
        off = np.where(null, 0.0, values - mean[row])
        std = np.sqrt(np.bincount(row, off * off, n) / lengths)
    some = np.flatnonzero(np.bincount(row[~null], minlength=n) > 0)
    top, low, held = np.zeros(n), np.zeros(n), np.zeros(n, bool)
    if len(some):
        starts = (np.cumsum(lengths) - lengths)[some]
        # NaN counts as the largest value
        top[some] = np.maximum.reduceat(np.where(null, -np.inf, values), starts)
        low[some] = np.fmin.reduceat(values, starts)
        held[some] = True
    unknown = gaps | (lengths == 0)
    return _struct(
        np.asarray(x.is_null()), mean=(mean, unknown), std=(std, unknown), top=(top, ~held), low=(low, ~held), total=(total, False), plain=(total, gaps)
    )


def summary(x: Column) -> Column:
    """STRUCT<mean, std, top, low, total, plain> of an array: as ``arrays.moments``, array_max, array_min and ``arrays.total`` give
    them; ``plain`` is the sum, null where a value is null."""
    return _summary(x, F.size(x))


@F.arrow_udf(_fields(top=T.DoubleType(), mean=T.DoubleType()))
def _gap(a: pa.Array, b: pa.Array, size: pa.Array) -> pa.Array:
    (x, no_x, m), (y, no_y, n) = flat(a), flat(b)
    both = np.minimum(m, n)
    row = np.repeat(np.arange(len(a)), both)
    step = np.arange(len(row)) - (np.cumsum(both) - both)[row]
    i, j = (np.cumsum(m) - m)[row] + step, (np.cumsum(n) - n)[row] + step
    null = no_x[i] | no_y[j]
    with np.errstate(invalid="ignore"):
        gap = np.where(null, 0.0, np.abs(x[i] - y[j]))
    gaps = np.bincount(row[null], minlength=len(a)) > 0
    held = np.bincount(row[~null], minlength=len(a)) > 0
    top = np.zeros(len(a))
    if (both > 0).any():
        top[both > 0] = np.maximum.reduceat(gap, (np.cumsum(both) - both)[both > 0])
    with np.errstate(divide="ignore", invalid="ignore"):
        mean = np.bincount(row, gap, len(a)) / both
    return _struct(np.asarray(a.is_null()) | np.asarray(b.is_null()), top=(top, ~held), mean=(mean, gaps | (both == 0)))


def gap(a: Column, b: Column) -> Column:
    """STRUCT<top, mean> of the absolute differences of two arrays over the places that both have."""
    return _gap(a, b, F.size(a))

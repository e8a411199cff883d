"""Sequence transforms as array expressions: narrow maps over one row, no shuffle.

Sequences are daily arrays of a bounded horizon (304 days). Nulls, NaN and infinities are all missing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from dairyframe.functions.daily import spread_days
from dairyframe.functions.gap_fill import METHODS, fill_gaps
from dairyframe.functions.text import finite, let

HORIZON = 304
MILK_SCALE = 80.0


def clean(x: Column) -> Column:
    return F.transform(x, lambda v: finite(v.cast("double")))


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda acc, v: acc + F.coalesce(v, F.lit(0.0)))


def observed(x: Column) -> Column:
    return F.filter(x, lambda v: v.isNotNull())


def forward_fill(x: Column, *, fill_edges: bool = False) -> Column:
    """Carry the last value forward. Leading nulls stay, unless ``fill_edges``: then they take the
    first value and a sequence without values becomes zeros."""
    return fill_gaps(x, F.lit("forward_fill"), edges=fill_edges)


def backward_fill(x: Column, *, fill_edges: bool = False) -> Column:
    """Carry the next value back; the mirror of :func:`forward_fill`."""
    return fill_gaps(x, F.lit("backward_fill"), edges=fill_edges)


def linear(x: Column, *, zero_when_empty: bool = False) -> Column:
    """Linear between neighbours and flat at both ends.

    A sequence without values stays missing, or becomes zeros with ``zero_when_empty``.
    """
    return fill_gaps(x, F.lit("linear"), edges=zero_when_empty)


def fill_zero(x: Column) -> Column:
    return F.transform(clean(x), lambda v: F.coalesce(v, F.lit(0.0)))


def fill_mean(x: Column) -> Column:
    """Nulls take the mean of the sequence's own values; none stay missing."""
    seen = observed(clean(x))
    mean = F.try_divide(total(seen), F.size(seen))
    return let(mean, lambda m: F.transform(clean(x), lambda v: F.coalesce(v, m)))


def impute(x: Column, method: str) -> Column:
    rules = {
        "forward_fill": forward_fill,
        "backward_fill": backward_fill,
        "linear": linear,
        "zero": fill_zero,
        "mean": fill_mean,
    }
    if method not in rules:
        raise ValueError(f"imputation method must be one of {', '.join(METHODS)}")
    return rules[method](x)


def imputation(method: Column, default: str) -> Column:
    """The imputation named per row, with a default for rows that name none; unknown names fail the job."""
    chosen = F.coalesce(method, F.lit(default))
    return F.when(chosen.isin(*METHODS), chosen).otherwise(
        F.raise_error(F.concat(F.lit("unknown imputation method "), chosen))
    )


def impute_by(x: Column, method: Column, default: str, *, zeros: bool = False) -> Column:
    """Imputation named per row, as :func:`imputation` gives it.

    ``zeros`` reads gaps that the imputation leaves open as 0.
    """
    return fill_gaps(x, imputation(method, default), zeros=zeros)


def pad_truncate(x: Column, length: int, pad: Column, *, mode: str = "post") -> Column:
    """To a fixed length; padding after or before, truncation keeps the head."""
    if mode not in ("post", "pre"):
        raise ValueError("mode must be 'post' or 'pre'")
    padding = F.array_repeat(pad, F.greatest(F.lit(length) - F.size(x), F.lit(0)))
    head = F.slice(x, 1, length)
    return F.concat(head, padding) if mode == "post" else F.concat(padding, head)


def moments(x: Column) -> Column:
    """STRUCT<mean, std> with the population std, from two passes over the array."""
    n = F.size(x)
    mean = F.try_divide(F.aggregate(x, F.lit(0.0), lambda acc, v: acc + v), n)

    def with_std(m: Column) -> Column:
        squares = F.aggregate(x, F.lit(0.0), lambda acc, v: acc + (v - m) * (v - m))
        return F.struct(m.alias("mean"), F.sqrt(F.try_divide(squares, n)).alias("std"))

    return let(mean, with_std)


def _range(x: Column) -> Column:
    return F.struct(F.array_min(x).alias("lo"), F.array_max(x).alias("hi"))


def zscore(x: Column) -> Column:
    """(x - mean) / population std; a constant sequence gives x - mean."""
    return let(
        moments(x),
        lambda s: F.transform(
            x, lambda v: F.when(s["std"] == 0, v - s["mean"]).otherwise((v - s["mean"]) / s["std"])
        ),
    )


def minmax(x: Column) -> Column:
    """(x - min) / (max - min); a constant sequence gives zeros."""
    return let(
        _range(x),
        lambda r: F.transform(
            x, lambda v: F.when(r["hi"] == r["lo"], F.lit(0.0)).otherwise((v - r["lo"]) / (r["hi"] - r["lo"]))
        ),
    )


def maxabs(x: Column) -> Column:
    """x / max(abs(x)); an all-zero sequence is unchanged."""
    top = F.array_max(F.transform(x, F.abs))
    return let(top, lambda t: F.transform(x, lambda v: F.when(t == 0, v).otherwise(v / t)))


def scale(x: Column, by: float) -> Column:
    return F.transform(x, lambda v: v / F.lit(float(by)))


def milk_scale(x: Column, top: float = MILK_SCALE) -> Column:
    """Missing to 0, then divided by the largest plausible yield."""
    return F.transform(fill_zero(x), lambda v: v / F.lit(float(top)))


def milk_unscale(x: Column, top: float = MILK_SCALE) -> Column:
    return F.transform(x, lambda v: v * F.lit(float(top)))


def actual_milk(x: Column, top: float = MILK_SCALE) -> Column:
    """Actuals back to kg, only where they are still scaled (no value above 1)."""
    return F.when(F.array_max(x) <= 1.0, milk_unscale(x, top)).otherwise(x)


def stats_zscore(x: Column, epsilon: float = 1e-6) -> Column:
    """Herd statistics of one record to z-scores; nulls 0; nearly constant gives x - mean."""

    def scaled(filled: Column) -> Column:
        return let(
            moments(filled),
            lambda s: F.transform(
                filled,
                lambda v: F.when(s["std"] > epsilon, (v - s["mean"]) / (s["std"] + epsilon)).otherwise(v - s["mean"]),
            ),
        )

    return let(fill_zero(x), scaled)


def stats_minmax(x: Column, epsilon: float = 1e-6) -> Column:
    """Herd statistics of one record to 0..1; nulls 0; a nearly constant record is unchanged."""

    def scaled(filled: Column) -> Column:
        return let(
            _range(filled),
            lambda r: F.transform(
                filled,
                lambda v: F.when(
                    r["hi"] - r["lo"] > epsilon, (v - r["lo"]) / (r["hi"] - r["lo"] + epsilon)
                ).otherwise(v),
            ),
        )

    return let(fill_zero(x), scaled)


def default_events(events: Column, length: int = HORIZON) -> Column:
    """Missing events become one calving and padding."""
    return F.coalesce(events, F.concat(F.array(F.lit("calving")), F.array_repeat(F.lit("pad"), length - 1)))


def windows(x: Column, size: int, stride: int = 1, *, first_only: bool = False) -> Column:
    """Array of windows STRUCT<start, values>; none for a shorter sequence.

    ``first_only`` keeps the first window, and leaves a shorter sequence whole.
    """
    if first_only:
        return F.array(F.struct(F.lit(1).alias("start"), F.slice(x, 1, size).alias("values")))
    enough = F.size(x) >= size
    # the sequence is only read when there is room for a window
    starts = F.when(enough, F.sequence(F.lit(1), F.greatest(F.size(x) - size + 1, F.lit(1)), F.lit(stride)))
    made = F.transform(starts, lambda i: F.struct(i.alias("start"), F.slice(x, i, size).alias("values")))
    return F.coalesce(made, F.array().cast("array<struct<start:int,values:array<double>>>"))


def project_daily(dim: Column, milk: Column, length: int = HORIZON, *, missing: float | None = 0.0) -> Column:
    """Sparse (dim, milk) to a daily array; days outside 1..length dropped, the last of a day wins.

    Empty days are 0 for a model input, or null (``missing=None``) when they are to be imputed.
    """
    return spread_days(dim, milk, length, missing=missing)


def horizon_reject(dim: Column, milk: Column, length: int = HORIZON) -> Column:
    """Why a periodic record cannot be projected; null when it can."""
    usable = F.filter(dim, lambda d: (d >= 1) & (d <= length))
    valid = F.forall(milk, lambda v: v.isNotNull() & ~F.isnan(v) & (v < float("inf")) & (v >= 0))
    return (
        F.when(F.size(dim) != F.size(milk), "length_mismatch")
        .when(~valid, "invalid_milk")
        .when(F.size(usable) == 0, "no_day_in_horizon")
        .when(F.size(F.array_distinct(usable)) < F.size(usable), "duplicate_day")
    )


def in_horizon(dim: Column, milk: Column, length: int = HORIZON) -> Column:
    """Pairs STRUCT<dim, milk> inside the horizon."""
    pairs = F.zip_with(dim, milk, lambda d, m: F.struct(d.alias("dim"), m.alias("milk")))
    return F.filter(pairs, lambda p: (p["dim"] >= 1) & (p["dim"] <= length))


def observed_days(x: Column, length: int = HORIZON) -> Column:
    """Daily array to its observed STRUCT<dim, milk>."""
    pairs = F.transform(F.slice(clean(x), 1, length), lambda v, i: F.struct((i + 1).alias("dim"), v.alias("milk")))
    return F.filter(pairs, lambda p: p["milk"].isNotNull())


def missing_days(x: Column, length: int = HORIZON) -> Column:
    """Missing entries among the first ``length`` of a daily array."""
    return F.size(F.filter(F.slice(clean(x), 1, length), lambda v: v.isNull()))


def missing_days_periodic(dim: Column, length: int = HORIZON) -> Column:
    """Days of the horizon without a record."""
    return F.lit(length) - F.size(F.array_distinct(F.filter(dim, lambda d: (d >= 1) & (d <= length))))

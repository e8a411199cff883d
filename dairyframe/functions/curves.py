"""Lactation-curve models as column expressions, with their closed-form peaks and integrals.

Parameters travel in five nullable DOUBLE columns ``a, b, c, d, k``; ``t`` is days in milk.
The Wilmink form used everywhere is the fitted one, ``a + b*t + c*exp(k*t)``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, functions as F

WILMINK_K = -0.05
HORIZON = 305
PARAMETERS = ("a", "b", "c", "d", "k")


@dataclass(frozen=True)
class Params:
    """The five parameter columns of one curve."""

    a: Column
    b: Column
    c: Column
    d: Column
    k: Column

    @classmethod
    def of(cls, prefix: str = "") -> "Params":
        return cls(*[F.col(f"{prefix}{name}") for name in PARAMETERS])


def _over(top: Column, bottom: Column) -> Column:
    """Division that gives null, not an error, on a zero parameter."""
    return F.try_divide(top, bottom)


class ColumnMath:
    """The functions the models need, on Spark columns."""

    exp, pow, ln = staticmethod(F.exp), staticmethod(F.pow), staticmethod(F.ln)

    @staticmethod
    def over(top: Column | float, bottom: Column) -> Column:
        return _over(top if isinstance(top, Column) else F.lit(top), bottom)


class ArrayMath:
    """The same functions on numpy matrices; ``null`` marks the cells that a division by zero or a logarithm leaves without a value."""

    exp, pow = staticmethod(np.exp), staticmethod(np.power)

    def __init__(self, shape: tuple[int, int]) -> None:
        self.null = np.zeros(shape, bool)

    def over(self, top, bottom):
        zero = np.asarray(bottom) == 0
        self.null |= zero
        return top / np.where(zero, 1.0, bottom)

    def ln(self, x):
        self.null |= np.asarray(x) <= 0
        return np.log(x)


def _milkbot(t, p, m=ColumnMath):
    return p.a * (1 - m.exp(m.over(p.c - t, p.b)) / 2) * m.exp(-p.d * t)


def _wood(t, p, m=ColumnMath):
    return p.a * m.pow(t, p.b) * m.exp(-p.c * t)


def _wilmink(t, p, m=ColumnMath):
    return p.a + p.b * t + p.c * m.exp(p.k * t)


def _ali_schaeffer(t, p, m=ColumnMath):
    share = t / float(HORIZON)
    gap = m.ln(m.over(float(HORIZON), t))
    return p.a + p.b * share + p.c * share * share + p.d * gap + p.k * gap * gap


def _fischer(t, p, m=ColumnMath):
    return p.a - p.b * t - p.a * m.exp(-p.c * t)


def _brody(t, p, m=ColumnMath):
    return p.a * m.exp(-p.k * t)


def _sikka(t, p, m=ColumnMath):
    return p.a * m.exp(p.b * t - p.c * t * t)


def _nelder(t, p, m=ColumnMath):
    return m.over(t, p.a + p.b * t + p.c * t * t)


def _dhanoa(t, p, m=ColumnMath):
    return p.a * m.pow(t, p.b * p.c) * m.exp(-p.c * t)


def _emmans(t, p, m=ColumnMath):
    return p.a * m.exp(-m.exp(p.d - p.b * t)) * m.exp(-p.c * t)


def _hayashi(t, p, m=ColumnMath):
    return p.b * (m.exp(m.over(-t, p.c)) - m.exp(m.over(-t, p.a * p.c)))


def _rook(t, p, m=ColumnMath):
    return p.a * m.over(1.0, 1 + m.over(p.b, p.c + t)) * m.exp(-p.d * t)


def _dijkstra(t, p, m=ColumnMath):
    return p.a * m.exp(m.over(p.b * (1 - m.exp(-p.c * t)), p.c) - p.d * t)


def _prasad(t, p, m=ColumnMath):
    return p.a + p.b * t + p.c * t * t + m.over(p.d, t)


MODELS: dict[str, Callable] = {
    "milkbot": _milkbot,
    "wood": _wood,
    "wilmink": _wilmink,
    "ali_schaeffer": _ali_schaeffer,
    "fischer": _fischer,
    "brody": _brody,
    "sikka": _sikka,
    "nelder": _nelder,
    "dhanoa": _dhanoa,
    "emmans": _emmans,
    "hayashi": _hayashi,
    "rook": _rook,
    "dijkstra": _dijkstra,
    "prasad": _prasad,
}


def curve(model: str, t: Column, params: Params | None = None) -> Column:
    """Daily yield of ``model`` at day ``t``."""
    if model not in MODELS:
        raise ValueError(f"unknown curve model {model!r}; known: {', '.join(MODELS)}")
    return MODELS[model](t.cast("double"), params or Params.of())


#: The parameters each model uses; a null one of them leaves the row without yields.
USED = {
    "wilmink": "abck", "ali_schaeffer": "abcdk", "brody": "ak",
    **dict.fromkeys(("milkbot", "emmans", "rook", "dijkstra", "prasad"), "abcd"),
    **dict.fromkeys(("wood", "fischer", "sikka", "nelder", "dhanoa", "hayashi"), "abc"),
}


def curve_values(model: str, t: np.ndarray, params: dict[str, np.ndarray], null: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Yields of many rows of one model as a matrix (row, day), and which cells are null: the numpy twin of :func:`curve`.

    ``t`` is one row of days, ``params`` columns, ``null`` marks rows without a parameter.
    """
    shape = (len(params["a"]), t.shape[1])
    math = ArrayMath(shape)
    with np.errstate(all="ignore"):
        values = MODELS[model](t, Params(**params), math)
    for name in USED[model]:
        if null[name].any():
            math.null |= null[name][:, None]
    return np.broadcast_to(values, shape), math.null


def brody_two_term(t: Column, a: Column, b: Column, k1: Column, k2: Column) -> Column:
    """The two-exponential Brody form ``a*exp(-k1*t) - b*exp(-k2*t)``."""
    return a * F.exp(-k1 * t) - b * F.exp(-k2 * t)


def curve_by_name(
    model: Column, t: Column, params: Params | None = None, models: Sequence[str] | None = None
) -> Column:
    """Like :func:`curve` for a table that mixes ``models`` (default all); unknown names give null."""
    picked = None
    for name in models or MODELS:
        value = curve(name, t, params)
        picked = F.when(model == name, value) if picked is None else picked.when(model == name, value)
    return picked


def peak_day_closed(model: str, params: Params | None = None) -> Column:
    """Day of the peak where a formula exists, else null."""
    p = params or Params.of()
    if model == "wood":
        return _over(p.b, p.c)
    if model == "milkbot":
        return p.c - p.b * F.ln(_over(2 * p.b * p.d, 1 + p.b * p.d))
    if model == "fischer":
        return _over(F.ln(_over(p.a * p.c, p.b)), p.c)
    if model == "wilmink":
        return _over(F.ln(_over(-p.b, p.c * p.k)), p.k)
    return F.lit(None).cast("double")


def lower_gammas(s: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower incomplete gamma by its power series, all terms positive for x >= 0, and which have none since a divisor is 0.

    Terms shrink once their index passes x, so the count follows x.
    """
    with np.errstate(all="ignore"):
        terms = np.fmax(30, np.ceil(x + 12 * np.sqrt(x) + 30))
        none = s == 0
        term = 1 / s
        total, i = term.copy(), 0
        while i < terms.max(initial=0):
            i += 1
            below = s + i
            none |= (below == 0) & (i <= terms)
            term *= x
            term /= below
            total += term if i <= 30 else np.where(i <= terms, term, 0.0)
            # a sum that has become infinite stays so
            if i % 32 == 0 and not (np.isfinite(total) & (i < terms)).any():
                break
        return np.power(x, s) * np.exp(-x) * total, none


def integral_closed(model: str, length: Column, params: Params | None = None, *, gamma: Column) -> Column:
    """Integral of the curve over days 0..length where a formula exists, else null.

    ``gamma`` holds the lower incomplete gamma function of b + 1 and c * length, which a wood curve needs (:func:`lower_gammas`).
    """
    p = params or Params.of()
    T = length.cast("double")
    if model == "wood":
        return p.a * F.pow(p.c, -(p.b + 1)) * gamma
    if model == "wilmink":
        return p.a * T + p.b * T * T / 2 + _over(p.c, p.k) * (F.exp(p.k * T) - 1)
    if model == "fischer":
        return p.a * T - p.b * T * T / 2 - _over(p.a, p.c) * (1 - F.exp(-p.c * T))
    if model == "milkbot":
        fast = p.d + _over(F.lit(1.0), p.b)
        return p.a * (
            _over(1 - F.exp(-p.d * T), p.d)
            - F.exp(_over(p.c, p.b)) / 2 * _over(1 - F.exp(-fast * T), fast)
        )
    if model == "ali_schaeffer":
        h = float(HORIZON)
        gap = F.ln(F.lit(h) / T)
        return (
            p.a * T
            + p.b * T * T / (2 * h)
            + p.c * T * T * T / (3 * h * h)
            + p.d * T * (gap + 1)
            + p.k * T * (gap * gap + 2 * gap + 2)
        )
    return F.lit(None).cast("double")


def persistency_wood(b: Column, c: Column) -> Column:
    return -(b + 1) * F.ln(c)


def persistency_milkbot(d: Column) -> Column:
    return _over(F.lit(0.693), d)

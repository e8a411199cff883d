"""Bounded least squares of one curve per lactation, vectorised over an Arrow batch.

The models are linear in some parameters. Those are solved exactly inside their bounds for every
candidate of the others, which start on a coarse grid and follow damped Gauss-Newton steps.
Repeated days enter as one day with a weight and a mean, which leaves the optimum unchanged.
Every step is fixed arithmetic, so SQL can repeat a fit (``plans.fit_sql``).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

import numpy as np

COARSE = 13
ROUNDS = 60
NUDGE = 1e-5
DAMPING = np.array([1e-6, 1e-1, 10.0])
LENGTHS = np.array([1.0, 0.3, 0.05, 0.005])
ENOUGH = 1e-9
#: Residual sums below this share of the squared yields count as none: the curve passes by every record.
EXACT = 1e-13
#: A parameter that moves the curve by less than this share (squared) is held: its slope would be rounding noise.
FLAT = 1e-10
#: How near to its bound a parameter that presses against it is held.
EDGE = 1e-6
#: Decimals of steps of the search parameters (in logarithms) and of residual sums (shares of the squared yields) that decide.
PLACES, DECIDES = 7, 12
#: Cells (record, candidate) worked on at a time, so that what is worked on stays near the processor.
CELLS = 60_000
#: Records of a run of lactations, or of one whose records lie on more than DISTINCT days, each of which takes a row of the grid.
RECORDS, DISTINCT = 64_000, 4_000
#: So few lactations of one width go on with those of the next.
FEW = 150


@dataclass
class Days:
    """Flat records of a run of lactations: ``row`` maps each record to its lactation."""

    t: np.ndarray
    w: np.ndarray
    y: np.ndarray
    starts: np.ndarray
    row: np.ndarray

    def total(self, per_record: np.ndarray) -> np.ndarray:
        return np.add.reduceat(per_record, self.starts, axis=0)


@dataclass(frozen=True)
class Bounds:
    """Search ranges of the nonlinear parameters and limits of the linear ones."""

    search: tuple[tuple[float, float], ...]
    linear: tuple[tuple[float, float], ...]


def _total(per_record: np.ndarray) -> np.ndarray:
    """Sums over the first axis, the records of a lactation, to the last bit as ``Days.total`` adds up to 129 of them."""
    if len(per_record) == 1:
        return per_record[0]
    rest = len(per_record) - 1
    if rest < 8:
        return per_record[0] + per_record[1:].sum(axis=0)
    last = 1 + rest // 8 * 8
    eight = per_record[1:last].reshape(-1, 8, *per_record.shape[1:]).sum(axis=0)
    four = eight[::2] + eight[1::2]
    two = four[::2] + four[1::2]
    total = two[0] + two[1]
    for more in per_record[last:]:
        total += more
    total += per_record[0]
    return total


def _clip_ratio(top: np.ndarray, bottom: np.ndarray, lo, hi) -> np.ndarray:
    ratio = top / bottom
    none = ~(bottom > 0)
    if none.any():
        np.copyto(ratio, lo, where=none)
    np.maximum(ratio, lo, out=ratio)
    return np.minimum(ratio, hi, out=ratio)


class Grid:
    """The curve on the distinct days of a run for candidates that all lactations share.

    A coarse grid is the same for every lactation, so its exponentials are taken once per day, not once per record.
    """

    def __init__(self, t: np.ndarray, shape: Callable, theta: np.ndarray) -> None:
        self.days = np.unique(t)
        u, v = shape(self.days[:, None], theta[None])
        self.squares, self.plain = ([u * u], [u]) if v is None else ([u * u, u * v, v * v], [u, v])

    def sums(self, t: np.ndarray, w: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        """The sums of (record, lactation) arrays as (lactation, candidate) arrays."""
        place = np.searchsorted(self.days, t)

        def total(values: np.ndarray, weight: np.ndarray) -> np.ndarray:
            held = np.take(values, place, axis=0)
            held *= weight[..., None]
            return _total(held)

        return [*(total(x, w) for x in self.squares), *(total(x, w * y) for x in self.plain)]


def _sums(u: np.ndarray, v: np.ndarray | None, w: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    """Sums of products of the curve (record, candidate, lactation) with itself and with the yields."""
    w, y = w[:, None], y[:, None]
    held = w * u
    if v is None:
        return [_total(held * u), _total(w * y * u)]
    uu = _total(held * u)
    uv = _total(held * v)
    held *= y
    uy = _total(held)
    held = w * v
    vv = _total(held * v)
    held *= y
    return [uu, uv, vv, uy, _total(held)]


def _smallest(sums: Sequence[np.ndarray], yy: np.ndarray, candidates: Callable, pair: bool):
    """Smallest residual sum over the candidate (p, q) pairs built from the normal equations; with ``pair`` that p and q too."""
    uu, uv, vv, uy, vy = sums
    best = np.full(uu.shape, np.inf)
    chosen = (np.zeros(uu.shape), np.zeros(uu.shape)) if pair else None
    for p, q, valid in candidates(*sums):
        sse = p * uy
        sse += q * vy
        sse *= 2
        np.subtract(yy, sse, out=sse)
        held = (p * p) * uu
        sse += held
        np.multiply(2 * p, q, out=held)
        held *= uv
        sse += held
        np.multiply(q * q, vv, out=held)
        sse += held
        if valid is not True:
            sse = np.where(valid, sse, np.inf)
        if pair:
            better = sse < best
            chosen = tuple(np.where(better, found, kept) for kept, found in zip(chosen, (p, q)))
        # a sum that is no number is passed over
        np.fmin(best, sse, out=best)
    return best, chosen


def _free(uu, uv, vv, uy, vy):
    det = uu * vv
    det -= uv * uv
    p = uy * vv
    p -= vy * uv
    p /= det
    q = uu * vy
    q -= uv * uy
    q /= det
    return p, q


def _wood_shape(t: np.ndarray, theta: np.ndarray):
    return np.exp(theta[..., 0] * np.log(t) - theta[..., 1] * t), None


def _fischer_shape(t: np.ndarray, theta: np.ndarray):
    return 1 - np.exp(-theta[..., 0] * t), -t


def _milkbot_shape(t: np.ndarray, theta: np.ndarray):
    u = np.exp(-theta[..., 1] * t)
    return u, -np.exp(-t / theta[..., 0]) * u


def wood(theta: np.ndarray, sums: Sequence[np.ndarray], yy: np.ndarray, bounds: Bounds, scale: np.ndarray | None = None, *, pair: bool = True):
    """Residual sums of candidates ``theta`` from their sums, with ``pair`` their linear parameters too; ``scale`` is that of :func:`fit_flagged`."""
    gg, gy = sums
    a = _clip_ratio(gy, gg, *bounds.linear[0])
    return yy - 2 * a * gy + a * a * gg, (a,)


def fischer(theta: np.ndarray, sums: Sequence[np.ndarray], yy: np.ndarray, bounds: Bounds, scale: np.ndarray | None = None, *, pair: bool = True):
    (alo, ahi), (blo, bhi) = bounds.linear

    def candidates(uu, uv, vv, uy, vy):
        p, q = _free(uu, uv, vv, uy, vy)
        yield p, q, (p >= alo) & (p <= ahi) & (q >= blo) & (q <= bhi)
        for edge in (alo, ahi):
            yield edge, _clip_ratio(vy - edge * uv, vv, blo, bhi), True
        for edge in (blo, bhi):
            yield _clip_ratio(uy - edge * uv, uu, alo, ahi), edge, True

    return _smallest(sums, yy, candidates, pair)


def milkbot(theta: np.ndarray, sums: Sequence[np.ndarray], yy: np.ndarray, bounds: Bounds, scale: np.ndarray | None = None, *, pair: bool = True):
    """a*exp(-d*t) - q*exp(-t/b - d*t) with q = a*exp(c/b)/2; the bounds on c make q/a a range."""
    b = theta[..., 0]
    (alo, ahi), (clo, chi) = bounds.linear
    if scale is not None:
        alo, ahi = alo * scale, ahi * scale
    rlo, rhi = np.exp(clo / b) / 2, np.exp(np.minimum(chi / b, 600.0)) / 2

    def candidates(uu, uv, vv, uy, vy):
        p, q = _free(uu, uv, vv, uy, vy)
        yield p, q, (p >= alo) & (p <= ahi) & (q >= p * rlo) & (q <= p * rhi)
        for edge in (alo, ahi):
            yield edge, _clip_ratio(vy - edge * uv, vv, edge * rlo, edge * rhi), True
        for r in (rlo, rhi):
            left = r * vy
            left += uy
            both = (2 * r) * uv
            both += uu
            both += (r * r) * vv
            p = _clip_ratio(left, both, alo, ahi)
            yield p, p * r, True

    return _smallest(sums, yy, candidates, pair)


def _plain_parameters(theta: np.ndarray, linear: np.ndarray, bounds: Bounds) -> list[np.ndarray]:
    return [*linear, *theta]


def _milkbot_parameters(theta: np.ndarray, linear: np.ndarray, bounds: Bounds) -> list[np.ndarray]:
    (b, d), (p, q) = theta, linear
    return [p, b, np.clip(b * np.log(2 * q / p), *bounds.linear[1]), d]


#: The curves of each fit on the coarse grid and along the steps, and its parameters from the search parameters and the linear ones.
SHAPES = {wood: _wood_shape, fischer: _fischer_shape, milkbot: _milkbot_shape}
CURVES = dict(SHAPES)
ORDERED = {wood: _plain_parameters, fischer: _plain_parameters, milkbot: _milkbot_parameters}


def _axis_grid(size: int, dims: int) -> np.ndarray:
    """All points of a size**dims grid over [-1, 1]**dims."""
    steps = np.linspace(-1.0, 1.0, size)
    return np.stack([g.ravel() for g in np.meshgrid(*[steps] * dims, indexing="ij")], axis=-1)


def _least(sse: np.ndarray, size: np.ndarray, axis: int) -> np.ndarray:
    """The first candidate with the least residual sum; sums that differ by rounding only are equal."""
    share = sse / np.expand_dims(np.where(size > 0, size, 1.0), axis)
    np.fmin(share, np.inf, out=share)
    return np.argmin(np.round(share, DECIDES, out=share), axis=axis)


def _residual(days: "Walk", u: np.ndarray, v: np.ndarray | None, linear: np.ndarray) -> np.ndarray:
    """Weighted residuals of curves (record, candidate, lactation) with their linear parameters."""
    gap = days.y[:, None] - linear[0] * u
    if v is not None:
        gap -= linear[1] * v
    gap *= np.sqrt(days.w)[:, None]
    return gap


def _left(days: "Walk", u: np.ndarray, v: np.ndarray | None, linear: Sequence[np.ndarray], sse: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weighted residuals and their sum of squares; infinite where no pair of linear parameters counts."""
    residual = _residual(days, u, v, linear)
    left = _total(residual * residual)
    return residual, left if v is None else np.where(np.isfinite(sse), left, np.inf)


@dataclass
class Walk:
    """Lactations with equally many records that take their steps together; the last axis of every array is the lactation.

    ``t``, ``w``, ``y`` and ``residual`` begin with the record, ``at`` (the search parameters in logarithms) and ``linear`` with the
    parameter. A lactation with fewer records than others has its last day repeated with the weight 0, which adds nothing to any sum.
    """

    t: np.ndarray
    w: np.ndarray
    y: np.ndarray
    residual: np.ndarray
    at: np.ndarray
    linear: np.ndarray
    best: np.ndarray
    size: np.ndarray
    scale: np.ndarray
    rounds: np.ndarray
    who: np.ndarray

    def __len__(self) -> int:
        return len(self.who)

    def take(self, which: np.ndarray | slice) -> "Walk":
        return Walk(**{name: x[..., which] for name, x in vars(self).items()})

    def widened(self, width: int) -> "Walk":
        more = width - len(self.t)
        if not more:
            return self
        padded = {name: np.concatenate([x, np.zeros((more, len(self)))]) for name, x in vars(self).items() if name in ("w", "y", "residual")}
        return replace(self, t=np.concatenate([self.t, np.repeat(self.t[-1:], more, axis=0)]), **padded)

    @staticmethod
    def joined(parts: Sequence["Walk"]) -> "Walk":
        if len(parts) == 1:
            return parts[0]
        return Walk(**{name: np.concatenate([getattr(x, name) for x in parts], axis=-1) for name in vars(parts[0])})


class Search:
    """Best parameters of the lactations of a run.

    The nonlinear parameters start at the best point of a coarse grid over their ranges (in log
    coordinates) and then take damped Gauss-Newton steps, several dampings and step lengths tried at
    once, until no step improves. A parameter that presses against its bound is held there. A lactation that still
    improves after ROUNDS steps is flagged as not converged. What is found for one lactation does not depend on the others.
    """

    def __init__(self, solve: Callable, bounds: Bounds, scaled: bool, n: int) -> None:
        self.solve, self.bounds, self.scaled = solve, bounds, scaled
        self.lo = np.log([b[0] for b in bounds.search])
        self.hi = np.log([b[1] for b in bounds.search])
        self.dims = len(self.lo)
        self.at, self.linear = np.zeros((self.dims, n)), np.zeros((2 if len(bounds.linear) == 2 else 1, n))
        self.best, self.converged = np.zeros(n), np.ones(n, bool)

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Parameters, residual sum and convergence of every lactation."""
        return np.stack(ORDERED[self.solve](np.exp(self.at), self.linear, self.bounds), axis=-1), self.best, self.converged

    def _solved(self, days: Walk, at: np.ndarray, *, pair: bool):
        """Residual sums and linear parameters of candidates (parameter, candidate, lactation), their curves and sums."""
        theta = np.exp(at).transpose(1, 2, 0)
        u, v = CURVES[self.solve](days.t[:, None], theta)
        sums = _sums(u, v, days.w, days.y)
        return *self.solve(theta, sums, days.size, self.bounds, days.scale if self.scaled else None, pair=pair), u, v, sums

    def start(self, grid: Grid, points: np.ndarray, t: np.ndarray, w: np.ndarray, y: np.ndarray, scale: np.ndarray, who: np.ndarray) -> Walk:
        """Lactations (record, lactation) at their best point of the grid.

        Candidates are compared by their normal equations; residuals are taken for the best one only.
        """
        size, theta = _total(w * y * y), np.exp(points)
        at, step = np.empty((self.dims, len(who))), max(1, CELLS // (len(points) * len(t)))
        for first in range(0, len(who), step):
            part = slice(first, first + step)
            sums = grid.sums(t[:, part], w[:, part], y[:, part])
            sse, _ = self.solve(theta, sums, size[part, None], self.bounds, scale[part, None] if self.scaled else None, pair=False)
            at[:, part] = points[_least(sse, size[part], 1)].T
        walk = Walk(t, w, y, residual=t, at=at, linear=at, best=size, size=size, scale=scale, rounds=np.zeros(len(who), int), who=who)
        sse, linear, u, v, _ = self._solved(walk, at[:, None], pair=True)
        residual, best = _left(walk, u, v, linear, sse)
        return replace(walk, residual=residual[:, 0], linear=np.concatenate(linear), best=best[0])

    def go(self, walk: Walk, few: int) -> Walk:
        """Steps until at most ``few`` lactations go on; these are returned."""
        while len(walk) > few:
            step = max(1, CELLS // (len(DAMPING) * len(LENGTHS) * len(walk.t)))
            walk = Walk.joined([self._step(walk.take(slice(first, first + step))) for first in range(0, len(walk), step)])
        return walk

    def _step(self, walk: Walk) -> Walk:
        """One step of every lactation; those that go on are returned, the others are done."""
        lo, hi, n, dims = self.lo[:, None], self.hi[:, None], len(walk), self.dims
        here, base = walk.at, walk.residual[:, None]
        nudge = np.where(here + NUDGE > hi, -1.0, 1.0) * NUDGE
        probes = np.repeat(here[:, None], dims, axis=1)
        probes[range(dims), range(dims)] += nudge
        _, linear, u, v, _ = self._solved(walk, probes, pair=True)
        slope = _residual(walk, u, v, linear)
        slope -= base
        slope /= nudge
        gradient = _total(slope * base)
        curvature = np.stack([_total(slope * slope[:, i : i + 1]) for i in range(dims)])
        held = ((here <= lo + EDGE) & (gradient > 0)) | ((here >= hi - EDGE) & (gradient < 0))
        held |= np.einsum("ppn->pn", curvature) <= FLAT * walk.size
        gradient = np.where(held, 0.0, gradient)
        curvature = np.where(held[:, None] | held[None], 0.0, curvature)
        step = self._direction(gradient, curvature)
        np.copyto(step, 0.0, where=np.isnan(step))
        step = np.minimum(np.maximum(step, -1.0), 1.0)[:, :, None] * LENGTHS[:, None]
        tried = here[:, None] + np.round(step.reshape(dims, -1, n), PLACES)
        tried = np.minimum(np.maximum(tried, lo[:, None]), hi[:, None])
        sse, _, u, v, sums = self._solved(walk, tried, pair=False)
        # the linear parameters and the residuals are worked out for the best candidate only
        pick, each = _least(sse, walk.size, 0), np.arange(n)
        there, u, v = tried[:, pick, each], u[:, pick, each][:, None], v if v is None or v.shape[1] == 1 else v[:, pick, each][:, None]
        sums = [x[pick if len(x) > 1 else 0, each][None] for x in sums]
        sse, linear = self.solve(np.exp(there).T[None], sums, walk.size, self.bounds, walk.scale if self.scaled else None)
        residual, left = _left(walk, u, v, linear, sse)
        residual, left, linear = residual[:, 0], left[0], np.concatenate(linear)
        gain = walk.best - left
        less = gain > EXACT * walk.size
        best, at, linear = np.where(less, left, walk.best), np.where(less, there, here), np.where(less, linear, walk.linear)
        more = gain > ENOUGH * best + EXACT * walk.size
        rounds = walk.rounds + 1
        done = ~more | (rounds >= ROUNDS)
        who = walk.who[done]
        self.at[:, who], self.linear[:, who], self.best[who], self.converged[who] = at[:, done], linear[:, done], best[done], ~more[done]
        return replace(walk, at=at, linear=linear, best=best, residual=residual, rounds=rounds).take(~done)

    def _direction(self, gradient: np.ndarray, curvature: np.ndarray) -> np.ndarray:
        """Steps (parameter, damping, lactation) of the damped normal equations."""
        diagonal = np.einsum("ppn->pn", curvature)
        scale = diagonal + 1e-12 * diagonal.max(axis=0) + 1e-300
        damped = curvature.transpose(2, 0, 1)[:, None] + DAMPING[:, None, None] * (scale.T[:, None, :, None] * np.eye(self.dims))
        right = np.broadcast_to(gradient.T[:, None, :, None], (*damped.shape[:3], 1))
        return -np.linalg.solve(damped, right)[..., 0].transpose(2, 1, 0)


def _widths(longest: int) -> np.ndarray:
    """Numbers of records that lactations are padded to: each up to 8, then steps of two, four, eight and a quarter."""
    widths = [*range(1, 9), 10, 12, 14, 16, 20, 24, 28, 32]
    while widths[-1] < longest:
        widths.append(widths[-1] + (8 if widths[-1] < 128 else widths[-1] // 4))
    return np.array(widths)


def _alike(width: int, wider: int) -> bool:
    """Whether sums over the records of lactations stay the same to the last bit when these are padded to ``wider``."""
    return (wider - 1) // 8 == (width - 1) // 8 if width <= 128 else wider <= 2 * width


def search(solve: Callable, days: Days, bounds: Bounds, scale: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best parameters, residual sum and convergence flag per lactation of a run.

    Lactations are laid out beside others with as many records, so that sums over records are sums of whole arrays.
    """
    n = len(days.starts)
    run = Search(solve, bounds, scale is not None, n)
    points = (run.lo + run.hi) / 2 + _axis_grid(COARSE, run.dims) * (run.hi - run.lo) / 2
    lengths = np.diff(np.append(days.starts, len(days.t)))
    widths = _widths(lengths.max())
    width = widths[np.searchsorted(widths, lengths)]
    scale = np.ones(n) if scale is None else scale
    walk = None
    with np.errstate(all="ignore"):
        grid = Grid(days.t, SHAPES[solve], np.exp(points))
        present = np.unique(width)
        for i, wide in enumerate(present):
            who = np.flatnonzero(width == wide)
            record = np.arange(wide)[:, None]
            real = record < lengths[who]
            at = days.starts[who] + np.minimum(record, lengths[who] - 1)
            new = run.start(grid, points, days.t[at], np.where(real, days.w[at], 0.0), np.where(real, days.y[at], 0.0), scale[who], who)
            walk = new if walk is None or not len(walk) else Walk.joined([walk.widened(wide), new])
            last = i + 1 == len(present) or not _alike(wide, present[i + 1])
            walk = run.go(walk, 0 if last else FEW)
        return run.found()


def fit_all(solve: Callable, offsets, t, w, y, bounds: Bounds, scale: np.ndarray | None = None):
    """Parameters and residual sums of :func:`fit_flagged`."""
    return fit_flagged(solve, offsets, t, w, y, bounds, scale)[:2]


def fit_flagged(solve: Callable, offsets, t, w, y, bounds: Bounds, scale: np.ndarray | None = None):
    """Fit every lactation of a batch, in runs small enough for the grid of their days: parameters, residual sums, convergence.

    ``offsets`` are list offsets into the flat day arrays; every lactation has at least one day.
    ``scale`` multiplies the limits of the first linear parameter per lactation.
    """
    offsets = np.asarray(offsets, dtype=np.int64)
    records = RECORDS if len(np.unique(t)) <= DISTINCT else DISTINCT
    found: list[tuple] = []
    first = 0
    while first < len(offsets) - 1:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + records, side="right")) - 1)
        span = slice(offsets[first], offsets[last])
        starts = offsets[first:last] - offsets[first]
        lengths = np.diff(offsets[first : last + 1])
        days = Days(t[span], w[span], y[span], starts, np.repeat(np.arange(last - first), lengths))
        found.append(search(solve, days, bounds, None if scale is None else scale[first:last]))
        first = last
    return tuple(np.concatenate(parts) for parts in zip(*found))


def fit_basis(basis: np.ndarray, days: Days) -> tuple[np.ndarray, np.ndarray]:
    """Weighted least squares on the columns of ``basis`` (record, column): coefficients and residual sum per lactation.

    Columns are made orthogonal one after the other, twice, which keeps nearly equal days accurate where normal equations lose
    half the digits. A column that is a combination of earlier ones (to 1e-10 of its length) gets the coefficient 0.
    """
    root = np.sqrt(days.w)
    k, n = basis.shape[1], len(days.starts)
    upper, units = np.zeros((n, k, k)), []
    for j in range(k):
        v = root * basis[:, j]
        length = np.sqrt(days.total(v * v))
        for _ in range(2):
            for i, q in enumerate(units):
                part = days.total(q * v)
                upper[:, i, j] += part
                v = v - part[days.row] * q
        rest = np.sqrt(days.total(v * v))
        free = rest > 1e-10 * length
        upper[:, j, j] = np.where(free, rest, 0.0)
        units.append(v / np.where(free, rest, np.inf)[days.row])
    z = root * days.y
    right = np.zeros((n, k))
    for j, q in enumerate(units):
        right[:, j] = days.total(q * z)
        z = z - right[:, j][days.row] * q
    beta = np.zeros((n, k))
    for j in range(k - 1, -1, -1):
        left = right[:, j] - (upper[:, j, j + 1 :] * beta[:, j + 1 :]).sum(axis=1)
        beta[:, j] = np.divide(left, upper[:, j, j], out=np.zeros(n), where=upper[:, j, j] > 0)
    return beta, days.total(z * z)

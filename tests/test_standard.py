"""Grid interpolation and standard-curve yields with neutral assets."""

import numpy as np
import pytest
from conftest import by_id

from dairyframe.operators import standard_curve as sc

CURVE = [40 - 20 * d / 305 for d in range(306)]
WIDE = sc.WIDE_GRID
IDENTITY = np.eye(len(WIDE)).tolist()


def neutral(grid=WIDE):
    return sc.Standard(CURVE, np.eye(len(grid)).tolist(), [1.0] * len(grid), grid)


def test_interpolation_follows_the_standard_curve(testdays):
    # a lactation that lies a constant 3 kg above the curve is interpolated onto itself
    rows = [(1, d, CURVE[d] + 3) for d in (5, 55, 210, 300)] + [(2, 20, 30.0), (2, 310, 20.0)]
    got = sc.interp_standard_curve(testdays(rows), CURVE).collect()
    one = {r["grid_day"]: r["milk_kg"] for r in got if r["test_id"] == 1}
    assert sorted(one) == [g for g in WIDE if 5 <= g <= 300]
    assert all(one[g] == pytest.approx(CURVE[g] + 3) for g in one)
    # day 310 is out, and nothing lies outside a single day
    assert not [r for r in got if r["test_id"] == 2]


def test_no_interpolation_up_to_day_305(testdays):
    got = sc.interp_standard_curve(testdays([(1, 20, 30.0), (1, 305, 20.0)]), CURVE).collect()
    assert {r["grid_day"]: r["milk_kg"] for r in got} == {305: 20.0}


def test_linear_forms(testdays):
    rows = [(1, 20, 30.0), (1, 60, 34.0), (1, 100, 30.0), (2, 40, 20.0)]
    inside = sc.interp_linear_range(testdays(rows)).collect()
    assert {r["grid_day"]: r["milk_kg"] for r in inside if r["test_id"] == 1} == {30: 31.0, 50: 33.0, 70: 33.0, 90: 31.0}
    every = {(r["test_id"], r["grid_day"]): r["milk_kg"] for r in sc.interp_linear_all(testdays(rows)).collect()}
    assert {g for i, g in every} == set(WIDE) and {i for i, g in every} == {1}
    assert every[(1, 0)] == pytest.approx(28.0) and every[(1, 305)] == pytest.approx(34 - 245 * 0.1)


def test_nearest_breaks_ties_downward(testdays):
    rows = [(1, 10, 30.0), (1, 50, 30.0)]
    got = by_id(sc.nearest_grid_days(testdays(rows), CURVE), "nearest_day", "grid_day")
    assert got[0] == 10 and got[70] == 50 and got[305] == 50 and 30 not in got


def brute_islc(days, standard):
    """Direct re-computation for one lactation with distinct days."""
    grid, curve = list(standard.grid), standard.curve
    dims = sorted(days)
    points = {}
    for g in grid:
        before, after = [d for d in dims if d < g], [d for d in dims if d > g]
        if g in days:
            points[g] = days[g]
        elif before and after and after[0] < 305:
            x1, x2 = before[-1], after[0]
            slope = ((days[x2] - days[x1]) - (curve[x2] - curve[x1])) / (x2 - x1)
            points[g] = curve[g] + slope * (g - x1) + days[x1] - curve[x1]
    if not points:
        return None
    line = {**points, **days}
    for g in grid:
        if g not in line:
            near = min(points, key=lambda p: (abs(p - g), p))
            i, q = grid.index(near), grid.index(g)
            b = standard.correlation[i][q] * standard.std[q] / standard.std[i] if standard.std[i] else 0.0
            line[g] = curve[g] + b * (points[near] - curve[near])
    order = sorted(line)
    return sum((q - p) * (line[p] + line[q]) / 2 for p, q in zip(order, order[1:]))


@pytest.mark.parametrize("assets", ["neutral", "random"])
def test_islc_against_brute_force(testdays, assets):
    rng = np.random.default_rng(3)
    standard = neutral()
    if assets == "random":
        corr = rng.uniform(-1, 1, (17, 17))
        std = rng.uniform(0, 5, 17)
        std[3] = 0.0
        standard = sc.Standard(CURVE, corr.tolist(), std.tolist())
    data = {i: {int(d): float(rng.uniform(5, 50)) for d in rng.choice(np.arange(0, 306), rng.integers(1, 9), replace=False)} for i in range(60)}
    rows = [(i, d, m) for i, days in data.items() for d, m in days.items()]
    got = by_id(sc.islc_yield(testdays(rows), standard), "yield_kg")
    for i, days in data.items():
        want = brute_islc(days, standard)
        assert got[i] == (pytest.approx(want, rel=1e-9) if want is not None else None)


def test_neutral_lactation_on_the_curve_gives_its_integral(testdays):
    rows = [(1, d, CURVE[d]) for d in range(10, 300, 20)]
    got = by_id(sc.islc_yield(testdays(rows), neutral()), "yield_kg")
    assert got[1] == pytest.approx(30 * 305)


def test_original_form(testdays):
    rows = [(1, g, CURVE[g] + 2) for g in sc.GRID_DAYS[:-1]] + [(2, g, CURVE[g] + 2) for g in sc.GRID_DAYS] + [(3, 5, 30.0)]
    got = by_id(sc.islc_original_yield(testdays(rows), neutral(sc.GRID_DAYS)), "yield_kg")
    weight = {g: 25 if g == 290 else 20 for g in sc.GRID_DAYS}
    full = sum((CURVE[g] + 2) * weight[g] for g in sc.GRID_DAYS)
    assert got[2] == pytest.approx(full)
    # day 290 is predicted from 270 with b = 0 under the identity correlation
    assert got[1] == pytest.approx(full - 2 * 25)
    assert got[3] is None


def test_own_standard_from_a_population(testdays):
    rng = np.random.default_rng(7)
    rows = []
    for i in range(40):
        level = rng.normal(0, 3)
        rows += [(i, d, CURVE[d] + level + rng.normal(0, 1)) for d in range(5, 300, 18)]
    frame = testdays(rows)
    parts = sc.standard_representation(frame, CURVE)
    standard = sc.collect_standard(parts)
    # the same numbers from a dense table of interpolated points
    points = sc.interp_standard_curve(frame, CURVE).toPandas().pivot(index="test_id", columns="grid_day", values="milk_kg")
    z = points.sub(points.mean(axis=1), axis=0).div(points.std(axis=1), axis=0)
    corr, std = z.corr(), z.std(ddof=0)
    for g in z.columns:
        assert standard.std[WIDE.index(g)] == pytest.approx(std[g], rel=1e-9)
        for h in z.columns:
            assert standard.correlation[WIDE.index(g)][WIDE.index(h)] == pytest.approx(corr.loc[g, h], rel=1e-8, abs=1e-8)
    assert len(standard.curve) == 306 and standard.curve[0] == standard.curve[1]
    assert by_id(sc.islc_yield(frame, standard), "yield_kg")[0] > 5000


def test_interpolation_is_pluggable(testdays):
    def linear(df, curve, *, grid, order):
        return sc.interp_linear_range(df, grid=grid, order=order)

    rows = [(i, d, 30.0 + i - d / 20) for i in range(5) for d in (15, 95, 205, 295)]
    std = sc.standard_representation(testdays(rows), CURVE, interpolation=linear).std
    assert std.count() == len([g for g in WIDE if 15 <= g <= 295])

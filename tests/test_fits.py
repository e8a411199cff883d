"""Bounded fits and covariance against known parameters and brute force."""

import numpy as np
import pytest
from conftest import by_id

from pyspark.sql import functions as F

from dairyframe.functions import bounded_fit as bf, curves
from dairyframe.operators import best_prediction as bp, characteristics as ch, fitting

DAYS = np.arange(1, 200)
TRUE = {
    "wood": ((24, 0.17, 0.0025), lambda t, a, b, c: a * t**b * np.exp(-c * t)),
    "wilmink": ((27, 0.08, 9), lambda t, a, b, c: a + b * t + c * np.exp(-0.05 * t)),
    "fischer": ((33, 0.02, 0.015), lambda t, a, b, c: a - b * t - a * np.exp(-c * t)),
    "milkbot": ((44, 26, 8, 0.004), lambda t, a, b, c, d: a * (1 - np.exp((c - t) / b) / 2) * np.exp(-d * t)),
    "ali_schaeffer": (
        (22, 6, -3, 1.2, 0.4),
        lambda t, a, b, c, d, k: a + b * t / 305 + c * (t / 305) ** 2 + d * np.log(305 / t) + k * np.log(305 / t) ** 2,
    ),
}


@pytest.mark.parametrize("model", [*TRUE, "milkbot_trf"])
def test_recovers_parameters(testdays, model):
    params, f = TRUE[model.replace("_trf", "")]
    rows = [(1, int(t), f(t, *params)) for t in DAYS] + [(2, 10, 30.0), (2, 20, 31.0)]
    got = {r["test_id"]: r for r in fitting.fit_curve(testdays(rows), model).collect()}
    for name, value in zip(curves.PARAMETERS, params):
        assert got[1][name] == pytest.approx(value, rel=1e-3), name
    assert got[1]["reason"] is None
    assert got[2]["a"] is None and got[2]["reason"] == "too_few_days"


def random_lactations(n, seed=1):
    rng = np.random.default_rng(seed)
    t = [np.sort(rng.choice(np.arange(1, 306), rng.integers(6, 11), replace=False)).astype(float) for _ in range(n)]
    shape = [20 * x**0.2 * np.exp(-0.004 * x) for x in t]
    return t, [s * rng.normal(1, 0.1, len(s)) for s in shape]


@pytest.mark.parametrize("model", ["wood", "fischer", "milkbot"])
def test_beats_dense_brute_force(model):
    """No point of a dense grid over all parameters in bounds may be clearly better than the fit."""
    t, y = random_lactations(12)
    bounds = fitting.BOUNDS[model]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in t])])
    params, sse = bf.fit_all(
        fitting.SOLVERS[model], offsets, np.concatenate(t), np.ones(offsets[-1]), np.concatenate(y), bounds
    )
    f = TRUE[model][1]
    rng = np.random.default_rng(2)
    for i, (days, milk) in enumerate(zip(t, y)):
        assert ((milk - f(days, *params[i])) ** 2).sum() == pytest.approx(sse[i], rel=1e-6)
        order = {"wood": ("l0", "s0", "s1"), "fischer": ("l0", "l1", "s0"), "milkbot": ("l0", "s0", "l1", "s1")}[model]
        draws = []
        for kind in order:
            lo, hi = (bounds.linear if kind[0] == "l" else bounds.search)[int(kind[1])]
            draws.append(np.exp(rng.uniform(np.log(lo), np.log(hi), 40000)) if kind[0] == "s" else rng.uniform(lo, hi, 40000))
        # half of the draws stay close to the fit, where a better point would be
        near = [np.clip(p * rng.normal(1, 0.02, 40000), *sorted((d.min(), d.max()))) for p, d in zip(params[i], draws)]
        for cand in (draws, near):
            with np.errstate(over="ignore", invalid="ignore"):
                values = ((milk[:, None] - f(days[:, None], *cand)) ** 2).sum(axis=0)
            assert sse[i] <= np.nanmin(values) * (1 + 1e-6)


def test_bounds_hold():
    t, y = random_lactations(20, seed=9)
    y = [v * 5 for v in y]  # far above what a <= 100 allows
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in t])])
    for model in ("wood", "fischer", "milkbot"):
        params, _ = bf.fit_all(
            fitting.SOLVERS[model], offsets, np.concatenate(t), np.ones(offsets[-1]), np.concatenate(y), fitting.BOUNDS[model]
        )
        assert params[:, 0].max() <= 100 + 1e-9 and np.isfinite(params).all()


def test_repeated_days_weigh_like_records(testdays):
    rows = [(1, 10, 20), (1, 10, 30), (1, 60, 35), (1, 120, 30), (1, 200, 25), (1, 200, 21), (1, 280, 18)]
    fit = fitting.fit_curve(testdays(rows), "wood")
    got = fit.collect()[0]
    t, y = (np.array([r[i] for r in rows], dtype=float) for i in (1, 2))
    params, sse = bf.fit_all(bf.wood, [0, len(t)], t, np.ones(len(t)), y, fitting.BOUNDS["wood"])
    assert [got[p] for p in "abc"] == pytest.approx(list(params[0]), rel=1e-4)
    assert by_id(fitting.fit_residuals(testdays(rows), fit), "sse")[1] == pytest.approx(sse[0], rel=1e-6)


def test_closed_forms_match_the_day_grid(spark):
    rows = []
    for i, (model, (params, _)) in enumerate(TRUE.items()):
        full = dict(zip(curves.PARAMETERS, params))
        if model == "wilmink":
            full.update(b=-0.03, c=-10.0, k=-0.05)
        rows.append((i, model, *[float(full[p]) if p in full else None for p in curves.PARAMETERS]))
    frame = spark.createDataFrame(rows, "id int, model string, a double, b double, c double, d double, k double")
    got = {r["model"]: r for r in ch.characteristics_from_params(frame).collect()}
    for _, model, a, b, c, d, k in rows:
        args = [v for v in (a, b, c, d, k) if v is not None]
        f = TRUE[model][1]
        args = args[:3] if model == "wilmink" else args
        fine = np.linspace(1e-6, 305, 400001)
        y = f(fine, *args)
        area = float(((y[1:] + y[:-1]) / 2 * np.diff(fine)).sum())
        assert got[model]["cumulative_milk_yield"] == pytest.approx(area, rel=2e-4)
        if model in ("wood", "milkbot", "fischer", "wilmink"):
            # a closed-form peak may lie beyond day 305
            fine = np.linspace(1e-6, 500, 400001)
            y = f(fine, *args)
            assert got[model]["time_to_peak"] == pytest.approx(fine[y.argmax()], abs=2e-2)
            assert got[model]["peak_yield"] == pytest.approx(y.max(), rel=1e-6)


def test_batch_keeps_ids_and_models(testdays):
    f = TRUE["wood"][1]
    rows = [(i, int(t), f(t, 20 + i, 0.2, 0.003)) for i in (1, 2) for t in range(5, 300, 20)]
    got = ch.characteristics_batch(testdays(rows), ["wood", "wilmink", "milkbot"]).collect()
    assert {(r["test_id"], r["model"]) for r in got} == {(i, m) for i in (1, 2) for m in ("wood", "wilmink", "milkbot")}
    wood = {r["test_id"]: r for r in got if r["model"] == "wood"}
    assert wood[2]["peak_yield"] / wood[1]["peak_yield"] == pytest.approx(22 / 21, rel=1e-4)
    assert wood[1]["time_to_peak"] == pytest.approx(0.2 / 0.003, rel=1e-3)


# --- best prediction -------------------------------------------------------------------------


def test_one_deviation_on_a_flat_curve(testdays):
    got = bp.best_prediction_yield(testdays([(1, 1, 11.0)]), [10.0] * 305, np.eye(305))
    assert by_id(got, "yield_kg") == {1: pytest.approx(3051.0)}


def test_all_days_observed_gives_their_sum(testdays):
    rng = np.random.default_rng(4)
    milk = rng.uniform(10, 50, 305)
    rows = [(1, d + 1, m) for d, m in enumerate(milk)] + [(1, 306, 99.0), (2, 310, 20.0)]
    got = by_id(bp.best_prediction_yield(testdays(rows), [30.0] * 305, bp.ar1_covariance(4, 25, 0.97)), "yield_kg")
    assert got[1] == pytest.approx(milk.sum())
    assert got[2] == pytest.approx(305 * 30)


def test_matches_a_dense_solve(testdays):
    rng = np.random.default_rng(6)
    curve = np.linspace(40, 20, 305)
    covariance = bp.ar1_covariance(3.0, 20.0, 0.96)
    rows = [(i, int(d), float(rng.uniform(5, 50))) for i in range(40) for d in rng.choice(np.arange(1, 320), rng.integers(1, 12))]
    got = by_id(bp.best_prediction_yield(testdays(rows), curve.tolist(), covariance), "yield_kg")
    for i in range(40):
        last = {d: m for j, d, m in rows if j == i and d <= 305}
        idx = np.array(sorted(last), dtype=int) - 1
        want = curve.sum()
        if len(idx):
            v = np.array([last[d + 1] for d in idx]) - curve[idx]
            want += (covariance[:, idx] @ np.linalg.solve(covariance[np.ix_(idx, idx)], v)).sum()
        assert got[i] == pytest.approx(want, rel=1e-9)


def test_lactation_without_a_usable_day_gets_the_standard(testdays):
    curve = np.linspace(40, 20, 305).tolist()
    got = by_id(bp.best_prediction_yield(testdays([(1, 310, 41.0), (1, 20, None), (2, 400, 3.0)]), curve, bp.ar1_covariance(4.0, 25.0, 0.98)), "yield_kg")
    assert got == {1: pytest.approx(sum(curve)), 2: pytest.approx(sum(curve))}


def test_covariance_fit_finds_the_likelihood_peak(testdays):
    rng = np.random.default_rng(8)
    b1, b2, rho = 4.0, 25.0, 0.95
    cov = bp.ar1_covariance(b1, b2, rho)
    rows, groups = [], []
    for i in range(400):
        idx = np.sort(rng.choice(305, 9, replace=False))
        v = np.linalg.cholesky(cov[np.ix_(idx, idx)]) @ rng.normal(size=9)
        groups.append((idx, v))
        rows += [(i, int(d) + 1, 30.0 + float(x)) for d, x in zip(idx, v)]
    fit = bp.fit_ar1_covariance(testdays(rows), [30.0] * 305)

    def loss(p1, p2, r):
        total = 0.0
        for idx, v in groups:
            s = p1 * np.eye(9) + p2 * r ** np.abs(idx[:, None] - idx[None, :])
            total += 0.5 * (np.linalg.slogdet(s)[1] + v @ np.linalg.solve(s, v) + 9 * np.log(2 * np.pi))
        return total

    best = loss(fit["b1"], fit["b2"], fit["rho"])
    assert best == pytest.approx(fit["neg_log_likelihood"], rel=1e-9)
    assert best <= loss(b1, b2, rho)
    for factor in (0.97, 1.03):
        assert best <= loss(fit["b1"] * factor, fit["b2"], fit["rho"]) + 0.02
        assert best <= loss(fit["b1"], fit["b2"] * factor, fit["rho"]) + 0.02
    assert fit["rho"] == pytest.approx(rho, abs=0.02) and fit["b2"] == pytest.approx(b2, rel=0.2)


def test_array_forms_equal_the_day_by_day_forms(spark, testdays):
    f = TRUE["wood"][1]
    rows = [(i, int(t), float(round(f(t, 20 + i, 0.2, 0.003) + (t * i) % 5))) for i in (1, 2, 3) for t in range(5, 330, 20)]
    params = fitting.fit_curve(testdays(rows), "wood")
    other = fitting.fit_curve(testdays(rows), "wilmink")
    actual = testdays(rows).select("test_id", F.col("dim").alias("day"), "milk_kg")
    plain = {r.test_id: (r.n, r.mae, r.rmse) for r in ch.residual_metrics(fitting.predict_curve(params), actual).collect()}
    for r in ch.residuals_at(params, actual).collect():
        assert (r.n, r.mae, r.rmse) == pytest.approx(plain[r.test_id], rel=1e-9)
    diff = {r.test_id: (r.max_diff, r.mean_diff) for r in ch.curve_diff(fitting.predict_curve(params), fitting.predict_curve(other)).collect()}
    got = {r.test_id: (r.max_diff, r.mean_diff) for r in ch.array_diff(ch.daily_arrays(params), ch.daily_arrays(other)).collect()}
    assert got.keys() == diff.keys() and all(got[k] == pytest.approx(diff[k], rel=1e-9) for k in got)


def test_unfinished_fits_are_flagged(testdays, monkeypatch):
    t, y = random_lactations(30, seed=5)
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in t])])
    args = (bf.wood, offsets, np.concatenate(t), np.ones(offsets[-1]), np.concatenate(y), fitting.BOUNDS["wood"])
    assert bf.fit_flagged(*args)[2].all()
    monkeypatch.setattr(bf, "ROUNDS", 1)
    assert not bf.fit_flagged(*args)[2].any()


def test_batch_of_all_fits_reads_the_input_once(testdays):
    f = TRUE["milkbot"][1]
    rows = [(i, int(t), f(t, 40 + i, 25, 5, 0.003)) for i in (1, 2) for t in range(5, 300, 20)] + [(3, 10, 20.0), (3, 60, 25.0), (3, 200, 15.0)]
    out = ch.characteristics_batch(testdays(rows), list(fitting.FITTED))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and plan.count("ArrowEvalPython") == 1
    got = {(r.test_id, r.fit): r for r in out.collect()}
    assert {k for k in got if k[0] < 3} == {(i, m) for i in (1, 2) for m in fitting.FITTED}
    assert {m for i, m in got if i == 3} == {"wood", "fischer", "wilmink"}
    for m in fitting.FITTED:
        one = {r.test_id: r for r in ch.calculate_characteristics(testdays(rows), m).collect()}
        for c in ch.CHARACTERISTICS:
            assert got[1, m][c] == pytest.approx(one[1][c], rel=1e-6), (m, c)


def test_a_coarse_grid_is_worked_out_once_per_day(monkeypatch):
    t, y = random_lactations(60, seed=8)
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in t])])
    days = np.concatenate(t)
    args = (bf.milkbot, offsets, days, np.ones(offsets[-1]), np.concatenate(y), fitting.BOUNDS["milkbot"])
    want = bf.fit_flagged(*args)
    cells = []
    shape = bf.SHAPES[bf.milkbot]
    monkeypatch.setitem(bf.SHAPES, bf.milkbot, lambda t, theta: cells.append(len(t) * theta.shape[-2]) or shape(t, theta))
    monkeypatch.setattr(bf, "CELLS", 2_000)  # many runs share one grid
    got = bf.fit_flagged(*args)
    assert cells == [len(np.unique(days)) * bf.COARSE**2]
    for a, b in zip(want, got):
        assert np.allclose(a, b, rtol=1e-9)

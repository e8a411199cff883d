"""Fits laid out beside others with as many records, and the incomplete gamma function of wood curves summed over a batch."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from dairyframe.functions import bounded_fit as bf, curves
from dairyframe.operators import characteristics as ch, fitting


def lactations(lengths, seed=3):
    """Random lactations; the same day may come with a weight."""
    rng = np.random.default_rng(seed)
    t = [np.sort(rng.choice(np.arange(0, 400), n, replace=False)).astype(float) for n in lengths]
    y = [np.abs(20 * (x + 1) ** 0.2 * np.exp(-0.004 * x) * rng.normal(1, 0.2, len(x))) for x in t]
    w = [rng.integers(1, 4, len(x)).astype(float) for x in t]
    return t, w, y


@pytest.mark.parametrize("model", ["wood", "fischer", "milkbot", "milkbot_trf"])
def test_a_fit_does_not_depend_on_the_lactations_beside_it(monkeypatch, model):
    lengths = [1, 4, 5, 5, 3, 9, 11, 40, 4, 2, 130, 6, 7, 8, 8, 4, 200]
    t, w, y = lactations(lengths)
    top = np.array([v.max() for v in y]) if model == "milkbot_trf" else None
    fit = lambda k: bf.fit_flagged(
        fitting.SOLVERS[model], np.concatenate([[0], np.cumsum([len(t[i]) for i in k])]), *(np.concatenate([x[i] for i in k]) for x in (t, w, y)),
        fitting.BOUNDS[model], None if top is None else top[k],
    )

    def gone(*_):
        raise AssertionError("sums over records are sums of whole arrays")

    monkeypatch.setattr(bf.Days, "total", gone)
    together = fit(list(range(len(t))))
    for few, cells, records in ((0, 60_000, 64_000), (100, 500, 64_000), (2, 60_000, 30)):
        for name, value in (("FEW", few), ("CELLS", cells), ("RECORDS", records)):
            monkeypatch.setattr(bf, name, value)
        for a, b in zip(together, fit(list(range(len(t))))):
            assert np.allclose(a, b, rtol=1e-6)
    for i in range(len(t)):
        alone = fit([i])
        assert alone[2][0] == together[2][i] and alone[1][0] == pytest.approx(together[1][i], rel=1e-6, abs=1e-9)
        if lengths[i] >= fitting.FREE_PARAMETERS[model]:
            assert np.allclose(alone[0][0], together[0][i], rtol=1e-4)


def test_days_that_hardly_repeat_are_fitted_in_shorter_runs(monkeypatch):
    t, w, y = lactations([5] * 40, seed=6)
    args = (bf.wood, np.arange(0, 201, 5), *(np.concatenate(x) for x in (t, w, y)), fitting.BOUNDS["wood"])
    want, runs, search = bf.fit_flagged(*args), [], bf.search
    monkeypatch.setattr(bf, "DISTINCT", 50)
    monkeypatch.setattr(bf, "search", lambda solve, days, *more: runs.append(len(days.t)) or search(solve, days, *more))
    for a, b in zip(want, bf.fit_flagged(*args)):
        assert np.allclose(a, b, rtol=1e-6)
    assert runs == [50] * 4


def test_incomplete_gamma():
    s, x = np.array([1.0, 2.5, 1.2, 3.0, 0.0, -2.0, 1.1, 1.1, 2.0]), np.array([0.5, 8.0, 30.0, 100.0, 1.0, 1.0, np.nan, -1.0, 1e9])
    value, none = curves.lower_gammas(s, x)
    for i in range(4):
        fine = np.linspace(0, x[i], 2_000_001)
        part = fine ** (s[i] - 1) * np.exp(-fine)
        assert value[i] == pytest.approx(((part[1:] + part[:-1]) / 2 * np.diff(fine)).sum(), rel=1e-6)
    assert value[0] == pytest.approx(1 - math.exp(-0.5), rel=1e-12)
    assert list(none[4:6]) == [True, True] and not none[:4].any() and np.isnan(value[[6, 7, 8]]).all()
    assert [len(v) for v in curves.lower_gammas(s[:0], x[:0])] == [0, 0]


def test_characteristics_walk_no_lambda(spark, testdays):
    rows = [(i, t, 20 + i + (t * i) % 5) for i in (1, 2) for t in range(5, 300, 30)]
    plan = ch.characteristics_batch(testdays(rows), list(fitting.FITTED))._jdf.queryExecution().executedPlan().toString()
    assert "lambda" not in plan.lower()
    frame = spark.createDataFrame(
        [(1, "wood", 20.0, 0.2, 0.004, 250), (2, "wood", 20.0, None, 0.004, 250), (3, "wood", 20.0, 0.2, 0.0, 250), (4, "wood", 20.0, 0.2, 1e7, 250), (5, "wood", 20.0, 0.2, 0.004, None)],
        "test_id int, model string, a double, b double, c double, max_dim int",
    ).withColumns({"d": F.lit(None).cast("double"), "k": F.lit(None).cast("double")})
    got = {r.test_id: r.cumulative_milk_yield for r in ch.characteristics_from_params(frame, length="max").collect()}
    day = np.linspace(1e-9, 250, 2_000_001)
    curve = 20 * day**0.2 * np.exp(-0.004 * day)
    assert got[1] == pytest.approx(((curve[1:] + curve[:-1]) / 2 * np.diff(day)).sum(), rel=1e-5)
    days = np.arange(1, 251.0)
    flat = 20 * days**0.2
    # without a closed form, or where it overflows, the area of the daily curve counts
    assert got[2] is None and got[3] == pytest.approx(flat.sum() - (flat[0] + flat[-1]) / 2, rel=1e-12) and got[4] == pytest.approx(0.0) and got[5] is None

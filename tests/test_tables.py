"""Reference tables as DataFrames, interpolation by a caller's function, covariance by scoring."""

import numpy as np
import pytest
from conftest import by_id
from pyspark.sql import functions as F

from dairyframe.operators import best_prediction as bp, features as ft, standard_curve as sc

CURVE = [40 - 20 * d / 305 for d in range(306)]


@pytest.fixture(scope="module")
def records(spark):
    rng = np.random.default_rng(3)
    rows, pos = [], 0
    for i in range(60):
        for d in rng.choice(np.arange(0, 320), rng.integers(1, 12)):
            rows.append((i, int(d), float(round(rng.uniform(5, 50), 2)), pos))
            pos += 1
    return spark.createDataFrame(rows, "test_id bigint, dim int, milk_kg double, pos bigint").cache()


@pytest.fixture(scope="module")
def tables(spark):
    n = len(sc.WIDE_GRID)
    rng = np.random.default_rng(5)
    corr = np.corrcoef(rng.normal(size=(n, 40)))
    curve = spark.createDataFrame([(d, CURVE[d]) for d in range(306)], "day int, expected_kg double")
    pairs = [(g, h, float(corr[i][j])) for i, g in enumerate(sc.WIDE_GRID) for j, h in enumerate(sc.WIDE_GRID)]
    spread = [(g, float(1 + i % 4)) for i, g in enumerate(sc.WIDE_GRID)]
    std = spark.createDataFrame(spread, "day int, std double")
    return curve, spark.createDataFrame(pairs, "day_i int, day_p int, corr double"), std, sc.Standard(CURVE, corr.tolist(), [s for _, s in spread])


def test_islc_with_tables(records, tables):
    curve, corr, std, plain = tables
    from_tables = sc.Standard.from_tables(curve, corr, std)
    assert by_id(sc.islc_yield(records, from_tables), "yield_kg") == by_id(sc.islc_yield(records, plain), "yield_kg")
    without_day_0 = sc.Standard.from_tables(curve.filter("day > 0"), corr, std)
    assert without_day_0.curve[0] == CURVE[1]


def test_tables_of_another_size_are_refused(tables):
    curve, corr, std, _ = tables
    for bad in ((curve.filter("day <> 7"), corr, std), (curve, corr.filter("day_i <> 10"), std), (curve, corr, std.unionByName(std)), (curve, corr.unionByName(corr), std)):
        with pytest.raises(ValueError):
            sc.Standard.from_tables(*bad)


def test_best_prediction_with_tables(spark, records):
    covariance = bp.ar1_covariance(3.0, 20.0, 0.97)
    curve = spark.createDataFrame([(d, CURVE[d]) for d in range(306)], "dim int, expected_kg double")
    i, j = np.divmod(np.arange(305 * 305), 305)
    cov = spark.createDataFrame(list(zip((i + 1).tolist(), (j + 1).tolist(), covariance.ravel().tolist())), "i int, j int, cov double")
    assert by_id(bp.best_prediction_yield(records, curve, cov), "yield_kg") == by_id(bp.best_prediction_yield(records, CURVE[1:], covariance), "yield_kg")
    with pytest.raises(ValueError):
        bp.best_prediction_yield(records, curve, cov.filter("i <> 5"))
    with pytest.raises(ValueError):
        bp.best_prediction_yield(records, curve.filter("dim <> 9"), cov)


@pytest.fixture
def linear():
    """A caller's function; made here, since tasks cannot import this module."""

    def fn(day, milk, curve, grid):
        inside = (grid >= day.min(initial=999)) & (grid <= day.max(initial=-1))
        return np.where(inside, np.interp(grid, day, milk) if len(day) else np.nan, np.nan)

    return fn


def test_a_plain_function_gives_the_built_in_grid(records, linear):
    got = {(r.test_id, r.grid_day): r.milk_kg for r in sc.per_lactation(linear)(records, CURVE).collect()}
    want = {(r.test_id, r.grid_day): r.milk_kg for r in sc.interp_linear_range(records).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
    a = sc.standard_representation(records, CURVE, interpolation=sc.per_lactation(linear)).correlation.collect()
    b = sc.standard_representation(records, CURVE, interpolation=lambda df, curve, **kw: sc.interp_linear_range(df, **kw)).correlation.collect()
    assert {(r.day_i, r.day_p, r.n) for r in a} == {(r.day_i, r.day_p, r.n) for r in b}


def test_what_a_function_returns_is_checked(records):
    for bad in (lambda *a: np.zeros(3), lambda d, m, c, grid: np.full(len(grid), np.inf)):
        with pytest.raises(Exception, match="one per grid day"):
            sc.per_lactation(bad)(records, CURVE).collect()


def test_covariance_recovers_known_parameters(testdays):
    rng = np.random.default_rng(21)
    cov = bp.ar1_covariance(6.0, 18.0, 0.93)
    rows = []
    for i in range(1500):
        idx = np.sort(rng.choice(305, rng.integers(3, 9), replace=False))
        v = np.linalg.cholesky(cov[np.ix_(idx, idx)]) @ rng.normal(size=len(idx))
        rows += [(i, int(d) + 1, 30.0 + float(x)) for d, x in zip(idx, v)]
    fit = bp.fit_ar1_covariance(testdays(rows), [30.0] * 305)
    assert fit["converged"] and fit["passes"] <= 25
    assert fit["b1"] == pytest.approx(6.0, rel=0.3) and fit["b2"] == pytest.approx(18.0, rel=0.2) and fit["rho"] == pytest.approx(0.93, abs=0.02)
    # the gradient vanishes where it stopped
    measured = bp.deviations(testdays(rows), [30.0] * 305, keep="mean")
    row = bp.ar1_scores(measured, fit["b1"], fit["b2"], fit["rho"]).first()
    assert all(abs(row[f"g{i}"]) < 1e-2 for i in range(3))
    step = 1e-4
    up = bp.ar1_scores(measured, fit["b1"] * np.exp(step), fit["b2"], fit["rho"]).first()
    assert up["loss"] >= row["loss"] and (up["g0"] - row["g0"]) / step == pytest.approx(row["f00"], rel=0.2)


def test_few_passes_are_flagged(testdays):
    rows = [(i, d, 30 + (i * d) % 7) for i in range(30) for d in (5, 60, 200)]
    assert bp.fit_ar1_covariance(testdays(rows), [30.0] * 305, most=1)["converged"] is False


def test_scoring_levels(spark):
    rows = spark.createDataFrame([(1, [1.0, None, 3.0, 2.0]), (2, [0.0, 0.0, 0.0, 0.0])], "test_id int, milk array<double>")
    made = []

    def setup():
        made.append(1)
        return lambda batch: np.stack(batch["milk"].to_list()) * 2

    raw = ft.score_batch(rows, setup=setup, level="raw")
    assert raw.columns == ["test_id", "predictions"] and by_id(raw, "predictions")[1] == [2.0, 2.0, 6.0, 4.0]
    rich = {r.test_id: r for r in ft.score_batch(rows, setup=setup, level="rich", late_day=4).collect()}
    assert rich[1].total_kg == 14.0 and tuple(rich[1].shape) == (6.0, 3, 14.0, pytest.approx(2 / 3)) and rich[2].shape.persistency == 0.0
    with pytest.raises(ValueError):
        ft.score_batch(rows, setup=setup, level="best")
    with pytest.raises(ValueError):
        ft.score_batch(rows)
    with pytest.raises(Exception, match="1 predictions for"):
        ft.score_batch(rows.coalesce(1), lambda batch: np.zeros((1, 4))).collect()

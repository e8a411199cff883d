"""Daily arrays by numpy passes against plain Python, with nulls, repeated days and missing values."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from dairyframe.functions import arrays as ar, curves, daily, text as tx
from dairyframe.operators import best_prediction as bp, characteristics as ch, features as ft, standard_curve as sc
from dairyframe.plans import models


def params(spark, rows):
    return spark.createDataFrame(rows, "test_id bigint, model string, a double, b double, c double, d double, k double, max_dim int")


def test_daily_curves_equal_the_column_forms(spark):
    rows = [(i, m, *models.BASE[m], 300 + i) for i, m in enumerate(models.BASE)]
    rows += [(50, "wood", 20.0, None, 0.004, None, None, 310), (51, "milkbot", 40.0, 0.0, 10.0, 0.005, None, 310), (52, "other", 1.0, 1.0, 1.0, 1.0, 1.0, 310), (53, None, 1.0, 1.0, 1.0, 1.0, 1.0, 310)]
    rows += [(54, "prasad", 30.0, -0.03, 0.00001, None, 1.0, None), (55, "nelder", 0.0, -4.0, 1.0, None, None, 310), (56, "sikka", 1e300, 1e3, 0.0, None, None, 310)]
    frame = params(spark, rows)
    horizon = F.greatest(F.lit(305), F.col("max_dim"))
    each = frame.select("test_id", "model", *curves.PARAMETERS, F.posexplode(F.sequence(F.lit(1), horizon)).alias("i", "day"))
    want: dict = {}
    for r in each.select("test_id", "day", curves.curve_by_name(F.col("model"), F.col("day")).alias("y")).collect():
        want.setdefault(r.test_id, {})[r.day] = r.y
    got = {r.test_id: r.y for r in ch.daily_arrays(frame).collect()}
    assert got[52] is None and got[53] is None
    assert set(got[50]) == {None} and set(got[54]) == {None} and set(got[51]) == {None} and got[55][3] is None
    for i, ys in got.items():
        if ys is not None:
            assert len(ys) == len(want[i])
            for day, y in enumerate(ys, 1):
                assert (y is None) == (want[i][day] is None) and (y is None or y == pytest.approx(want[i][day], rel=1e-12)), (i, day)
    # what a walk over the same curves shows
    for r in daily.walk_curves(frame.withColumns({"_end": F.lit(250), "_horizon": horizon}), list(curves.MODELS)).collect():
        ys = [y for y in want[r.test_id].values() if y is not None]
        if not ys:
            assert (r._top, r._day, r._trapezoid, r._last) == (None,) * 4
            continue
        assert r._top == pytest.approx(max(ys), rel=1e-12) and want[r.test_id][r._day] == pytest.approx(r._top, rel=1e-12)
        head = [want[r.test_id][d] for d in range(1, 251)]
        assert (r._trapezoid is None) == (None in head)
        if None not in head:
            assert r._trapezoid == pytest.approx(sum(head) - (head[0] + head[-1]) / 2, rel=1e-12, nan_ok=True)


def test_curves_are_compared_without_a_broadcast_or_a_shuffle_of_arrays(spark):
    frame = params(spark, [(i, m, *models.BASE[m], 300 + i) for i, m in enumerate(models.BASE)])
    other = frame.withColumn("a", F.col("a") * 1.05)
    by_rows = ch.array_diff(frame, other)
    by_arrays = ch.array_diff(ch.daily_arrays(frame), ch.daily_arrays(other))
    for out in (by_rows, by_arrays):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Broadcast" not in plan and "SortMergeJoin" in plan
    assert by_rows.orderBy("test_id").collect() == by_arrays.orderBy("test_id").collect()
    # the join comes before the curves
    plan = by_rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("ArrowEvalPython") < plan.index("Join")


def test_summary_and_tally_with_nulls(spark):
    nan = math.nan
    data = [(1, [1.0, None, 3.0]), (2, []), (3, None), (4, [None, None]), (5, [2.0, nan, -1.0]), (6, [4.0, 4.0])]
    frame = spark.createDataFrame(data, "id int, x array<double>")
    got = {r.id: r for r in frame.select("id", daily.summary(F.col("x")).alias("s"), daily.tally(F.col("x")).alias("t"), F.array_max("x").alias("hi"), F.array_min("x").alias("lo")).collect()}
    for r in got.values():
        assert repr(r.s.top) == repr(r.hi) and repr(r.s.low) == repr(r.lo)
    assert got[1].s.mean is None and got[1].s.total == 4.0 and got[1].s.plain is None
    assert (got[2].s.mean, got[2].s.total, got[2].s.plain) == (None, 0.0, 0.0) and got[3].s.total is None
    assert (got[6].s.mean, got[6].s.std) == (4.0, 0.0)
    assert tuple(got[1].t) == (2, 2, 4.0, 10.0) and tuple(got[2].t) == (0, 0, 0.0, 0.0) and got[3].t.seen is None
    assert (got[5].t.seen, got[5].t.positive) == (3, 2)


def test_spread_keeps_the_last_of_a_day_and_pairs_from_the_end(spark):
    data = [
        (1, [2, 2, 9, 0, -1], [1.0, 5.0, 7.0, 8.0, 9.0]),  # a repeated day, days outside
        (2, [1, 3], [4.0, None]),  # a day without a value
        (3, [1, 2], [6.0]),  # one value short: the last day has it
        (4, [], []),
        (5, None, [1.0]),
        (6, [3, None, 1], [1.0, 2.0, 3.0]),
    ]
    frame = spark.createDataFrame(data, "id int, dim array<int>, milk array<double>")
    forms = [daily.spread_days(F.col("dim"), F.col("milk"), 3, missing=m).alias(n) for m, n in ((0.0, "zero"), (None, "gap"))]
    got = {r.id: (r.zero, r.gap) for r in frame.select("id", *forms).collect()}
    assert got[1] == ([0.0, 5.0, 0.0], [None, 5.0, None])
    assert got[2] == ([4.0, 0.0, None], [4.0, None, None])
    assert got[3] == ([None, 6.0, 0.0], [None, 6.0, None])
    assert got[4] == got[5] == ([0.0] * 3, [None] * 3)
    assert got[6] == ([3.0, 0.0, 1.0], [3.0, None, 1.0])


def test_lactations_are_spread_without_a_walk_over_days(spark, testdays):
    rows = testdays([(1, 5, 10.0), (1, 5, 20.0), (1, 400, 9.0), (2, 400, 1.0), (3, 7, None), (3, 8, 30.0)])
    pivoted, deviated = bp.pivot_days(rows), bp.deviation_vector(rows, [1.0] * 305)
    scored = ft.score_batch(
        rows.filter("milk_kg is not null").groupBy("test_id").agg(F.collect_list("dim").alias("d"), F.collect_list("milk_kg").alias("m")).select("test_id", ar.project_daily(F.col("d"), F.col("m"), missing=None).alias("milk")),
        ft.scaled_mean_curve([1.0] * 304),
    )
    for out in (pivoted, deviated, scored):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "transform(" not in plan and "aggregate(" not in plan and "filter(" not in plan
    got = {r.test_id: r.milk for r in pivoted.collect()}
    assert got[1][4] == 15.0 and sum(v is not None for v in got[1]) == 1 and set(got[2]) == {None} and got[3][7] == 30.0
    got = {r.test_id: r.deviation for r in deviated.collect()}
    assert got.keys() == {1, 3} and got[1][4] == 19.0 and sum(got[1]) == 19.0 and sum(got[3]) == 29.0
    # carried forward from day 8 on, so the level is 30
    assert {r.test_id: r.total_kg for r in scored.collect()}[3] == pytest.approx(304 * 30.0)


def test_a_missing_prediction_is_null(spark):
    frame = spark.createDataFrame([(1, [1.0, 2.0])], "test_id bigint, milk array<double>")
    for found in (lambda b: np.array([[math.nan, 2.0]]), lambda b: [[math.nan, 2.0]]):
        row = ft.score_batch(frame, found).first()
        assert row.predictions == [None, 2.0] and row.total_kg == 2.0


def test_grid_days_are_found_without_a_walk_over_days(testdays):
    rows = testdays([(1, 5, 10.0), (1, 50, None), (1, 60, 20.0), (1, 200, 9.0), (2, -3, 1.0), (2, 40, 2.0), (3, 400, 1.0), (4, 30, 7.0)])
    curve = [40 - 20.0 * day / 305 for day in range(306)]
    standard = sc.Standard(curve, np.eye(17).tolist(), [1.0] * 17)
    outs = [sc.interp_standard_curve(rows, curve), sc.nearest_grid_days(rows, curve), sc.islc_yield(rows, standard)]
    for out in outs:
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "lambda" not in plan, plan
    points = {(r.test_id, r.grid_day): r.milk_kg for r in outs[0].collect()}
    # a measured day without a yield stays without one, and so do the days beside it
    assert {k for k in points if k[0] == 1} == {(1, g) for g in (70, 90, 110, 130, 150, 170, 190)} and points[4, 30] == 7.0
    assert not [k for k in points if k[0] in (2, 3)]
    yields = {r.test_id: r.yield_kg for r in outs[2].collect()}
    assert yields.keys() == {1, 2, 4} and yields[2] is None and yields[1] > 0
    assert {(r.grid_day, r.nearest_day) for r in outs[1].collect() if r.test_id == 4 and r.grid_day != 30} == {(g, 30) for g in sc.WIDE_GRID if g != 30}


def test_scores_of_the_covariance_equal_the_direct_form():
    rng = np.random.default_rng(4)
    b1, b2, rho = 2.0, 5.0, 0.95
    day = np.sort(np.array([rng.choice(np.arange(1, 306), 4, replace=False) for _ in range(20)]), axis=1)
    v = rng.normal(size=day.shape)
    want = np.zeros(11)
    for d, y in zip(day, v):
        gap = np.abs(d[:, None] - d[None]).astype(float)
        slopes = [b1 * np.eye(4), b2 * rho**gap, b2 * rho**gap * gap * (1 - rho)]
        block = slopes[0] + slopes[1]
        inverse = np.linalg.inv(block)
        a = inverse @ y
        want += np.array([4, 0.5 * (np.linalg.slogdet(block)[1] + y @ a + 4 * np.log(2 * np.pi)), *[0.5 * (np.trace(inverse @ s) - a @ s @ a) for s in slopes],
                          *[0.5 * np.trace(inverse @ slopes[i] @ inverse @ slopes[j]) for i in range(3) for j in range(i, 3)]])
    assert bp._scores(day, v, b1, b2, rho) == pytest.approx(want, rel=1e-9)


def test_covariance_passes_read_arrow_batches(testdays):
    rows = testdays([(i, d, 20.0 + (i * d) % 7) for i in range(4) for d in (5, 40, 90)])
    deviations = bp.deviations(rows, [1.0] * 305)
    for out in (bp.ar1_scores(deviations, 1.0, 1.0, 0.9), bp.ar1_log_likelihood(deviations, [(1.0, 0.9)])):
        assert "MapInArrow" in out._jdf.queryExecution().executedPlan().toString()
        assert out.first()["n"] == 12.0


def test_a_cell_is_cleaned_once(spark):
    cells = [" 1,5*", "12**", "1,234.5", "1.5e2", "n/a", "", None, " -3 ", "4*5", "1,2,3", "NaN", "7d", "8*\n"]
    frame = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "id int, c string")
    out = frame.select("id", tx.parse_number(F.col("c")).alias("v"))
    assert out._jdf.queryExecution().optimizedPlan().toString().lower().count("regexp_replace(") == 1
    got = {r.id: r.v for r in out.collect()}
    assert [got[i] for i in range(len(cells))] == [1.5, 12.0, None, 150.0, None, None, None, -3.0, None, None, None, None, 8.0]

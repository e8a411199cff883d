"""Gap filling, sequence scaling, projection, features and samples on the documented examples."""

import math

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from dairyframe.functions import arrays as ar
from dairyframe.operators import features as ft, herd, lookups, sampling


def run(spark, x, expression):
    row = spark.createDataFrame([(x,)], "x array<double>").select(expression(F.col("x")).alias("y")).collect()[0]
    return row["y"]


GAPS = [1.0, None, 3.0, None, 5.0]
NAN, INF = float("nan"), float("inf")


@pytest.mark.parametrize(
    "x, method, want",
    [
        (GAPS, "forward_fill", [1, 1, 3, 3, 5]),
        (GAPS, "backward_fill", [1, 3, 3, 5, 5]),
        (GAPS, "linear", [1, 2, 3, 4, 5]),
        (GAPS, "zero", [1, 0, 3, 0, 5]),
        ([1.0, None, 5.0], "mean", [1, 3, 5]),
        ([1.0, None, None, 4.0, 5.0, None], "forward_fill", [1, 1, 1, 4, 5, 5]),
        ([None, 2.0, None], "forward_fill", [None, 2, 2]),
        ([None, 2.0, None], "linear", [2, 2, 2]),
        ([NAN, 2.0, INF], "backward_fill", [2, 2, None]),
        ([None, None], "linear", [None, None]),
        ([None, None], "mean", [None, None]),
    ],
)
def test_gap_filling(spark, x, method, want):
    assert run(spark, x, lambda c: ar.impute(c, method)) == want
    assert run(spark, x, lambda c: ar.impute_by(c, F.lit(method), "zero")) == want


def test_display_forms(spark):
    assert run(spark, [None, 2.0, None], lambda c: ar.forward_fill(c, fill_edges=True)) == [2, 2, 2]
    assert run(spark, [None, 2.0, None], lambda c: ar.backward_fill(c, fill_edges=True)) == [2, 2, 2]
    for fill in (lambda c: ar.forward_fill(c, fill_edges=True), lambda c: ar.linear(c, zero_when_empty=True)):
        assert run(spark, [None, None], fill) == [0, 0]


def test_filling_many_rows_keeps_them_apart(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(300):
        values = rng.uniform(0, 50, int(rng.integers(0, 40)))
        rows.append((i, [None if rng.random() < 0.5 else float(v) for v in values] if i % 50 else None))
    frame = spark.createDataFrame(rows, "id int, x array<double>").repartition(7)
    got = {r["id"]: r["y"] for r in frame.select("id", ar.forward_fill(F.col("x")).alias("y")).collect()}
    for i, x in rows:
        last, want = None, None if x is None else []
        for v in x or []:
            last = v if v is not None else last
            want.append(last)
        assert got[i] == want


def test_scaling(spark):
    x = [1.0, 2.0, 3.0, 4.0]
    assert run(spark, x, ar.zscore) == pytest.approx(((np.array(x) - 2.5) / np.std(x)).tolist())
    assert run(spark, [4.0, 4.0], ar.zscore) == [0, 0]
    assert run(spark, x, ar.minmax) == pytest.approx([0, 1 / 3, 2 / 3, 1])
    assert run(spark, [4.0, 4.0], ar.minmax) == [0, 0]
    assert run(spark, [-4.0, 2.0], ar.maxabs) == [-1, 0.5]
    assert run(spark, [0.0, 0.0], ar.maxabs) == [0, 0]
    assert run(spark, [80.0, None], ar.milk_scale) == [1, 0]
    assert run(spark, [0.5, 1.0], ar.actual_milk) == [40, 80] and run(spark, [0.5, 1.5], ar.actual_milk) == [0.5, 1.5]
    assert run(spark, [5.0, None], ar.stats_minmax) == pytest.approx([5 / (5 + 1e-6), 0])
    assert run(spark, [5.0, 5.0], ar.stats_minmax) == [5, 5]


def test_lengths_and_windows(spark):
    x = [1.0, 2.0, 3.0]
    pad = F.lit(9.0)
    assert run(spark, x, lambda c: ar.pad_truncate(c, 5, pad)) == [1, 2, 3, 9, 9]
    assert run(spark, x, lambda c: ar.pad_truncate(c, 5, pad, mode="pre")) == [9, 9, 1, 2, 3]
    assert run(spark, x, lambda c: ar.pad_truncate(c, 2, pad, mode="pre")) == [1, 2]
    starts = [w["start"] for w in run(spark, x, lambda c: ar.windows(c, 2))]
    assert starts == [1, 2] and run(spark, x, lambda c: ar.windows(c, 4)) == []
    assert run(spark, x, lambda c: ar.windows(c, 2, first_only=True))[0]["values"] == [1, 2]


def test_projection_and_horizon(spark):
    frame = spark.createDataFrame(
        [(1, [2, 2, 0, 400], [10.0, 11.0, 5.0, 6.0]), (2, [400], [5.0]), (3, [3], [-1.0]), (4, [3, 4], [1.0, 2.0]), (5, [3], [1.0, 2.0])],
        "id int, dim array<int>, milk array<double>",
    )
    dim, milk = F.col("dim"), F.col("milk")
    rows = {r["id"]: r for r in frame.select("id", ar.project_daily(dim, milk, 3).alias("d"), ar.project_daily(dim, milk, 3, missing=None).alias("g"), ar.horizon_reject(dim, milk).alias("why")).collect()}
    assert rows[1]["d"] == [0, 11, 0] and rows[1]["g"] == [None, 11, None]
    assert [rows[i]["why"] for i in range(1, 6)] == ["duplicate_day", "no_day_in_horizon", "invalid_milk", None, "length_mismatch"]


def test_default_events_and_tokens(spark):
    row = spark.createDataFrame([(None,)], "e array<string>").select(ar.default_events(F.col("e")).alias("e")).collect()[0]["e"]
    assert row[0] == "calving" and row[1:] == ["pad"] * 303
    frame = spark.createDataFrame([(["Calving", None, "odd"],)], "e array<string>")
    known = frame.select(lookups.event_tokens(F.col("e"), {"pad": 0, "calving": 1, "unknown": 4}).alias("t")).collect()[0]["t"]
    bare = frame.select(lookups.event_tokens(F.col("e"), {"pad": 0, "calving": 1}).alias("t")).collect()[0]["t"]
    assert known == [1, 4, 4] and bare == [1, 2, 2]


def stats(spark, rows, keys):
    return spark.createDataFrame([(*k, {"Achieved21Milk": v}) for *k, v in rows], f"{keys}, stats map<string,double>")


def test_four_levels_of_herd_statistics(spark):
    records = spark.createDataFrame(
        [(1, "1001", "1", None), (2, "1001", "9", None), (3, "7", "2", None), (4, "7", "9", None), (5, None, None, None), (6, "1001.0", "1", {"Achieved21Milk": 5.0})],
        "id int, herd_id string, parity string, stats map<string,double>",
    )
    got = lookups.hierarchical_stats(
        records,
        stats(spark, [(1001, 1, 1.0)], "herd_id int, parity int"),
        stats(spark, [(1001, 20.0), (1002, 21.0)], "herd_id int"),
        stats(spark, [(1, 110.0), (2, 111.0)], "parity int"),
        {"Achieved21Milk": 200.0},
    )
    rows = {r["id"]: (r["stats_level"], r["stats"]["Achieved21Milk"]) for r in got.collect()}
    assert rows == {1: (1, 1.0), 2: (2, 20.0), 3: (3, 111.0), 4: (4, 200.0), 5: (4, 200.0), 6: (0, 5.0)}


def test_registry_refuses_unknown_names_and_parameters():
    with pytest.raises(ValueError, match="unknown transform"):
        ft.create("nothing")
    with pytest.raises(ValueError, match="bad parameters"):
        ft.create("imputation", colour="red")


def documents(spark, **gone):
    row = {"animal_id": "CX123", "herd_id": 7, "parity": 2, "milk": [40.0] * 316, "events": [1] * 300, "herd_stats": [0.5] * 10}
    row.update(gone)
    schema = "animal_id string, herd_id bigint, parity int, milk array<double>, events array<int>, herd_stats array<double>"
    return spark.createDataFrame([tuple(row.values())], schema)


def test_feature_rows(spark):
    row = ft.feature_rows(documents(spark)).collect()[0]
    f = row["features"]
    assert (len(f["milk"]), len(f["events"]), f["parity"], len(f["herd_stats"])) == (304, 304, [2.0], 10)
    assert f["events"][299] == 1 and f["events"][300] == 0 and row["metadata"]["animal_id"] == "CX123"
    with pytest.raises(PySparkException, match="herd_stats"):
        ft.feature_rows(documents(spark, herd_stats=None)).collect()


def test_scoring_scales_the_mean_curve(spark):
    curve = [20.0] * 304
    frame = spark.createDataFrame([(1, [30.0] + [None] * 303, None), (2, [10.0] + [None] * 303, "zero")], "test_id int, milk array<double>, imputation_method string")
    got = {r["test_id"]: r["total_kg"] for r in ft.score_batch(frame, ft.scaled_mean_curve(curve)).collect()}
    assert got == {1: pytest.approx(30 * 304), 2: pytest.approx(10 * 304)}


def test_stratified_sample_sizes(spark):
    rows = [(i, 1 if i < 700 else 2 if i < 990 else None if i < 995 else 3) for i in range(1000)]
    frame = spark.createDataFrame(rows, "test_id bigint, parity int")
    got = sampling.stratified_sample(frame, 100).collect()
    per = {}
    for r in got:
        per[r["parity"]] = per.get(r["parity"], 0) + 1
    assert len(got) == len({r["test_id"] for r in got}) == 100
    assert per[1] in (69, 70) and per[2] in (28, 29) and per[3] == 1 and per[None] == 1 or sum(per.values()) == 100
    assert sampling.stratified_sample(frame, 5000).count() == 1000
    again = sampling.stratified_sample(frame.repartition(11), 100).collect()
    assert {r["test_id"] for r in again} == {r["test_id"] for r in got}


def test_batches_cover_everything_once(spark):
    frame = spark.range(1000).withColumnRenamed("id", "test_id")
    rows = sampling.shuffle_batches(frame, batch_size=64).collect()
    assert sorted(r["test_id"] for r in rows) == list(range(1000))
    places = sorted((r["batch_id"], r["slot"]) for r in rows)
    assert places == [(i // 64, i % 64) for i in range(1000)]
    collated = sampling.collate(sampling.shuffle_batches(frame, batch_size=64)).collect()
    assert sorted(len(r["test_id"]) for r in collated) == [1000 - 15 * 64] + [64] * 15


def test_stats_vector(spark):
    frame = spark.createDataFrame([({"DaysOpen": 3.0},)], "s map<string,double>")
    vector = frame.select(herd.stats_vector(F.col("s")).alias("v")).collect()[0]["v"]
    assert vector == [0, 0, 0, 0, 0, 0, 3, 0, 0, 0] and not math.isnan(sum(vector))
    wrong = run(spark, [1.0, 2.0], herd.checked_vector)
    assert wrong == [0.0] * 10

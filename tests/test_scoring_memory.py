"""Scoring holds few sequences at a time, in one Python worker for all its steps."""

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from dairyframe.functions import arrays as ar
from dairyframe.operators import features as ft

METHODS = ["forward_fill", "backward_fill", "linear", "zero", "mean", None]


def sequences(spark, n):
    rng = np.random.default_rng(7)
    milk = [[None if rng.random() < 0.4 else float(np.round(rng.uniform(0, 40), 3)) for _ in range(12)] for _ in range(n)]
    rows = [(i if i % 50 else None, f"c{i % 3}", m, METHODS[i % len(METHODS)]) for i, m in enumerate(milk)]
    return spark.createDataFrame(rows, "test_id bigint, breed string, milk array<double>, imputation_method string")


@pytest.mark.parametrize("level", ft.LEVELS)
def test_one_python_worker_and_few_sequences_at_a_time(spark, level):
    frame = sequences(spark, 1500).coalesce(1)

    def scorer(batch):
        assert len(batch) <= 600 and list(batch.columns) == ["test_id", "breed", "milk"]
        return np.stack(batch["milk"].to_list())

    out = ft.score_batch(frame, scorer, level=level)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "EvalPython" not in plan
    got = sorted((tuple(r.predictions) for r in out.collect()), key=repr)
    filled = frame.select(ar.impute_by(F.col("milk"), F.col("imputation_method"), "forward_fill", zeros=True).alias("m"))
    assert got == sorted((tuple(r.m) for r in filled.collect()), key=repr) and len(got) == 1500


def test_sums_and_shapes_are_those_of_the_predictions(spark):
    nan = float("nan")
    found = [[1.0, nan, 3.0], [5.0, 5.0, 1.0], None, [nan, nan, nan], [-1.0, -2.0, -4.0], [0.0, 0.0, 0.0]]
    frame = spark.createDataFrame([(i, [float(i)]) for i in range(len(found))], "test_id bigint, milk array<double>").coalesce(1)
    out = ft.score_batch(frame, lambda batch: [found[int(i)] for i in batch["test_id"]], level="rich", late_day=3)
    assert out.columns == ["test_id", "predictions", "total_kg", "shape"]
    got = {r.test_id: r for r in out.collect()}
    assert got[0].predictions == [1.0, None, 3.0] and got[0].total_kg == 4.0 and tuple(got[0].shape) == (3.0, 3, None, 1.0)
    assert got[1].total_kg == 11.0 and tuple(got[1].shape) == (5.0, 1, 11.0, 0.2)
    assert got[2].predictions is None and got[2].total_kg is None and got[2].shape.cumulative_yield is None
    assert got[3].total_kg == 0.0 and got[3].shape.peak_yield is None and got[3].shape.cumulative_yield is None
    assert got[4].total_kg == -7.0 and tuple(got[4].shape) == (-1.0, 1, -7.0, 0.0) and got[5].total_kg == 0.0


def test_an_unknown_imputation_fails(spark):
    frame = spark.createDataFrame([(1, [1.0, None], "guess")], "test_id int, milk array<double>, imputation_method string")
    with pytest.raises(PySparkException, match="unknown imputation method guess"):
        ft.score_batch(frame, lambda batch: np.stack(batch["milk"].to_list())).collect()

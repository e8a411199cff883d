"""Bounded ordered arrays of keys with any number of rows, and samples by threshold."""

import pytest
from pyspark.sql import functions as F

from dairyframe.operators import alignment as al, chunks, sampling


@pytest.fixture
def no_coalescing(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_a_hot_lactation_is_many_chunks_in_many_tasks(spark, no_coalescing):
    # lactation 1 has a third of all records, and 25,000 records need several Arrow batches
    rows = spark.range(75_000).select(
        F.when(F.col("id") % 3 == 0, 1).otherwise(2 + F.col("id") % 901).alias("test_id"), (F.col("id") * 7919 % 75_000 % 306).cast("int").alias("dim"),
        (F.col("id") % 50).cast("double").alias("milk_kg"), F.col("id").alias("pos"),
    )
    made = al.nest_chunks(rows, size=500).cache()
    assert made.agg(F.max("n"), F.sum("n")).first()[:] == (500, 75_000)
    assert made.filter(F.size("dim") != F.col("n")).count() == 0
    hot = [r for r in made.filter("test_id = 1").orderBy("chunk").collect()]
    assert [r.chunk for r in hot] == list(range(len(hot)))
    assert [r.offset for r in hot] == [sum(x.n for x in hot[:i]) for i in range(len(hot))]
    laid = [(d, m) for r in hot for d, m in zip(r.dim, r.milk_kg)]
    want = [(r.dim, r.milk_kg) for r in rows.filter("test_id = 1").orderBy("dim", "pos").collect()]
    assert laid == want
    cold = made.filter("test_id > 1").groupBy("test_id").agg(F.count(F.lit(1)).alias("chunks"))
    # only a lactation at the edge of a range is cut
    assert cold.count() == 901 and cold.agg(F.sum("chunks")).first()[0] < 920


def test_null_keys_and_no_rows(spark):
    rows = spark.createDataFrame([(None, 2, "b"), (1, 1, "c"), (None, 1, "a"), (1, None, None)], "k int, o int, v string")
    got = chunks.ordered_chunks(rows, keys=["k"], order=["o"], fields=["v", "o"], size=5).collect()
    found = {}
    for r in sorted(got, key=lambda r: (r.k is not None, r.offset)):
        found.setdefault(r.k, []).extend(zip(r.o, r.v))
    assert found == {None: [(1, "a"), (2, "b")], 1: [(None, None), (1, "c")]}
    assert chunks.ordered_chunks(rows.limit(0), keys=["k"], order=["o"], fields=["v"]).count() == 0


@pytest.mark.parametrize("n", [1, 7, 100, 2500, 5000])
def test_sample_by_threshold_equals_ranking(spark, n):
    rows = spark.range(3000).select(F.col("id").alias("test_id"), F.when(F.col("id") % 3 == 0, 1).when(F.col("id") % 50 == 1, None).otherwise((F.col("id") % 7).cast("int")).alias("parity"))
    got = {r.test_id for r in sampling.stratified_sample(rows, n).collect()}
    every = rows.withColumns({"o": sampling.shuffle_key("test_id", 42), "o2": sampling.shuffle_key("test_id", 43)}).collect()
    strata = {}
    for r in every:
        strata.setdefault(r.parity, []).append(r)
    inside = set()
    for members in strata.values():
        share = len(members) if n >= 3000 else max(1, round(n * len(members) / 3000))
        inside |= {r.test_id for r in sorted(members, key=lambda r: (r.o, r.test_id))[:share]}
    want = {r.test_id for r in sorted(every, key=lambda r: (r.test_id not in inside, r.o2, r.test_id))[:n]}
    assert got == want

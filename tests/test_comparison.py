"""Agreement statistics, search and feed rules on the documented inputs."""

import json
from collections import Counter

import pytest
from pyspark.sql import functions as F

from dairyframe.functions import text as tx
from dairyframe.operators import comparison as cmp, detections as dt, feed as fd, lookups as lk, skew


@pytest.fixture
def sets(spark):
    rows = [(str(i), 8000.0 + 100 * i) for i in range(20)]
    yields = spark.createDataFrame(rows, "test_id string, yield_kg double")
    parities = spark.createDataFrame([(str(i), i % 3 + 1) for i in range(20)], "test_id string, parity int")
    return yields, parities


def test_identical_sets(sets):
    yields, parities = sets
    rows = {(r["axis"], r["parity_group"]): r for r in cmp.compare_three_axis(yields, yields, yields, parities).collect()}
    assert set(rows) == {(a, g) for a in cmp.AXES for g in ("all", "1", "2", "3+")}
    for r in rows.values():
        assert (r["pearson"], r["rmse"], r["mae"], r["mape"]) == (1.0, 0.0, 0.0, 0.0)
    assert rows[("challenger_vs_aly", "all")]["n"] == 20


def test_groups_and_missing_parity(spark):
    rows = [("a", 1.0, 2.0, 1), ("b", 2.0, 3.0, 2), ("c", 3.0, 5.0, 3), ("d", 4.0, 5.0, 4), ("e", 5.0, 0.0, None)]
    pairs = spark.createDataFrame(rows, "test_id string, a_kg double, b_kg double, parity int")
    got = {r["parity_group"]: r for r in cmp.compare_by_parity(pairs).collect()}
    assert {k: v["n"] for k, v in got.items()} == {"1": 2, "2": 1, "3+": 2, "all": 5}
    assert got["2"]["pearson"] is None
    # b is constant in 3+, and the zero truth stays in the denominator of 1
    assert got["3+"]["pearson"] is None and got["1"]["mape"] == pytest.approx(25.0)


def test_ids_on_one_side(spark):
    a = spark.createDataFrame([("x",), ("y",)], "test_id string")
    b = spark.createDataFrame([("y",), ("z",)], "test_id string")
    assert {r["test_id"]: r["side"] for r in lk.shared_and_single_ids(a, b).collect()} == {"x": "left", "y": "both", "z": "right"}


def test_empty_sets(spark, sets):
    none = spark.createDataFrame([], "test_id string, yield_kg double")
    row = cmp.compare_stats(lk.common_ids(none, none)).collect()[0]
    assert row["n"] == 0 and row["rmse"] is None and row["pearson"] is None


def test_lookup_join_is_the_same_with_hot_keys(spark):
    big = spark.range(2000).select("id", F.when(F.col("id") % 3 == 0, 1).otherwise((F.col("id") % 9).cast("int")).alias("k"))
    table = spark.createDataFrame([(i, f"n{i}") for i in range(6)], "k int, name string")
    for how in ("left", "inner"):
        got = sorted(map(tuple, skew.join_lookup(big, table, ["k"], how).select("id", "k", "name").collect()), key=str)
        assert got == sorted(map(tuple, big.join(table, "k", how).select("id", "k", "name").collect()), key=str)


def test_lookup_starts_no_job(spark):
    # a third of all rows has key 1, and every ninth row none
    key = F.when(F.col("id") % 9 == 8, None).when(F.col("id") % 3 == 0, 1).otherwise(F.col("id"))
    big = spark.range(3000).select("id", key.alias("k"), F.create_map(F.lit("x"), F.col("id")).alias("m"))
    table = spark.range(3000).select(F.col("id").alias("k"), F.col("id").alias("v"))
    status = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("lookup-plan", "building the plan must start no job")
    joined = skew.join_lookup(big, table, ["k"])
    started = status.getJobIdsForGroup("lookup-plan")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert not started
    rows = joined.collect()
    assert sorted(r["id"] for r in rows) == list(range(3000))
    assert all(r["v"] == r["k"] for r in rows)


def test_a_hot_lookup_key_is_split(spark):
    """A key with a third of the rows: the join is split into even tasks and each side is read once."""
    small = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k",
    }
    for key, value in small.items():
        spark.conf.set(key, value)
    try:
        key = F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id"))
        big = spark.range(0, 60_000, 1, 8).select("id", key.alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("payload"))
        table = spark.range(60_000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
        joined = skew.join_lookup(big, table, ["k"]).withColumn("task", F.spark_partition_id())
        rows = joined.collect()
        assert len(rows) == 60_000 and all(r["v"] == 2 * r["k"] for r in rows)
        hot = Counter(r["task"] for r in rows if r["k"] == 1)
        assert len(hot) > 2 and max(hot.values()) < 10_000
        plan = joined._jdf.queryExecution()
        assert "skew=true" in plan.executedPlan().toString() and plan.analyzed().toString().count("Range (") == 2
    finally:
        for key in small:
            spark.conf.unset(key)


def test_axes_without_pairs_and_failed_ids(spark, sets):
    yields, parities = sets
    some = yields.filter("test_id < '15'")
    none = yields.filter("yield_kg < 0")
    rows = {(r["axis"], r["parity_group"]): r for r in cmp.compare_three_axis(yields, none, some, parities).collect()}
    missing = yields.count() - some.count()
    assert rows[("benchmark_vs_aly", "all")]["n"] == 0 and rows[("benchmark_vs_aly", "all")]["rmse"] is None
    assert rows[("challenger_vs_aly", "all")]["failed_count"] == missing
    assert ("benchmark_vs_aly", "1") not in rows
    two = {(r["axis"], r["parity_group"]): r for r in cmp.compare_two_block(yields, none, parities).collect()}
    assert two[("vs_reference", "all")]["n"] == 0 and two[("vs_reference", "all")]["failed_count"] == 20
    empty = cmp.compare_two_block(none, none, parities).collect()
    assert [(r["parity_group"], r["n"], r["failed_count"]) for r in empty] == [("all", 0, 0)]


def test_busy_images_in_parts(spark):
    rows = [(4 * i, "i", 0.0, 0.0, 1.0, 1.0, 0, "cow", 0.5) for i in range(400)] + [(1, "j", 0.0, 0.0, 1.0, 1.0, 0, "cow", 0.5)]
    frame = spark.createDataFrame(rows, "det_id bigint, image_id string, x1 double, y1 double, x2 double, y2 double, class_id int, class_name string, score double")
    assert sorted((r["image_id"], r["num_predictions"]) for r in dt.det_summary(frame).collect()) == [("i", 400), ("j", 1)]
    parts = dt.det_summary(frame, max_per_row=100).collect()
    assert sum(r["num_predictions"] for r in parts) == 401 and max(r["num_predictions"] for r in parts) < 150


def test_top_per_hot_key(spark):
    rows = spark.range(5000).select((F.col("id") % 5 % 2).alias("k"), F.md5(F.col("id").cast("string")).alias("v"))
    got = {}
    for r in skew.top_per_key(rows, ["k"], [F.col("v")], 7).collect():
        got.setdefault(r["k"], []).append((r["_rank"], r["v"]))
    everything = {}
    for r in rows.collect():
        everything.setdefault(r["k"], []).append(r["v"])
    for k, values in everything.items():
        assert sorted(got[k]) == list(enumerate(sorted(values)[:7], 1))


def metric(spark, stats):
    frame = spark.createDataFrame([(json.dumps(stats) if stats is not None else None,)], "s string")
    return tuple(frame.select(fd.primary_metric(F.col("s")).alias("m")).collect()[0]["m"])


def test_primary_metric_order(spark):
    assert metric(spark, {"challenger_vs_aly": {"overall": {"rmse": 12.3}}, "overall": {"rmse": 1}}) == ("RMSE", 12.3)
    assert metric(spark, {"overall": {"pearson": 0.9}}) == ("Pearson", 0.9)
    assert metric(spark, {"vs_aly": {"overall": {"rmse": 3}}}) == ("RMSE", 3.0)
    assert metric(spark, {"overall": None}) == (None, None) and metric(spark, None) == (None, None)


def test_feed_rules(spark):
    item = "item_id string, organization_id bigint, user_id bigint, title string, created_at timestamp, status string, failed_count int"
    times = F.to_timestamp
    kinds = {
        "benchmark_challenge": spark.createDataFrame([("1", 1, 1, "A", None, "ready", 0)], item).withColumn("created_at", times(F.lit("2026-05-01 10:00:00"))),
        "benchmark_submission": spark.createDataFrame([("2", 2, 2, "B", None, "completed", 1)], item).withColumn("created_at", times(F.lit("2026-05-01 11:00:00"))),
        "herd_dataset_upload": spark.createDataFrame([("3", 1, 2, "C", None, "warning", 1)], item),
    }
    feed = fd.feed_union(kinds).withColumns({"organization_name": F.concat(F.lit("Org "), F.col("organization_id").cast("string")), "user_email": F.lit("a@b.c"), "user_name": F.lit(None).cast("string")})
    kpi = fd.feed_kpis(feed).collect()[0]
    assert (kpi["total_items"], kpi["organizations"], kpi["users"], kpi["failed_items"], kpi["herd_profiles"]) == (3, 2, 2, 2, 0)
    assert [r["item_id"] for r in fd.feed_top(feed).collect()] == ["2", "1", "3"]
    assert [r["item_id"] for r in fd.feed_filter(feed, needle="ORG 2").collect()] == ["2"]
    assert fd.feed_filter(feed, created_from="2026-01-01").count() == 2
    assert {r["item_type"]: r["count"] for r in fd.feed_by_category(feed).collect()}["herd_profile"] == 0
    assert [r["organization_id"] for r in fd.feed_by_org(feed).collect()] == [2, 1]


def test_box_formats(spark):
    frame = spark.createDataFrame([(10.0, 20.0, 100.0, 200.0)], "p double, q double, r double, s double")
    box = [F.col(c) for c in "pqrs"]
    centre = dt.box_convert(box, "xyxy", "xywh")
    assert tuple(frame.select(*[c.alias(f"c{i}") for i, c in enumerate(centre)]).collect()[0]) == (55, 110, 90, 180)
    for source in dt.BOX_FORMATS:
        for target in dt.BOX_FORMATS:
            back = dt.box_convert(dt.box_convert(box, source, target), target, source)
            assert tuple(frame.select(*[c.alias(f"c{i}") for i, c in enumerate(back)]).collect()[0]) == (10, 20, 100, 200)
    with pytest.raises(ValueError):
        dt.box_convert(box, "xyxy", "polar")


def test_detections(spark):
    rows = [(1, "i", 100.0, 50.0, 300.0, 250.0, 0, "cow", 0.95), (2, "i", 400.0, 100.0, 550.0, 300.0, 0, "cow", 0.78), (3, "j", 0.0, 0.0, 1.0, 1.0, 0, "cow", None)]
    frame = spark.createDataFrame(rows, "det_id bigint, image_id string, x1 double, y1 double, x2 double, y2 double, class_id int, class_name string, score double")
    assert {r["det_id"] for r in dt.det_filter_confidence(frame, 0.9).collect()} == {1, 3}
    one = {r["image_id"]: r for r in dt.det_summary(frame).collect()}
    assert one["i"]["labels"] == ["cow: 0.95", "cow: 0.78"] and one["i"]["num_predictions"] == 2 and one["j"]["labels"] == ["cow"]
    assert one["i"]["boxes_xywh"][0] == [200, 150, 200, 200]


@pytest.mark.parametrize("total, want", [(10, [0, 3, 6, 9]), (2, [0, 0, 0, 1]), (0, [None] * 4)])
def test_uniform_frames(spark, total, want):
    frame = spark.createDataFrame([(total,)], "n int")
    assert frame.select(dt.frame_indices(F.col("n"), 4).alias("f")).collect()[0]["f"] == want


def test_short_videos_repeat_the_last_frame(spark):
    frame = spark.createDataFrame([(2,)], "n int")
    assert frame.select(dt.frame_indices(F.col("n"), 4, strategy="consecutive").alias("f")).collect()[0]["f"] == [0, 1, 1, 1]
    drawn = frame.select(dt.frame_indices(F.lit(100), 5, strategy="random").alias("f")).collect()[0]["f"]
    assert drawn == sorted(set(drawn)) and len(drawn) == 5


def test_text(spark):
    row = spark.range(1).select(
        tx.norm_header(F.lit(" Days in-Milk (d) ")), tx.parse_number(F.lit(" 55* ")), tx.parse_number(F.lit("1.234,5")), tx.parse_number(F.lit("12d")),
        tx.norm_id(F.lit("1483.0")), tx.norm_id(F.lit(" C7 ")), tx.byte_text(F.lit(1536)), tx.byte_text(F.lit(2048)), tx.byte_text(F.lit(7)),
        tx.safe_path_part(F.lit(" a b/ ")), tx.safe_path_part(F.lit("//")), tx.weight_text(F.lit(1000.0), "lbs"), tx.weight_text(F.lit(1000.0), "kg"),
        tx.unit_label(F.lit("kg/day"), "lbs"), tx.parity_group(F.lit(None).cast("int")), tx.first_text(F.lit(""), F.lit("x")),
    ).collect()[0]
    assert tuple(row) == ("daysinmilkd", 55.0, None, None, "1483", "C7", "1.5 KB", "2 KB", "7 bytes", "a-b", "unnamed", "2,204.6", "1000.0", "lbs/day", "1", "x")

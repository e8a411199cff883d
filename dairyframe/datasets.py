"""Milk-recording views over the driver's Parquet tables.

The Spark frames and the SQL text in ``VIEWS`` define the same rows; the SQL side feeds the
side-by-side checks. ``pos`` is a total order of the records of one lactation (file order in a
real export), packed into one BIGINT so that ordered aggregates keep fixed-width buffers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

HORIZON_DAYS = 30
EVENT_START = "2024-01-01"
#: Records that one task takes of a shuffle by lactation, on average.
TASK_RECORDS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lactation_tasks(spark: SparkSession, sf_dir: str) -> int:
    """Tasks for a shuffle of all test days by lactation: in proportion to their number, and one per core at least.

    A stage that joins, groups and orders the days of a lactation then needs the same memory per task at any
    size, whatever number of shuffle partitions is set. The count comes from the Parquet footers.
    """
    records = table(spark, sf_dir, "lineitem").count()
    return max(spark.sparkContext.defaultParallelism, -(-records // TASK_RECORDS))


def testday(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One milk measurement per row: test_id, dim (1..330), milk_kg, pos."""
    c = F.col
    return table(spark, sf_dir, "lineitem").select(
        c("l_orderkey").alias("test_id"),
        (1 + (c("l_partkey") * 7 + c("l_linenumber") * 41) % 330).cast("int").alias("dim"),
        c("l_quantity").alias("milk_kg"),
        (
            c("l_linenumber").cast("bigint") * 1000000000000000000
            + c("l_partkey") * 100000
            + (c("l_suppkey") % 1000) * 100
            + c("l_quantity").cast("bigint")
        ).alias("pos"),
    )


def cow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributes of a lactation: test_id, parity (1..5), herd_id."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("test_id"),
        (1 + F.col("o_custkey") % 5).cast("int").alias("parity"),
        F.col("c_nationkey").cast("bigint").alias("herd_id"),
    )


def aly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ground-truth yields: test_id, yield_kg."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("test_id"),
        F.round(F.col("o_totalprice") / 25, 2).alias("yield_kg"),
    )


def daily_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measured days only: user_id, day (1..30), value."""
    day = F.datediff(F.col("ts"), F.lit(EVENT_START).cast("date")) + 1
    return (
        table(spark, sf_dir, "events")
        .groupBy("user_id", day.alias("day"))
        .agg(F.round(F.avg("value"), 4).alias("value"))
    )


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily sequence per user with gaps: user_id, milk ARRAY<DOUBLE> of 30 days."""
    by_day = F.map_from_entries(F.collect_list(F.struct("day", "value")))
    return (
        daily_records(spark, sf_dir)
        .groupBy("user_id")
        .agg(by_day.alias("by_day"))
        .select(
            "user_id",
            F.transform(
                F.sequence(F.lit(1), F.lit(HORIZON_DAYS)), lambda d: F.try_element_at(F.col("by_day"), d)
            ).alias("milk"),
        )
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain sequences: vec_id, label, x ARRAY<DOUBLE> (64 long)."""
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", "label", F.col("embedding").cast("array<double>").alias("x")
    )


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes on images: det_id, image_id, x1, y1, x2, y2, class_id, class_name, score (some null)."""
    e = [F.round(F.abs(F.col("x")[i]) * 1000, 3) for i in range(4)]
    return vectors(spark, sf_dir).select(
        F.col("vec_id").alias("det_id"),
        (F.col("vec_id") % 97).alias("image_id"),
        F.least(e[0], e[1]).alias("x1"),
        F.least(e[2], e[3]).alias("y1"),
        F.greatest(e[0], e[1]).alias("x2"),
        F.greatest(e[2], e[3]).alias("y2"),
        F.col("label").cast("bigint").alias("class_id"),
        F.concat(F.lit("c"), F.col("label").cast("string")).alias("class_name"),
        F.when(F.col("vec_id") % 11 != 0, F.round(F.abs(F.col("x")[4]), 4)).alias("score"),
    )


# The same views as SQL, for the side-by-side checks.
VIEWS: dict[str, str] = {
    "testday": """
        SELECT l_orderkey AS test_id,
               CAST(1 + (l_partkey * 7 + l_linenumber * 41) % 330 AS INTEGER) AS dim,
               l_quantity AS milk_kg,
               CAST(l_linenumber AS BIGINT) * 1000000000000000000 + l_partkey * 100000
                 + (l_suppkey % 1000) * 100 + CAST(l_quantity AS BIGINT) AS pos
        FROM lineitem""",
    "cow": """
        SELECT o_orderkey AS test_id, CAST(1 + o_custkey % 5 AS INTEGER) AS parity,
               CAST(c_nationkey AS BIGINT) AS herd_id
        FROM orders JOIN customer ON o_custkey = c_custkey""",
    "aly": "SELECT o_orderkey AS test_id, round(o_totalprice / 25, 2) AS yield_kg FROM orders",
    "daily_records": """
        SELECT user_id, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) + 1 AS INTEGER) AS day,
               round(avg(value), 4) AS value
        FROM events GROUP BY 1, 2""",
    "daily": """
        SELECT u.user_id, CAST(s.day AS INTEGER) AS day, r.value
        FROM (SELECT DISTINCT user_id FROM daily_records) u
        CROSS JOIN (SELECT unnest(range(1, 31)) AS day) s
        LEFT JOIN daily_records r ON r.user_id = u.user_id AND r.day = s.day""",
    "vectors": """
        SELECT vec_id, label, list_transform(embedding, lambda e: CAST(e AS DOUBLE)) AS x FROM embeddings""",
    "vecrow": """
        SELECT vec_id, label, CAST(p AS INTEGER) AS pos, x[p] AS v
        FROM vectors CROSS JOIN (SELECT unnest(range(1, 65)) AS p)""",
    "detections": """
        SELECT vec_id AS det_id, vec_id % 97 AS image_id,
               least(e1, e2) AS x1, least(e3, e4) AS y1, greatest(e1, e2) AS x2, greatest(e3, e4) AS y2,
               CAST(label AS BIGINT) AS class_id, 'c' || CAST(label AS VARCHAR) AS class_name,
               CASE WHEN vec_id % 11 <> 0 THEN round(abs(x[5]), 4) END AS score
        FROM (SELECT vec_id, label, x, round(abs(x[1]) * 1000, 3) AS e1, round(abs(x[2]) * 1000, 3) AS e2,
                     round(abs(x[3]) * 1000, 3) AS e3, round(abs(x[4]) * 1000, 3) AS e4 FROM vectors)""",
}
NEEDS = {"daily": ["daily_records"], "vecrow": ["vectors"], "detections": ["vectors"]}


def with_views(names: str, body: str, **more: str) -> str:
    """SQL text with the named views, then ``more`` named queries, then ``body``."""
    ordered: list[str] = []
    for name in names.split():
        for view in [*NEEDS.get(name, []), name]:
            if view not in ordered:
                ordered.append(view)
    parts = [f"{view} AS ({VIEWS[view]})" for view in ordered]
    parts += [f"{name} AS ({text})" for name, text in more.items()]
    return f"WITH {', '.join(parts)} {body}" if parts else body

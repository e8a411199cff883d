"""Cumulative yields by the three trapezoid rules, and per-lactation summaries near fixed days.

Every operator starts with :func:`collapse_days`. It reduces the records of a lactation to one row
per day with partial aggregation before the shuffle, so a lactation that holds a large share of all
records reaches the per-lactation stage with no more rows than it has days. Repeated days stay
exact: between two records of one day the trapezoid has zero width, so only the first record of
the day (entered from the left) and the last (left to the right) matter.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

HORIZON = 305
# Target days and half-widths of the early and the peak sample.
NEAR_DAYS = {"near_21": (21, 7), "near_75": (75, 10)}


def collapse_days(
    df: DataFrame, *, order: str = "pos", keys: Sequence[str] = ("test_id",)
) -> DataFrame:
    """One row per lactation and day: n, first_milk and last_milk by ``order``, sum_milk."""
    return df.groupBy(*keys, "dim").agg(
        F.count(F.lit(1)).alias("n"),
        F.min_by("milk_kg", order).alias("first_milk"),
        F.max_by("milk_kg", order).alias("last_milk"),
        F.sum("milk_kg").alias("sum_milk"),
    )


def test_interval_yield(df: DataFrame, *, max_dim: int = HORIZON, order: str = "pos") -> DataFrame:
    """Test-interval method: test_id, yield_kg.

    First yield times first day, trapezoids between test days, last yield out to ``max_dim + 1``.
    Lactations with fewer than two records up to ``max_dim`` give no row; repeated days are kept;
    trapezoids with a missing yield are skipped. Negative yields are not filtered here.
    """
    days = collapse_days(df.filter(F.col("dim") <= max_dim), order=order)
    in_order = Window.partitionBy("test_id").orderBy("dim")
    width = F.lead("dim").over(in_order) - F.col("dim")
    height = (F.col("last_milk") + F.lead("first_milk").over(in_order)) / 2
    first_day, last_day = F.min("dim"), F.max("dim")
    return (
        days.withColumn("area", width * height)
        .groupBy("test_id")
        .agg(
            F.sum("n").alias("n"),
            (
                first_day * F.min_by("first_milk", "dim")
                + F.coalesce(F.sum("area"), F.lit(0.0))
                + (max_dim + 1 - last_day) * F.max_by("last_milk", "dim")
            ).alias("yield_kg"),
        )
        .filter(F.col("n") >= 2)
        .select("test_id", "yield_kg")
    )


test_interval_yield.__test__ = False


def first_last_record(df: DataFrame, *, order: str = "pos") -> DataFrame:
    """First and last record of each lactation by (dim, order)."""
    return (
        collapse_days(df, order=order)
        .groupBy("test_id")
        .agg(
            F.min("dim").alias("first_dim"),
            F.min_by("first_milk", "dim").alias("first_milk"),
            F.max("dim").alias("last_dim"),
            F.max_by("last_milk", "dim").alias("last_milk"),
        )
    )


def _segment_area(start: Column, start_milk: Column, end: Column, end_milk: Column) -> Column:
    return (start_milk + end_milk) / 2 * (end - start)


def lactation_profile(df: DataFrame, *, keys: Sequence[str] = ("test_id",), cap: int = HORIZON) -> DataFrame:
    """Everything the herd statistics need from one lactation, in one pass over its days.

    observed: trapezoids from (0, 0) over days > 0, no tail; capped: the same stopped at ``cap``
    (straddling segment cut by linear interpolation, or the last yield held to ``cap``); both null
    with fewer than two usable records. near_21, near_75: mean yield in the window, else the
    nearest record within three windows. mean_dim: mean day. Records of one day are ordered by yield.
    """
    days = collapse_days(df, order="milk_kg", keys=keys)
    usable = F.col("dim") > 0
    # One window over all days keeps the shuffle of the final grouping; days <= 0 come first and count
    # as the start (0, 0).
    in_order = Window.partitionBy(*keys).orderBy("dim")
    after_start = F.lag("dim").over(in_order) > 0
    prev_day = F.when(after_start, F.lag("dim").over(in_order)).otherwise(0)
    prev_milk = F.when(after_start, F.lag("last_milk").over(in_order)).otherwise(0.0)
    day, milk = F.col("dim"), F.col("first_milk")
    milk_at_cap = prev_milk + (cap - prev_day) / (day - prev_day) * (milk - prev_milk)
    days = days.select(
        *keys,
        "dim",
        "n",
        "first_milk",
        "last_milk",
        "sum_milk",
        F.when(usable, _segment_area(prev_day, prev_milk, day, milk)).alias("area"),
        F.when(usable & (day <= cap), _segment_area(prev_day, prev_milk, day, milk))
        .when(usable & (prev_day < cap), _segment_area(prev_day, prev_milk, F.lit(cap), milk_at_cap))
        .alias("capped_area"),
    )
    last_day = F.max(F.when(usable, day))
    tail = F.when(last_day < cap, F.max_by("last_milk", "dim") * (cap - last_day)).otherwise(F.lit(0.0))
    enough = F.sum(F.when(usable, F.col("n"))) >= 2
    near = [_near(target, window).alias(name) for name, (target, window) in NEAR_DAYS.items()]
    return days.groupBy(*keys).agg(
        F.sum("n").alias("n"),
        F.when(enough, F.sum("area")).alias("observed"),
        F.when(enough, F.sum("capped_area") + tail).alias("capped"),
        (F.sum(day * F.col("n")) / F.sum("n")).alias("mean_dim"),
        *near,
    )


def _near(target: int, window: int) -> Column:
    distance = F.abs(F.col("dim") - target)
    inside = distance <= window
    # One BIGINT orders by distance, then day; the day's smallest yield settles the rest.
    nearness = distance.cast("bigint") * (1 << 33) + F.col("dim")
    nearest = F.when(F.min(distance) <= 3 * window, F.min_by("first_milk", nearness))
    return F.coalesce(F.sum(F.when(inside, F.col("sum_milk"))) / F.sum(F.when(inside, F.col("n"))), nearest)


def trapezoid_observed(df: DataFrame) -> DataFrame:
    """Yield over the observed range only: test_id, yield_kg (null with fewer than two usable days)."""
    return lactation_profile(df).select("test_id", F.col("observed").alias("yield_kg"))


def trapezoid_capped(df: DataFrame, *, cap: int = HORIZON) -> DataFrame:
    """Yield up to ``cap`` days: test_id, yield_kg."""
    return lactation_profile(df, cap=cap).select("test_id", F.col("capped").alias("yield_kg"))


def argmax_day(df: DataFrame, *, day: str = "dim", value: str = "milk_kg") -> DataFrame:
    """First day of the highest yield per lactation: test_id, peak_day, peak_kg."""
    return (
        df.groupBy("test_id", day)
        .agg(F.max(value).alias("_top"))
        .groupBy("test_id")
        .agg(
            F.min_by(day, F.struct(-F.col("_top"), F.col(day))).alias("peak_day"),
            F.max("_top").alias("peak_kg"),
        )
    )

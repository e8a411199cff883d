"""Agreement of yield sets: statistics per axis and parity group, cohort and report tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from dairyframe.functions.text import parity_group
from dairyframe.session import scratch_path

AXES = ("challenger_vs_aly", "benchmark_vs_aly", "challenger_vs_benchmark")
# The margins of a report scatter around its smallest and largest value.
AXIS_LOW, AXIS_HIGH = 0.97, 1.03


def stats_columns(a: str = "a_kg", b: str = "b_kg") -> list[Column]:
    """Pearson, RMSE, MAE, MAPE (percent) and n of pairs (a, b).

    Pearson is null with fewer than two pairs or a constant side. Pairs with b = 0 add nothing to
    MAPE but stay in its denominator. A row that lacks a side is no pair.
    """
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    x, y = F.when(both, F.col(a)), F.when(both, F.col(b))
    n = F.count(x)
    varied = (n >= 2) & (F.min(x) != F.max(x)) & (F.min(y) != F.max(y))
    # corr() divides by zero on a constant side before the guard can drop the result
    pearson = F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
    relative = F.when(both, F.when(y != 0, F.abs((y - x) / y)).otherwise(F.lit(0.0)))
    return [
        F.when(varied, F.round(pearson, 6)).alias("pearson"),
        F.round(F.sqrt(F.avg((y - x) * (y - x))), 3).alias("rmse"),
        F.round(F.avg(F.abs(y - x)), 3).alias("mae"),
        F.round(F.avg(relative) * 100, 3).alias("mape"),
        n.alias("n"),
    ]


def compare_stats(pairs: DataFrame) -> DataFrame:
    """One row of statistics over all pairs."""
    return pairs.agg(*stats_columns())


def compare_by_parity(pairs: DataFrame, *, by: tuple[str, ...] = ()) -> DataFrame:
    """Statistics overall (parity_group 'all') and per parity group; a missing parity counts as 1."""
    grouped = pairs.withColumn("parity_group", parity_group(F.col("parity")))
    keys = [F.col(k) for k in by]
    sets = [keys, [*keys, F.col("parity_group")]]
    out = grouped.groupingSets(sets, *by, "parity_group").agg(
        F.grouping("parity_group").alias("_all"), *stats_columns()
    )
    label = F.when(F.col("_all") == 1, "all").otherwise(F.col("parity_group"))
    return out.withColumn("parity_group", label).drop("_all")


def align_yields(sets: dict[str, DataFrame], parities: DataFrame) -> DataFrame:
    """One row per id with one yield column per set and its parity, in a single shuffle.

    The sets are unioned and pivoted by a grouped aggregate instead of chained outer joins. Each set
    holds an id at most once. Ids known only by their parity are left out.
    """
    tagged = None
    for name, frame in sets.items():
        part = frame.select("test_id", F.lit(name).alias("_set"), F.col("yield_kg").cast("double").alias("_kg"))
        tagged = part if tagged is None else tagged.unionByName(part)
    attrs = parities.select("test_id", F.col("parity").cast("int").alias("_parity"))
    every = tagged.unionByName(attrs, allowMissingColumns=True)
    picked = [F.max(F.when(F.col("_set") == name, F.col("_kg"))).alias(name) for name in sets]
    wide = every.groupBy("test_id").agg(*picked, F.max("_parity").alias("parity"), F.count("_set").alias("_n"))
    return wide.filter(F.col("_n") > 0).drop("_n")


def compare_axes(
    aligned: DataFrame, axes: dict[str, tuple[str, str]], *, submitted: str, required: str
) -> DataFrame:
    """Statistics per axis, overall and per parity group, with the count of failed ids.

    ``failed_count``, on the overall rows, counts the ids with a ``submitted`` yield and no ``required`` one. An axis
    without a pair keeps its overall row, with n = 0.
    """
    failed = F.col(submitted).isNotNull() & F.col(required).isNull()
    entries = [F.struct(F.lit(axis).alias("axis"), F.col(a).alias("a_kg"), F.col(b).alias("b_kg")) for axis, (a, b) in axes.items()]
    rows = aligned.select("parity", failed.cast("int").alias("_failed"), F.inline(F.array(*entries)))
    # one row without yields per axis, so that every axis appears
    spark = aligned.sparkSession
    empty = spark.range(1).select(F.explode(F.array(*[F.lit(axis) for axis in axes])).alias("axis"), F.lit(0).alias("_failed"))
    grouped = rows.unionByName(empty, allowMissingColumns=True).withColumn("parity_group", parity_group(F.col("parity")))
    out = grouped.groupingSets([[F.col("axis")], [F.col("axis"), F.col("parity_group")]], "axis", "parity_group").agg(
        F.grouping("parity_group").alias("_all"), *stats_columns(), F.sum("_failed").alias("failed_count")
    )
    overall = F.col("_all") == 1
    named = out.withColumns(
        {
            "parity_group": F.when(overall, "all").otherwise(F.col("parity_group")),
            "failed_count": F.when(overall, F.col("failed_count")),
        }
    )
    return named.filter(overall | (F.col("n") > 0)).drop("_all")


def axis_pairs(aligned: DataFrame, axes: dict[str, tuple[str, str]]) -> DataFrame:
    """Long form (test_id, parity, axis, a_kg, b_kg) of every axis where both yields exist."""
    entries = [
        F.struct(F.lit(axis).alias("axis"), F.col(a).alias("a_kg"), F.col(b).alias("b_kg"))
        for axis, (a, b) in axes.items()
    ]
    long = aligned.select("test_id", "parity", F.inline(F.array(*entries)))
    return long.filter(F.col("a_kg").isNotNull() & F.col("b_kg").isNotNull())


THREE_AXES = {
    "challenger_vs_aly": ("challenger", "aly"),
    "benchmark_vs_aly": ("benchmark", "aly"),
    "challenger_vs_benchmark": ("challenger", "benchmark"),
}
TWO_AXES = {"vs_reference": ("submitted", "reference"), "vs_aly": ("submitted", "aly")}


def compare_three_axis(
    challenger: DataFrame, benchmark: DataFrame, truth: DataFrame, parities: DataFrame
) -> DataFrame:
    """Statistics for the three axes overall and per parity group; a challenger's id without ground truth has failed."""
    aligned = align_yields({"challenger": challenger, "benchmark": benchmark, "aly": truth}, parities)
    return compare_axes(aligned, THREE_AXES, submitted="challenger", required="aly")


def compare_two_block(
    submitted: DataFrame, reference: DataFrame, parities: DataFrame, truth: DataFrame | None = None
) -> DataFrame:
    """The older form: submitted against a reference, and against ground truth when given.

    A submitted id that the reference lacks has failed.
    """
    sets = {"submitted": submitted, "reference": reference}
    axes = {"vs_reference": TWO_AXES["vs_reference"]}
    if truth is not None:
        sets["aly"] = truth
        axes = TWO_AXES
    return compare_axes(align_yields(sets, parities), axes, submitted="submitted", required="reference")


def failed_count(submitted: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: submitted ids without ground truth."""
    missing = submitted.select("test_id").join(truth.select("test_id"), "test_id", "left_anti")
    return missing.agg(F.count(F.lit(1)).alias("failed_count"))


def report_pairs(
    challenger: DataFrame, benchmark: DataFrame, truth: DataFrame, parities: DataFrame
) -> DataFrame:
    """Scatter points per axis and parity group with their axis limits and counts.

    The points are written once; the limits, one row per axis and group (at most twelve, hence the broadcast), are taken from what
    was written, so the yield sets are aligned once.
    """
    aligned = align_yields({"challenger": challenger, "benchmark": benchmark, "aly": truth}, parities)
    points = axis_pairs(aligned, THREE_AXES).withColumn("parity_group", parity_group(F.col("parity")))
    points = points.select("axis", "parity_group", "test_id", "a_kg", "b_kg")
    spark = points.sparkSession
    path = scratch_path(spark, "report-pairs")
    points.write.parquet(path)
    points = spark.read.schema(points.schema).parquet(path)
    limits = points.groupBy("axis", "parity_group").agg(
        (F.min(F.least("a_kg", "b_kg")) * AXIS_LOW).alias("axis_low"),
        (F.max(F.greatest("a_kg", "b_kg")) * AXIS_HIGH).alias("axis_high"),
        F.count(F.lit(1)).alias("evaluated"),
    )
    return points.join(F.broadcast(limits), ["axis", "parity_group"]).select(
        "axis", "parity_group", "test_id", "a_kg", "b_kg", "axis_low", "axis_high", "evaluated"
    )


def cohort_summary(records: DataFrame, lactations: DataFrame, truth: DataFrame) -> DataFrame:
    """Counts of a cohort as (measure, n): records, lactations, yields, herds (null if none), and
    one ``parity:<p>`` row per parity with ``parity:unknown`` for missing ones.

    Each table is read once: lactations shrink to one row per parity and herd, from which grouping sets give the parities,
    the distinct herds and the total; everything meets in one sum per measure.
    """
    label = F.concat(F.lit("parity:"), F.coalesce(F.col("parity").cast("string"), F.lit("unknown")))
    cells = lactations.groupBy(label.alias("_parity"), "herd_id").agg(F.count(F.lit(1)).alias("_n"))
    sets = cells.groupingSets([["_parity"], ["herd_id"], []], "_parity", "herd_id").agg(
        F.sum("_n").alias("_n"), F.grouping_id().alias("_set")
    )
    is_parity, is_herd = F.col("_set") == 1, F.col("_set") == 2
    counted = sets.select(
        F.when(is_parity, F.col("_parity")).when(is_herd, "herds").otherwise("lactations").alias("measure"),
        F.when(is_herd, F.col("herd_id").isNotNull().cast("long")).otherwise(F.col("_n")).alias("n"),
    )
    one = F.lit(1).cast("long").alias("n")
    # the four totals appear even where a table is empty
    always = records.sparkSession.range(1).select(
        F.explode(F.array(*[F.lit(m) for m in ("records", "lactations", "yields", "herds")])).alias("measure"), F.lit(0).cast("long").alias("n")
    )
    every = counted.unionByName(records.select(F.lit("records").alias("measure"), one)).unionByName(truth.select(F.lit("yields").alias("measure"), one))
    summed = every.unionByName(always).groupBy("measure").agg(F.sum("n").alias("n"))
    return summed.select("measure", F.when((F.col("measure") != "herds") | (F.col("n") > 0), F.col("n")).alias("n"))


def label_counts(df: DataFrame, label: str = "label") -> DataFrame:
    """Items per label; a missing label counts as 'unknown'."""
    text = F.coalesce(F.col(label).cast("string"), F.lit("unknown"))
    return df.groupBy(text.alias("label")).agg(F.count(F.lit(1)).alias("n"))

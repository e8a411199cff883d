"""Herd statistics: the ten canonical numbers, their ranges, and the ones test days can derive."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from dairyframe.operators.yields import lactation_profile

# Canonical statistic names in order, with the range that maps each to 0..1.
STAT_RANGES: dict[str, tuple[float, float]] = {
    "Achieved21Milk": (0.0, 50.0),
    "Achieved305Milk": (3000.0, 15000.0),
    "Achieved75Milk": (0.0, 50.0),
    "AchievedMilk": (3000.0, 20000.0),
    "DaysDry": (0.0, 150.0),
    "DaysInMilk": (0.0, 600.0),
    "DaysOpen": (0.0, 300.0),
    "DaysPregnant": (0.0, 283.0),
    "HistoricCalvingInterval": (300.0, 600.0),
    "QualitySequence": (0.0, 1.0),
}
STAT_NAMES = list(STAT_RANGES)
DIRECT_SHARE = 0.8
DROPPED_SHARE = 0.2


def near_dim_mean(df: DataFrame, which: str = "near_21") -> DataFrame:
    """Mean over lactations of the yield near day 21 or 75: one row (mean_kg, lactations)."""
    return lactation_profile(df).agg(
        F.avg(which).alias("mean_kg"), F.count(which).alias("lactations")
    )


def latest_direct_value(df: DataFrame, *, value: str = "direct_kg", order: str = "pos") -> DataFrame:
    """Last positive direct 305-day value per lactation in file order: test_id, direct_kg."""
    positive = F.col(value) > 0
    return df.groupBy("test_id").agg(
        F.max_by(F.when(positive, F.col(value)), F.when(positive, F.col(order))).alias("direct_kg")
    )


def mode_parity(cows: DataFrame, *, order: str = "test_id") -> DataFrame:
    """Most frequent parity over lactations, the one seen first on ties: one row (parity)."""
    return (
        cows.filter(F.col("parity").isNotNull())
        .groupBy("parity")
        .agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("seen"))
        .agg(F.max_by("parity", F.struct(F.col("n"), -F.col("seen"))).alias("parity"))
    )


def herd_stats_summary(
    df: DataFrame,
    lactations: DataFrame | None = None,
    *,
    by: Sequence[str] = (),
    parity: int | None = None,
) -> DataFrame:
    """The five derivable statistics and warning flags per herd or slice.

    ``lactations`` carries the grouping columns per test_id, and optionally ``direct_kg`` and
    ``parity``. Direct 305-day values are used when at least max(1, int(0.8 n)) lactations have one.
    The join keeps one row per lactation on both sides, after the records have been aggregated.
    """
    profile = lactation_profile(df.filter(F.col("milk_kg") >= 0))
    if lactations is not None:
        profile = profile.join(lactations, "test_id")
    if parity is not None:
        profile = profile.filter(F.col("parity") == parity)
    if "direct_kg" not in profile.columns:
        profile = profile.withColumn("direct_kg", F.lit(None).cast("double"))
    n, direct, capped = F.count(F.lit(1)), F.count("direct_kg"), F.count("capped")
    use_direct = direct >= F.greatest(F.lit(1), F.floor(n * DIRECT_SHARE))
    return profile.groupBy(*by).agg(
        n.alias("lactations"),
        F.avg("near_21").alias("Achieved21Milk"),
        F.when(use_direct, F.avg("direct_kg")).otherwise(F.avg("capped")).alias("Achieved305Milk"),
        F.avg("near_75").alias("Achieved75Milk"),
        F.avg("observed").alias("AchievedMilk"),
        F.avg("mean_dim").alias("DaysInMilk"),
        use_direct.alias("direct_305"),
        (F.count("near_21") == 0).alias("no_day_21"),
        (F.count("near_75") == 0).alias("no_day_75"),
        (~use_direct & (capped == 0)).alias("no_305"),
        (~use_direct & (capped > 0) & ((n - capped) / n > DROPPED_SHARE)).alias("many_dropped"),
    )


def range_normalize(name: str, raw: Column, *, clamp: bool = True) -> Column:
    """One statistic to 0..1 by its fixed range; a missing value stays missing."""
    lo, hi = STAT_RANGES[name]
    if hi <= lo:
        return F.when(raw.isNotNull(), F.lit(0.0))
    # greatest/least skip nulls, so the null has to be kept by hand.
    bounded = F.when(raw.isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), raw))) if clamp else raw
    return (bounded - lo) / (hi - lo)


def range_denormalize(name: str, value: Column) -> Column:
    lo, hi = STAT_RANGES[name]
    return value * (hi - lo) + lo


def normalize_stats(df: DataFrame, *, require_all: bool = False, clamp: bool = True) -> DataFrame:
    """Replace the statistic columns present by their 0..1 form; optionally insist on all ten."""
    present = [name for name in STAT_NAMES if name in df.columns]
    if require_all and len(present) < len(STAT_NAMES):
        missing = [name for name in STAT_NAMES if name not in present]
        raise ValueError(f"missing herd statistics: {', '.join(missing)}")
    return df.withColumns({name: range_normalize(name, F.col(name), clamp=clamp) for name in present})


def denormalize_stats(df: DataFrame) -> DataFrame:
    present = [name for name in STAT_NAMES if name in df.columns]
    return df.withColumns({name: range_denormalize(name, F.col(name)) for name in present})


def stats_vector(stats: Column) -> Column:
    """A MAP<STRING, DOUBLE> of statistics to the ten-slot array, missing names 0."""
    return F.array(*[F.coalesce(F.try_element_at(stats, F.lit(name)), F.lit(0.0)) for name in STAT_NAMES])


def checked_vector(values: Column) -> Column:
    """An array already in canonical order; a wrong length gives ten zeros."""
    right = F.size(values) == len(STAT_NAMES)
    return F.when(right, values).otherwise(F.array_repeat(F.lit(0.0), len(STAT_NAMES)))


def column_means(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean per already-numeric column ignoring nulls, with the count of bad cells."""
    return df.agg(
        *[F.avg(c).alias(c) for c in columns],
        *[F.count_if(F.col(c).isNull()).alias(f"{c}_bad") for c in columns],
    )


def in_unit_range(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Fail the job when a normalised profile value leaves 0..1."""
    checks = [F.assert_true((F.col(c) >= 0) & (F.col(c) <= 1), f"{c} outside 0..1").isNull() for c in columns]
    ok = checks[0]
    for check in checks[1:]:
        ok = ok & check
    return df.filter(ok)


#: What a report says about each flag of the summary; text of our own.
WARNINGS = {
    "no_day_21": "No record near day 21; Achieved21Milk is unknown.",
    "no_day_75": "No record near day 75; Achieved75Milk is unknown.",
    "no_305": "No lactation long enough for a 305-day value.",
    "many_dropped": "More than a fifth of the lactations have too few records for a 305-day value.",
}


def upload_report(parsed: DataFrame) -> DataFrame:
    """One row about an upload of parsed test days (``files.parse_test_day``): what was read, kept and left out, and what it shows.

    row_count, other_events, rejected, ``reasons`` MAP<STRING, BIGINT>, usable, lactations, detected_parity (the most frequent, on ties the
    one seen first), the five statistics, and ``warnings`` ARRAY<STRING>. The rows are counted by event and reason, and
    reduced to days and lactations, with partial sums before each shuffle. An upload without a usable row
    has null statistics and says so.
    """
    usable = parsed.filter(F.col("event_ok") & F.col("reject_reason").isNull())
    kinds = parsed.groupBy("event_ok", "reject_reason").agg(F.count(F.lit(1)).alias("n"))
    bad = F.col("event_ok") & F.col("reject_reason").isNotNull()
    counted = kinds.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"),
        F.coalesce(F.sum(F.when(~F.col("event_ok"), F.col("n"))), F.lit(0)).alias("other_events"),
        F.coalesce(F.sum(F.when(bad, F.col("n"))), F.lit(0)).alias("rejected"),
        F.map_from_entries(F.array_sort(F.collect_list(F.when(bad, F.struct("reject_reason", "n"))))).alias("reasons"),
    )
    parity_ok = F.col("parity") > 0
    parities = usable.groupBy("test_id").agg(
        F.min_by(F.when(parity_ok, F.col("parity")), F.when(parity_ok, F.col("pos"))).alias("parity"), F.min("pos").alias("seen")
    )
    mode = mode_parity(parities, order="seen").select(F.col("parity").alias("detected_parity"), F.lit(1).alias("one"))
    stats = herd_stats_summary(usable).withColumn("one", F.lit(1))
    # each side is one row by its making, a global aggregate
    row = counted.withColumn("one", F.lit(1)).join(F.broadcast(mode), "one", "left").join(F.broadcast(stats), "one", "left")
    lines = [F.when(F.col("lactations") == 0, "No usable record.")]
    lines += [F.when((F.col("lactations") > 0) & F.col(flag), text) for flag, text in WARNINGS.items()]
    lines.append(F.when(F.col("rejected") > 0, F.concat(F.col("rejected").cast("string"), F.lit(" rows could not be used."))))
    warnings = F.filter(F.array(*lines), lambda w: w.isNotNull())
    usable_rows = (F.col("row_count") - F.col("other_events") - F.col("rejected")).alias("usable")
    five = ["Achieved21Milk", "Achieved305Milk", "Achieved75Milk", "AchievedMilk", "DaysInMilk"]
    return row.select("row_count", "other_events", "rejected", "reasons", usable_rows, "lactations", "detected_parity", *five, warnings.alias("warnings"))

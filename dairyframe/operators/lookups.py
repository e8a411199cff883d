"""Joins between cohorts and yield sets, and fallback lookups."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from dairyframe.operators.skew import join_lookup

# Published prior mean and standard deviation per parity group 1, 2, 3 and later.
PRIORS: dict[int, dict[str, tuple[float, float]]] = {
    1: {"scale": (34.11, 7.0), "ramp": (29.96, 3.0), "decay": (0.001835, 0.000738), "offset": (-0.5, 0.02)},
    2: {"scale": (44.26, 9.57), "ramp": (22.52, 3.0), "decay": (0.002745, 0.000979), "offset": (-0.78, 0.07)},
    3: {"scale": (48.41, 10.66), "ramp": (22.54, 8.724), "decay": (0.002997, 0.000972), "offset": (0.0, 0.03)},
}
SE_MILK = 4.0
PRIOR_NAMES = ("scale", "ramp", "decay", "offset")


def common_ids(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs of two yield sets on shared ids: test_id, a_kg, b_kg."""
    left = a.select("test_id", F.col("yield_kg").alias("a_kg"))
    right = b.select("test_id", F.col("yield_kg").alias("b_kg"))
    return left.join(right, "test_id")


def ids_without(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct ids of ``a`` that ``b`` lacks."""
    return a.select("test_id").join(b.select("test_id"), "test_id", "left_anti").distinct()


def shared_and_single_ids(a: DataFrame, b: DataFrame) -> DataFrame:
    """Every id of either set with the side it is on: 'both', 'left' or 'right'.

    One union and one grouped aggregate give the intersection and both differences together.
    """
    tagged = a.select("test_id", F.lit(1).alias("side")).unionByName(b.select("test_id", F.lit(2).alias("side")))
    side = F.bit_or("side")
    return tagged.groupBy("test_id").agg(
        F.when(side == 3, "both").when(side == 1, "left").otherwise("right").alias("side")
    )


def with_owner(records: DataFrame, users: DataFrame, organizations: DataFrame) -> DataFrame:
    """Records with user and organization names, both optional.

    ``users``: user_id, user_name, user_email; ``organizations``: organization_id, organization_name.
    One user or organization may own a large share of the records, hence the balanced lookups.
    """
    named = join_lookup(records, users, ["user_id"])
    return join_lookup(named, organizations, ["organization_id"])


def members_of(memberships: DataFrame, users: DataFrame, organizations: DataFrame) -> DataFrame:
    """One row per membership with both names, inner on both sides."""
    named = join_lookup(memberships, users, ["user_id"], "inner")
    return join_lookup(named, organizations, ["organization_id"], "inner")


def memberships_per_user(members: DataFrame) -> DataFrame:
    """Memberships of each user as an array ordered by organization name.

    The array is no longer than the number of organizations, since a pair occurs once.
    """
    entry = F.struct("organization_name", "role")
    return members.groupBy("user_id", "user_name").agg(F.array_sort(F.collect_set(entry)).alias("memberships"))


def as_int(c: Column) -> Column:
    """Optional id as BIGINT, through its number form; null when unreadable."""
    return c.cast("string").try_cast("double").try_cast("bigint")


def hierarchical_stats(
    records: DataFrame,
    per_herd_parity: DataFrame,
    per_herd: DataFrame,
    per_parity: DataFrame,
    overall: Mapping[str, float],
) -> DataFrame:
    """Statistics by (herd, parity), else herd, else parity, else global, plus the level used.

    ``records``: herd_id and parity of any type, optionally ``stats`` (kept when given, level 0).
    The tables carry ``stats MAP<STRING, DOUBLE>`` unique per key. A herd or parity may hold a large
    share of the records, hence the balanced lookups.
    """
    keyed = records.withColumns({"_h": as_int(F.col("herd_id")), "_p": as_int(F.col("parity"))})
    given = F.col("stats") if "stats" in records.columns else F.lit(None).cast("map<string,double>")
    keyed = keyed.withColumn("_given", given).drop("stats")
    pair = per_herd_parity.select(
        F.col("herd_id").cast("bigint").alias("_h"), F.col("parity").cast("bigint").alias("_p"), F.col("stats").alias("_s1")
    )
    herd = per_herd.select(F.col("herd_id").cast("bigint").alias("_h"), F.col("stats").alias("_s2"))
    parity = per_parity.select(F.col("parity").cast("bigint").alias("_p"), F.col("stats").alias("_s3"))
    joined = join_lookup(keyed, pair, ["_h", "_p"])
    joined = join_lookup(join_lookup(joined, herd, ["_h"]), parity, ["_p"])
    fallback = F.create_map(*[F.lit(x) for item in overall.items() for x in item])
    level = (
        F.when(F.col("_given").isNotNull(), 0)
        .when(F.col("_s1").isNotNull(), 1)
        .when(F.col("_s2").isNotNull(), 2)
        .when(F.col("_s3").isNotNull(), 3)
        .otherwise(4)
    )
    stats = F.coalesce("_given", "_s1", "_s2", "_s3", fallback)
    return joined.withColumns({"stats": stats, "stats_level": level}).drop("_h", "_p", "_given", "_s1", "_s2", "_s3")


def event_tokens(events: Column, dictionary: Mapping[str, int], *, unknown: str = "unknown") -> Column:
    """Event texts to indices, any case; null and unseen texts to the unknown index.

    Without an ``unknown`` entry the unknown index is the dictionary size.
    """
    fallback = F.lit(dictionary.get(unknown, len(dictionary)))
    if not dictionary:
        return F.transform(events, lambda _: fallback)
    literal = F.create_map(*[F.lit(x) for item in dictionary.items() for x in item])
    return F.transform(events, lambda e: F.coalesce(F.try_element_at(literal, F.lower(e)), fallback))


def curve_value(curve: Sequence[float], day: Column, *, first_day: int = 0) -> Column:
    """Expected yield of a day from a fixed-length curve; null outside it."""
    values = F.array(*[F.lit(float(v)) for v in curve])
    slot = day.cast("int") - first_day + 1
    return F.when(slot >= 1, F.try_element_at(values, slot))


def priors(parity: Column) -> list[Column]:
    """Prior columns ``scale_mean, scale_sd, ...`` and se_milk for a parity (3 and later share)."""
    columns = []
    for name in PRIOR_NAMES:
        for i, kind in enumerate(("mean", "sd")):
            value = F.when(parity == 1, PRIORS[1][name][i]).when(parity == 2, PRIORS[2][name][i])
            columns.append(value.otherwise(PRIORS[3][name][i]).alias(f"{name}_{kind}"))
    return [*columns, F.lit(SE_MILK).alias("se_milk")]

"""Lists, search and the activity feed over records of several kinds."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

# Record kinds with their display labels, in display order.
CATEGORIES: dict[str, str] = {
    "benchmark_submission": "Benchmark submission",
    "benchmark_challenge": "Benchmark challenge",
    "herd_dataset_upload": "Herd dataset upload",
    "herd_profile": "Herd profile",
}
GOOD_STATUS = ("ready", "completed")
SEARCH_FIELDS = (
    "title", "item_type_label", "organization_name", "user_email", "user_name", "status", "source",
    "submission_type", "benchmark_model",
)
SORTS = ("created_at", "organization", "user", "category", "status")
ADMIN, OWNER = "admin", "owner"


def list_filter_sort(
    df: DataFrame,
    *,
    organization_id: int | None = None,
    user_id: int | None = None,
    contains: str | None = None,
    sort: str = "created_at",
    direction: str = "desc",
    tie: str = "record_id",
    limit: int | None = None,
) -> DataFrame:
    """A list view: filter by organization and user, ``contains`` on the name (case-sensitive), in
    order of one sort key; ``limit`` keeps the first rows only where it is asked for. ``tie`` makes the order total."""
    if organization_id is not None:
        df = df.filter(F.col("organization_id") == organization_id)
    if user_id is not None:
        df = df.filter(F.col("user_id") == user_id)
    if contains:
        df = df.filter(F.col("name").contains(contains))
    keys = {"created_at": F.col("created_at"), "name": F.col("name"), "user": F.col("user_name")}
    if sort not in keys:
        raise ValueError(f"sort must be one of {', '.join(keys)}")
    key = keys[sort].asc() if direction == "asc" else keys[sort].desc()
    ordered = df.orderBy(key, tie)
    return ordered if limit is None else ordered.limit(limit)


def list_page(
    df: DataFrame, *, model: str | None = None, source: str | None = None, limit: int, offset: int = 0, tie: str = "record_id"
) -> DataFrame:
    """One page, newest first, optionally of one model and source."""
    if model is not None:
        df = df.filter(F.col("model") == model)
    if source is not None:
        df = df.filter(F.col("source") == source)
    return df.orderBy(F.desc("created_at"), tie).offset(offset).limit(limit)


def search_users(users: DataFrame, needle: str) -> DataFrame:
    """Case-blind part of e-mail or name, ordered by e-mail, name, id. ``%`` and ``_`` are wildcards."""
    pattern = f"%{needle}%"
    found = users.filter(F.col("user_email").ilike(pattern) | F.col("user_name").ilike(pattern))
    return found.orderBy("user_email", "user_name", "user_id")


def is_problem(failed: Column, status: Column) -> Column:
    """Anything failed, or a status that is not a good one."""
    return (failed > 0) | ~status.isin(*GOOD_STATUS)


def upload_status(warnings: Column) -> Column:
    return F.when(F.coalesce(warnings, F.lit(0)) > 0, "warning").otherwise("ready")


def primary_metric(stats: Column) -> Column:
    """STRUCT<label, value> from nested comparison statistics as JSON text: RMSE, else Pearson.

    The block is the first object among challenger_vs_aly, overall and vs_aly.overall; its ``overall``
    when it has one, else the block itself.
    """

    def block(path: str) -> Column:
        found = F.get_json_object(stats, path)
        return F.when(F.substring(found, 1, 1) == "{", found)

    first = F.coalesce(block("$.challenger_vs_aly"), block("$.overall"), block("$.vs_aly.overall"))
    inner = F.coalesce(F.get_json_object(first, "$.overall"), first)
    rmse = F.get_json_object(inner, "$.rmse").try_cast("double")
    pearson = F.get_json_object(inner, "$.pearson").try_cast("double")
    label = F.when(rmse.isNotNull(), "RMSE").when(pearson.isNotNull(), "Pearson")
    return F.struct(label.alias("label"), F.coalesce(rmse, pearson).alias("value"))


def feed_union(kinds: Mapping[str, DataFrame]) -> DataFrame:
    """One feed of several record kinds; columns a kind lacks are null.

    Adds item_type, item_type_label and problem.
    """
    unknown = set(kinds) - set(CATEGORIES)
    if unknown:
        raise ValueError(f"unknown record kinds: {', '.join(sorted(unknown))}")
    parts = [
        df.withColumns({"item_type": F.lit(kind), "item_type_label": F.lit(CATEGORIES[kind])}) for kind, df in kinds.items()
    ]
    feed = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return feed.withColumn("problem", is_problem(F.coalesce("failed_count", F.lit(0)), F.col("status")))


def feed_filter(
    feed: DataFrame,
    *,
    organization_id: int | None = None,
    category: str | None = None,
    user_id: int | None = None,
    needle: str | None = None,
    created_from: str | None = None,
    created_to: str | None = None,
) -> DataFrame:
    """Filters of the feed; the search is case-blind over nine fields. Undated items only pass when no
    date bound is given."""
    for column, value in (("organization_id", organization_id), ("item_type", category), ("user_id", user_id)):
        if value is not None:
            feed = feed.filter(F.col(column) == value)
    if needle:
        wanted = needle.lower()
        hits = [F.coalesce(F.lower(F.col(f)).contains(wanted), F.lit(False)) for f in SEARCH_FIELDS if f in feed.columns]
        feed = feed.filter(reduce(lambda a, b: a | b, hits))
    if created_from is not None:
        feed = feed.filter(F.col("created_at") >= F.lit(created_from).cast("timestamp"))
    if created_to is not None:
        feed = feed.filter(F.col("created_at") <= F.lit(created_to).cast("timestamp"))
    return feed


def feed_top(feed: DataFrame, *, sort: str = "created_at", direction: str = "desc", limit: int | None = None, tie: Sequence[str] = ("item_type", "item_id")) -> DataFrame:
    """Items (the first ``limit`` if given) by one of five sort keys, then by time, then by the tie columns."""
    if sort not in SORTS:
        raise ValueError(f"sort must be one of {', '.join(SORTS)}")
    created = F.coalesce(F.col("created_at"), F.lit("0001-01-01").cast("timestamp"))
    keys = {
        "created_at": [],
        "organization": [F.coalesce("organization_name", F.lit(""))],
        "user": [F.coalesce("user_email", "user_name", F.lit(""))],
        "category": [F.col("item_type_label")],
        "status": [F.col("status")],
    }[sort]
    ordered = [k.desc() if direction == "desc" else k.asc() for k in [*keys, created]]
    ordered = feed.orderBy(*ordered, *tie)
    return ordered if limit is None else ordered.limit(limit)


def feed_kpis(feed: DataFrame) -> DataFrame:
    """One row of totals over a feed."""
    per_kind = [F.count_if(F.col("item_type") == kind).alias(f"{kind}s") for kind in CATEGORIES]
    return feed.agg(
        F.count(F.lit(1)).alias("total_items"),
        F.count_distinct(F.nullif("organization_id", F.lit(0))).alias("organizations"),
        F.count_distinct(F.nullif("user_id", F.lit(0))).alias("users"),
        *per_kind,
        F.count_if("problem").alias("failed_items"),
        F.max("created_at").alias("latest_activity_at"),
    )


def feed_by_org(feed: DataFrame) -> DataFrame:
    """Per organization: users, counts per kind, problems, latest; latest first, then name descending."""
    per_kind = [F.count_if(F.col("item_type") == kind).alias(f"{kind}s") for kind in CATEGORIES]
    grouped = feed.groupBy("organization_id").agg(
        F.coalesce(F.max("organization_name"), F.lit("Unknown organization")).alias("organization_name"),
        F.count(F.lit(1)).alias("total_items"),
        F.count_distinct("user_id").alias("user_count"),
        *per_kind,
        F.count_if("problem").alias("failed_items"),
        F.max("created_at").alias("latest_activity_at"),
    )
    return grouped.orderBy(F.desc_nulls_last("latest_activity_at"), F.desc("organization_name"))


def feed_by_category(feed: DataFrame) -> DataFrame:
    """Per kind: count, problems, latest; kinds without items are kept with 0.

    One pass with a conditional aggregate per kind, unfolded to the four kinds afterwards.
    """
    cells = []
    for kind in CATEGORIES:
        mine = F.col("item_type") == kind
        cells += [
            F.count_if(mine).alias(f"{kind}_n"),
            F.count_if(mine & F.col("problem")).alias(f"{kind}_bad"),
            F.max(F.when(mine, F.col("created_at"))).alias(f"{kind}_at"),
        ]
    rows = [
        F.struct(
            F.lit(kind).alias("item_type"),
            F.lit(label).alias("label"),
            F.col(f"{kind}_n").alias("count"),
            F.col(f"{kind}_bad").alias("failed_count"),
            F.col(f"{kind}_at").alias("latest_activity_at"),
        )
        for kind, label in CATEGORIES.items()
    ]
    return feed.agg(*cells).select(F.inline(F.array(*rows)))


def admin_count(users: DataFrame) -> DataFrame:
    return users.agg(F.count_if(F.col("role") == ADMIN).alias("admins"))


def owner_counts(memberships: DataFrame) -> DataFrame:
    """Owners per organization, 0 included."""
    return memberships.groupBy("organization_id").agg(F.count_if(F.col("role") == OWNER).alias("owners"))


def latest_of(a: Column, b: Column) -> Column:
    """The later of two times; a missing one is ignored."""
    return F.greatest(a, b)

"""Stratified samples and shuffled batches in a reproducible pseudo-random order of ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from dairyframe.operators.skew import shuffle_key, with_rank

#: Hex digits of the hash order per histogram: 4,096 buckets.
DIGITS = 3


def stratified_sample(lactations: DataFrame, n: int, *, seed: int = 42, id_column: str = "test_id") -> DataFrame:
    """``n`` lactations spread over parities in proportion to their size, at least one each.

    Per parity the first max(1, round(n * size / total)) of a hash order are selected, then the whole is
    trimmed or topped up to exactly ``n``. All lactations come back when there are at most ``n``. The
    hash order stands in for a random generator.

    Nothing is ranked. Each parity's quota becomes a threshold of the hash order: a histogram of its first hex digits gives
    the bucket in which the quota ends, a second histogram inside that bucket a part of it (a 16 millionth of the parity),
    and the order of the few rows there the threshold itself. The histograms and thresholds have a bounded
    number of rows per parity. The last step keeps the best ``n`` per task.
    """
    keyed = lactations.withColumns(
        {"_parity": F.coalesce(F.col("parity").cast("string"), F.lit("none")), "_order": shuffle_key(id_column, seed)}
    )
    slim = keyed.select("_parity", "_order", F.col(id_column).alias("_id"))
    first = _histogram(slim, 1)
    sizes = first.groupBy("_parity").agg(F.sum("_n").alias("_size"))
    everything = F.sum("_size").over(Window.partitionBy())
    quota = F.greatest(F.lit(1), F.bround(F.lit(float(n)) * F.col("_size") / everything, 0).cast("bigint"))
    quotas = sizes.select("_parity", F.when(everything <= n, F.col("_size")).otherwise(quota).alias("_left"))
    ends = _crossing(first, quotas)
    ends = _crossing(_histogram(slim, 1 + DIGITS, ends, DIGITS), ends)
    named = ends.select(F.col("_parity").alias("_p"), F.col("_bucket").alias("_b"), "_left")
    here = (F.col("_parity") == F.col("_p")) & (F.substring("_order", 1, 2 * DIGITS) == F.col("_b"))
    last = F.get(F.array_sort(F.collect_list(F.struct("_order", "_id"))), (F.first("_left") - 1).cast("int"))
    limits = slim.join(F.broadcast(named), here).groupBy("_p").agg(last.alias("_last"))
    chosen = keyed.join(F.broadcast(limits), F.col("_parity") == F.col("_p"))
    chosen = chosen.withColumn("_in", F.struct("_order", F.col(id_column).alias("_id")) <= F.col("_last"))
    picked = chosen.orderBy(F.desc("_in"), shuffle_key(id_column, seed + 1), id_column).limit(n)
    return picked.select(*lactations.columns)


def _histogram(rows: DataFrame, start: int, within: DataFrame | None = None, known: int = 0) -> DataFrame:
    """_parity, _bucket, _n by DIGITS more digits of the order; ``within`` keeps the rows of one bucket per parity."""
    if within is not None:
        head = F.substring("_order", 1, known)
        ends = within.select(F.col("_parity").alias("_p"), F.col("_bucket").alias("_b"))
        rows = rows.join(F.broadcast(ends), (F.col("_parity") == F.col("_p")) & (head == F.col("_b")), "left_semi")
    bucket = F.substring("_order", 1, start - 1 + DIGITS)
    return rows.groupBy("_parity", bucket.alias("_bucket")).agg(F.count(F.lit(1)).alias("_n"))


def _crossing(histogram: DataFrame, quotas: DataFrame) -> DataFrame:
    """Per parity the bucket in which ``_left`` rows of the order are reached, and how many of its rows are still needed."""
    before = Window.partitionBy("_parity").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    running = histogram.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    wanted = quotas.select(F.col("_parity").alias("_p"), "_left")
    joined = running.join(F.broadcast(wanted), F.col("_parity") == F.col("_p"))
    hit = (F.col("_before") < F.col("_left")) & (F.col("_left") <= F.col("_before") + F.col("_n"))
    return joined.filter(hit).select("_parity", "_bucket", (F.col("_left") - F.col("_before")).alias("_left"))


def shuffle_batches(
    df: DataFrame, *, batch_size: int = 32, seed: int = 42, shuffle: bool = True, id_column: str = "test_id"
) -> DataFrame:
    """Seeded shuffle cut into batches: adds batch_id and slot, the last batch may be short.

    Without ``shuffle`` the batches follow the hash order of seed 0, since Spark rows have no order of
    their own. ``id_column`` must be unique.
    """
    ranked = with_rank(df, id_column, seed if shuffle else 0)
    place = F.col("_rank") - 1
    return ranked.withColumns(
        {"batch_id": F.floor(place / batch_size).cast("bigint"), "slot": (place % batch_size).cast("int")}
    ).drop("_rank")


def collate(batches: DataFrame) -> DataFrame:
    """One row per batch with every column as an array in slot order; no longer than a batch."""
    fields = [c for c in batches.columns if c not in ("batch_id", "slot")]
    packed = F.array_sort(F.collect_list(F.struct("slot", *fields))).alias("_items")
    return batches.groupBy("batch_id").agg(packed).select("batch_id", *[F.col(f"_items.{c}").alias(c) for c in fields])

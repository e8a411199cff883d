"""Shapes that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

SALTS = 32


def join_lookup(big: DataFrame, table: DataFrame, on: Sequence[str], how: str = "left", *, bounded: bool = False) -> DataFrame:
    """Join a lookup table that has one row per key and whose keys may be hot in ``big``.

    ``bounded`` says that the table's size is limited by its meaning (days of a lactation, hash buckets): it is broadcast. Otherwise
    it is an ordinary join, for which adaptive execution broadcasts a table that turns out to be small and splits a hot key's
    partition of ``big`` into tasks of even size, each with that key's one table row. Each side is read once.
    """
    return big.join(F.broadcast(table) if bounded else table, list(on), how)


def top_per_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, *, salts: int = SALTS
) -> DataFrame:
    """The first ``k`` rows per key by ``order`` (a total order), exact, with ``_rank`` 1..k.

    Ranked per (key, salt) first: only ``k`` rows per salt can matter, so the final ranking of a hot
    key sees at most ``k * salts`` rows.
    """
    salt = F.pmod(F.xxhash64(*df.columns), F.lit(salts)).alias("_salt")
    first = Window.partitionBy(*keys, "_salt").orderBy(*order)
    last = Window.partitionBy(*keys).orderBy(*order)
    local = df.select("*", salt).withColumn("_rank", F.row_number().over(first)).filter(F.col("_rank") <= k)
    return local.drop("_salt", "_rank").withColumn("_rank", F.row_number().over(last)).filter(F.col("_rank") <= k)


def shuffle_key(id_column: str, seed: int) -> Column:
    """A reproducible pseudo-random order of ids: MD5 of id and seed as hex text."""
    return F.md5(F.concat_ws(":", F.col(id_column).cast("string"), F.lit(str(seed))))


def with_rank(
    df: DataFrame, id_column: str, seed: int, *, keys: Sequence[str] = (), hex_digits: int = 3
) -> DataFrame:
    """Exact rank (``_rank`` from 1) in shuffle order, per ``keys`` or overall, without a single-task sort.

    Rows fall into 16**hex_digits buckets by the head of their shuffle key. Bucket counts are summed
    with partial aggregation, the running total over that small table gives each bucket its offset, and
    only rows inside a bucket are ranked against each other. ``id_column`` must be unique; raise
    ``hex_digits`` when rows per bucket outgrow a task. ``keys`` must take few values (strata): the offsets,
    at most one row per stratum and bucket, are broadcast.
    """
    keyed = df.withColumn("_order", shuffle_key(id_column, seed))
    keyed = keyed.withColumn("_bucket", F.substring("_order", 1, hex_digits))
    counts = keyed.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*keys, "_bucket").orderBy("_order", id_column)
    ranked = keyed.withColumn("_local", F.row_number().over(inside))
    joined = join_lookup(ranked, offsets, [*keys, "_bucket"], "inner", bounded=True)
    return joined.withColumn("_rank", F.col("_offset") + F.col("_local")).drop("_bucket", "_local", "_offset", "_order")

"""Helpers the corpus operators share: written intermediates and joins whose keys may be hot."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from dairyframe.session import scratch_path

#: A key is hot when it holds at least this share of the rows, so there are at most 1 / HOT_SHARE hot keys.
HOT_SHARE = 1 / 128


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """``df`` written to the shared folder and read again: lineage is cut, a lost executor costs nothing."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


def join_counted(rows: DataFrame, groups: DataFrame, on: Sequence[str], size: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with one row per key, where one key may hold a third of ``rows``.

    ``groups.size`` is the number of ``rows`` of its key and ``total`` the number of all ``rows``. Keys with
    at least HOT_SHARE of the rows number 1 / HOT_SHARE at most, whatever the data, so these few are
    broadcast; the other keys meet in an ordinary shuffled join.
    """
    bound = max(1, int(total * HOT_SHARE))
    hot = groups.filter(F.col(size) >= bound)
    cold = groups.filter(F.col(size) < bound)
    found = rows.join(F.broadcast(hot), list(on), "inner")
    rest = rows.join(F.broadcast(hot.select(*on)), list(on), "left_anti")
    return found.unionByName(rest.join(cold, list(on), "inner"))


def id_crc_mod(column: str, n: int) -> Column:
    """crc32 of the id as text, modulo ``n`` (a null id counts as empty text)."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n

"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from dairyframe.llm.common import written


def _both_ways(links: DataFrame) -> DataFrame:
    return links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of ``links`` (a, b).

    Alternating large and small stars: each round hangs neighbours under the smallest node seen, and the
    number of rounds grows with the logarithm of the longest chain. Every step is written, so rounds don't pile
    up in the lineage; minima are pre-aggregated and joined as tables, so that adaptive execution can split hubs.
    """
    links = links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links = written(links, "links")
    before = None
    while True:
        pairs = _both_ways(links)
        least = written(pairs.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "star-minima")
        large = pairs.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        links = written(large.filter("a <> b").distinct(), "large-star")
        least = written(links.groupBy("a").agg(F.min("b").alias("m")), "star-minima")
        small = links.join(least, "a").select(F.col("b").alias("x"), "m", "a")
        small = small.select(F.col("x").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b")))
        links = written(small.filter("a <> b").distinct(), "small-star")
        state = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if tuple(state) == before:
            break
        before = tuple(state)
    roots = links.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)

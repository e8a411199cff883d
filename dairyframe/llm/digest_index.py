"""Exact dedup against a persistent digest index, bucketed and sorted by hash."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from dairyframe.llm.common import join_counted, table, written
from dairyframe.session import scratch_path

NAME = "op10_exact_dedup"
ORACLE = """
    SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
           doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
    FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))"""
BUCKETS = 64
#: Batches in which the query feeds its documents to the index.
BATCHES = 4


class DigestIndex:
    """Known digests as a table of ``buckets`` hash buckets, each file sorted by digest.

    The table lies in the shared folder and is registered under ``name``. A batch is shuffled once into the
    index's buckets and meets them in a sort-merge anti-join: the index itself never moves. The bucket
    count is fixed when the index is made; give it about one bucket per 128 MB of digests expected.
    """

    def __init__(self, spark: SparkSession, name: str | None = None, *, path: str | None = None, buckets: int = BUCKETS):
        self.spark, self.buckets = spark, buckets
        self.name = name or f"digest_index_{uuid.uuid4().hex}"
        self.path = path or scratch_path(spark, self.name)

    def exists(self) -> bool:
        return self.spark.catalog.tableExists(self.name)

    def known(self) -> DataFrame:
        return self.spark.table(self.name)

    def fresh(self, groups: DataFrame) -> DataFrame:
        """The rows of ``groups`` (one per digest) whose digest the index doesn't hold."""
        if not self.exists():
            return groups
        return groups.join(self.known().select("digest").hint("merge"), "digest", "left_anti")

    def again(self, groups: DataFrame) -> DataFrame:
        """The rows of ``groups`` whose digest the index holds."""
        return groups.join(self.known().select("digest").hint("merge"), "digest", "left_semi")

    def append(self, groups: DataFrame, *, dealt: bool = False) -> None:
        """Add rows (digest, keep_id, group_size); each bucket gets one sorted file per append.

        Rows that come straight from a join with the index lie in its buckets (``dealt``) and are not shuffled again.
        """
        rows = groups.select("digest", "keep_id", "group_size")
        rows = rows if dealt else rows.repartition(self.buckets, "digest")
        writer = rows.write.mode("append").format("parquet").bucketBy(self.buckets, "digest").sortBy("digest")
        writer.option("path", self.path).saveAsTable(self.name)


def digests(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id and SHA-256 (binary) of each row's whole text; a null text counts as empty."""
    text = F.coalesce(F.col(text_column), F.lit("")).cast("binary")
    return docs.select(F.col(id_column).alias("doc_id"), F.unhex(F.sha2(text, 256)).alias("digest"))


def exact_dedup(docs: DataFrame, index: DigestIndex | None = None, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Mark every row of ``docs`` as kept or as a copy, and add what is new to ``index``.

    Returns doc_id, keep_id, group_size (rows of this batch with the text), kept, text_sha256. Of equal
    texts new to the index the row with the largest doc_id stays; a text that an earlier batch brought
    keeps that batch's keep_id and all its rows here are dropped. Null and empty texts are one group.
    Repeated rows of the kept id all count as kept, since ids name documents. Null ids never win over
    others; a group of null ids only is kept under the null id. No rows give no rows. Other columns are ignored.

    Digests are written first, so each text is read and hashed once. Groups are counted with partial
    aggregation, and a text that fills a third of the table is joined back by broadcast of the few hot digests.
    """
    spark = docs.sparkSession
    index = index or DigestIndex(spark)
    rows = written(digests(docs, id_column=id_column, text_column=text_column), "digests")
    found = rows.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    groups = written(found, "digest-groups")
    if index.exists():
        earlier = index.known().select("digest", F.col("keep_id").alias("old_id"), F.lit(True).alias("seen"))
        new = written(index.fresh(groups), "digests-new")
        settled = groups.join(earlier, "digest", "left")
        keep = F.when(F.col("seen"), F.col("old_id")).otherwise(F.col("keep_id"))
        settled = settled.select("digest", keep.alias("keep_id"), "group_size", F.coalesce("seen", F.lit(False)).alias("seen"))
        settled = written(settled, "digests-settled")
    else:
        new, settled = groups, groups.withColumn("seen", F.lit(False))
    index.append(new)
    return marked(rows, settled)


def dedup_in_batches(
    docs: DataFrame, batches: int = BATCHES, *, id_column: str = "doc_id", text_column: str = "text", buckets: int = BUCKETS
) -> DataFrame:
    """As ``exact_dedup`` with a new index, but ``docs`` enter it in ``batches`` by hash of the id.

    Every later batch meets the written buckets: what the anti-join passes is appended, the other groups are set aside.
    At the end these join the index, so largest doc_id and counts hold for all of ``docs``, whatever the batches.
    """
    index = DigestIndex(docs.sparkSession, buckets=buckets)
    rows = digests(docs, id_column=id_column, text_column=text_column)
    rows = written(rows.withColumn("batch", F.pmod(F.xxhash64("doc_id"), F.lit(batches))), "digests")
    aside = None
    for b in range(batches):
        found = rows.filter(F.col("batch") == b).groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        if not index.exists():
            index.append(found)
            continue
        groups = written(found, "digest-groups")
        again = written(index.again(groups), "digests-again")
        aside = again if aside is None else aside.unionByName(again)
        index.append(index.fresh(groups), dealt=True)
    settled = index.known()
    if aside is not None:
        more = aside.groupBy("digest").agg(F.max("keep_id").alias("later_id"), F.sum("group_size").alias("later"))
        settled = settled.join(more.hint("merge"), "digest", "left").select(
            "digest", F.greatest("keep_id", "later_id").alias("keep_id"), (F.col("group_size") + F.coalesce("later", F.lit(0))).alias("group_size")
        )
    return marked(rows, written(settled.withColumn("seen", F.lit(False)), "digests-settled"))


def marked(rows: DataFrame, settled: DataFrame) -> DataFrame:
    """Every row (doc_id, digest) with its group (digest, keep_id, group_size, seen)."""
    # only repeated texts need their group; every other row is its own
    many = settled.filter((F.col("group_size") > 1) | F.col("seen") | F.col("keep_id").isNull())
    joined = join_counted(rows, many, ["digest"], "group_size", rows.count())
    single = settled.filter((F.col("group_size") == 1) & ~F.col("seen") & F.col("keep_id").isNotNull())
    single = single.withColumn("doc_id", F.col("keep_id"))
    columns = ["doc_id", "digest", "keep_id", "group_size", "seen"]
    every = joined.select(columns).unionByName(single.select(columns))
    return every.select(
        "doc_id",
        "keep_id",
        "group_size",
        (~F.col("seen") & F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_in_batches(table(spark, sf_dir, "documents"))

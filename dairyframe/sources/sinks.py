"""Sinks and the bookkeeping of stored artifacts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from decimal import Decimal

from pyspark.sql import DataFrame, Observation, functions as F

from dairyframe.operators.skew import join_lookup

CONTENT_KEYS = ("sha256", "size", "content_type", "encoding")


def export_rows(records: DataFrame, *, herd: bool) -> DataFrame:
    """Nested records to export rows TestId[, herd_id], parity, dim, milk_kg; the caller says whether herds are known."""
    rows = records.select("*").withColumn("_z", F.arrays_zip("dim", "milk_kg")).drop("dim", "milk_kg")
    keep = ["test_id", "parity"]
    if herd:
        keep.insert(1, "herd_id")
    return rows.select(*keep, F.inline("_z")).withColumnRenamed("test_id", "TestId")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").option("header", True).csv(path)


def write_json_gzip(df: DataFrame, path: str, *, record_id: str | None = None) -> dict[str, int]:
    """Gzip JSON lines; the row count (and count of non-null ids) is observed during the write."""
    counts = [F.count(F.lit(1)).alias("row_count")]
    if record_id is not None:
        counts.append(F.count(record_id).alias("record_count"))
    seen = Observation()
    df.observe(seen, *counts).write.mode("errorifexists").option("compression", "gzip").json(path)
    return dict(seen.get)


def write_presets(df: DataFrame, path: str, *, by: Sequence[str] = ("dataset", "size", "period")) -> None:
    """One folder per dataset, size and period, so that a reader of one sample lists only its folder."""
    df.write.mode("errorifexists").partitionBy(*by).json(path)


def content_dedup(artifacts: DataFrame) -> DataFrame:
    """Identical content is stored once: adds sha256 and kept_id, the oldest artifact of equal content.

    The oldest comes from an aggregate with partial sums, so many copies of one content stay cheap; the
    content itself does not move, only its hash. ``created_at`` and ``artifact_id`` are whole numbers, not negative.
    """
    return _oldest(_hashed(artifacts))


def content_links(artifacts: DataFrame) -> DataFrame:
    """Every artifact with the one that is kept for its content: artifact_id, kept_id.

    Very common contents (empty files) are split by the lookup.
    """
    hashed = _hashed(artifacts)
    # a null type or encoding would match nothing
    known = {c: F.coalesce(c, F.lit("")) for c in CONTENT_KEYS if c != "size"}
    kept = _oldest(hashed).withColumns(known).withColumn("size", F.coalesce("size", F.lit(-1)))
    rows = hashed.withColumns(known).withColumn("size", F.coalesce("size", F.lit(-1)))
    return join_lookup(rows, kept.drop("copies"), CONTENT_KEYS, "inner").select("artifact_id", "kept_id")


def _hashed(artifacts: DataFrame) -> DataFrame:
    return artifacts.withColumns({"sha256": F.sha2("content", 256), "size": F.octet_length("content")}).drop("content")


def _oldest(hashed: DataFrame) -> DataFrame:
    # time and id in one number keep the aggregate in fixed-width buffers
    order = F.col("created_at").cast("decimal(19,0)") * F.lit(Decimal(10**19)) + F.col("artifact_id")
    return hashed.groupBy(*CONTENT_KEYS).agg(
        F.min_by("artifact_id", order).alias("kept_id"), F.count(F.lit(1)).alias("copies")
    )


def unreferenced(artifacts: DataFrame, references: Mapping[str, tuple[DataFrame, Sequence[str]]]) -> DataFrame:
    """Artifacts that no record points at, over the key columns of several tables."""
    keys = None
    for frame, columns in references.values():
        part = frame.select(F.explode(F.array(*[F.col(c) for c in columns])).alias("artifact_id"))
        keys = part if keys is None else keys.unionByName(part)
    used = keys.filter(F.col("artifact_id").isNotNull()).distinct()
    return artifacts.join(used, "artifact_id", "left_anti")


def preset_counts(presets: DataFrame, sizes: Sequence[str]) -> DataFrame:
    """Lactations per period and size, one column per size, from preset documents or their heads (``files.read_preset_heads``)."""
    return presets.groupBy("period").agg(*[F.coalesce(F.sum(F.when(F.col("size") == s, F.col("cow_count"))), F.lit(0)).alias(s) for s in sizes])

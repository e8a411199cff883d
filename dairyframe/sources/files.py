"""File sources: delimited uploads, JSON documents and binary files.

Delimited files are read as text columns only (``delimited``); alias lists give the columns their meaning and unreadable
cells become null. ``pos`` keeps the order of files and rows, which the first-seen and last-wins rules need.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from dairyframe.functions import text as tx
from dairyframe.operators import alignment as al
from dairyframe.sources import delimited
from dairyframe.sources.delimited import read_delimited  # noqa: F401  (part of this module's interface)

# Accepted headers of benchmark files, matched after trimming and lower-casing.
BENCHMARK_ALIASES: dict[str, tuple[str, ...]] = {
    "test_id": ("testid", "cow_id", "id"),
    "parity": ("parity", "lact", "lactation"),
    "herd_id": ("herd_id", "herdid", "herd", "farm_id", "farmid"),
    "dim": ("dim", "daysinmilk", "days_in_milk"),
    "milk_kg": ("milk_kg", "milk", "dailymilkingyield", "milkrecording"),
    "yield_kg": (
        "lactationyield", "yield_305day", "total_305_yield", "totalactualproduction", "actualproduction",
        "calculatedmilkyield",
    ),
}
MAX_CONTROL_SHARE = 0.3
LACTATION_SCHEMA = "animal_id string, parity int, herd_id bigint, milk array<double>, events array<string>"
PRESET_SCHEMA = (
    "dataset string, size string, period string, cow_count bigint, "
    "cows array<struct<cow_id: string, display_name: string, parity: int, herd_id: bigint, dim: array<int>, milk_kg: array<double>>>, "
    "actual_yields map<string, double>"
)


def parse_test_day_files(spark: SparkSession, path: str, mapping: Mapping[str, str] | None = None) -> DataFrame:
    """Uploaded test days of a file or folder, each file by its own header."""
    return delimited.read_uploads(spark, path, lambda df: parse_test_day(df, mapping))


def split_binary(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """binaryFile rows as (text files, rejected files): a NUL byte or more than 30 % control bytes."""
    text = F.decode("content", "ISO-8859-1")
    kept = F.length(F.regexp_replace(text, "[\\x00-\\x08\\x0e-\\x1f\\x7f]", ""))
    binary = F.when(
        F.length("content") > 0,
        text.contains("\x00") | ((F.length("content") - kept) / F.length("content") > MAX_CONTROL_SHARE),
    ).otherwise(F.lit(False))
    return files.filter(~binary), files.filter(binary)


def read_files(spark: SparkSession, root: str, *, pattern: str = "*", recursive: bool = True, path_part: str | None = None) -> DataFrame:
    """Files by glob or part of the path: path, filename, label (parent folder), size, modified, content.

    Only the columns a query uses are read; without ``content`` no file is opened. Empty files are not
    listed by Spark.
    """
    files = (
        spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).load(root)
    )
    if path_part is not None:
        files = files.filter(F.col("path").contains(path_part))
    parts = F.split("path", "/")
    return files.select(
        "path",
        F.element_at(parts, -1).alias("filename"),
        F.try_element_at(parts, F.lit(-2)).alias("label"),
        F.col("length").alias("size"),
        F.col("modificationTime").alias("modified"),
        "content",
    )


def read_lactation_json(spark: SparkSession, root: str, *, pattern: str = "animal_*.json", lines: bool = False) -> DataFrame:
    """One document per lactation, in a file or (``lines``) on a line; unreadable documents are left out."""
    schema = LACTATION_SCHEMA + ", _broken string"
    docs = spark.read.schema(schema).option("multiLine", not lines).option("pathGlobFilter", pattern)
    docs = docs.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_broken").json(root)
    return docs.filter(F.col("_broken").isNull() & F.col("animal_id").isNotNull()).drop("_broken")


def read_presets(spark: SparkSession, path: str, *, lines: bool = False) -> DataFrame:
    """Preset documents as stored: one row per dataset, size and period, from a file or (``lines``) a line each."""
    return spark.read.schema(PRESET_SCHEMA).option("multiLine", not lines).json(path)


def read_preset_heads(spark: SparkSession, path: str, *, lines: bool = False) -> DataFrame:
    """dataset, size, period and cow_count of preset documents: the same files, read for four fields only.

    The reader passes over the cows and yields of a document without building them, wherever cow_count stands in it.
    """
    heads = "dataset string, size string, period string, cow_count bigint"
    return spark.read.schema(heads).option("multiLine", not lines).option("recursiveFileLookup", "true").json(path)


def preset_cows(presets: DataFrame) -> DataFrame:
    return presets.select("dataset", "size", "period", F.inline("cows"))


def preset_yields(presets: DataFrame) -> DataFrame:
    return presets.select("dataset", "size", "period", F.explode("actual_yields").alias("test_id", "yield_kg"))


# --- parsing of text columns ---------------------------------------------------------------------


def _pick(columns: Sequence[str], name: str) -> str | None:
    lowered = {c.strip().lower(): c for c in columns}
    return next((lowered[a] for a in BENCHMARK_ALIASES[name] if a in lowered), None)


def _columns(df: DataFrame, required: Sequence[str], optional: Sequence[str] = ()) -> dict[str, Column]:
    found = {name: _pick(df.columns, name) for name in (*required, *optional)}
    missing = [name for name in required if found[name] is None]
    if missing:
        raise ValueError(f"missing required columns: {', '.join(missing)}")
    return {name: F.col(f"`{c}`") if c else F.lit(None).cast("string") for name, c in found.items()}


def parse_test_day(df: DataFrame, mapping: Mapping[str, str] | None = None) -> DataFrame:
    """Uploaded test days: test_id, dim, milk_kg, parity, herd_id, pos, event_ok, reject_reason.

    Keep rows with ``event_ok`` and a null ``reject_reason``; the others are there to be counted.
    """
    names, _ = al.upload_mapping([c for c in df.columns if c != "pos"], mapping)

    def cell(key: str) -> Column:
        return F.col(f"`{names[key]}`") if key in names else F.lit(None).cast("string")

    test_id = F.coalesce(F.trim(cell("cow_id")), F.lit("")) if "cow_id" in names else F.lit("0")
    rows = df.select(
        test_id.alias("test_id"),
        tx.whole(tx.parse_number(cell("dim"))).alias("dim"),
        tx.parse_number(cell("milk_kg")).alias("milk_kg"),
        tx.whole(tx.parse_number(cell("parity"))).alias("parity"),
        F.trim(cell("herd_id")).alias("herd_id"),
        al.is_milk_event(cell("event_type")).alias("event_ok"),
        "pos",
    )
    return rows.withColumn("reject_reason", al.reject_reason(F.col("test_id"), F.col("dim"), F.col("milk_kg")))


def usable_test_days(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("event_ok") & F.col("reject_reason").isNull()).drop("event_ok", "reject_reason")


def parse_benchmark_test_day(df: DataFrame) -> DataFrame:
    """Benchmark test days: rows without id, unreadable, with dim < 0 or milk <= 0 are dropped; milk at
    2 decimals. Out: test_id, dim, milk_kg, parity, herd_id, pos."""
    c = _columns(df, ("test_id", "dim", "milk_kg"), ("parity", "herd_id"))
    rows = df.select(
        F.trim(c["test_id"]).alias("test_id"),
        tx.whole(tx.comma_number(c["dim"])).alias("dim"),
        tx.comma_number(c["milk_kg"]).alias("milk_kg"),
        tx.whole(tx.to_number(c["parity"])).alias("parity"),
        tx.to_number(c["herd_id"]).try_cast("bigint").alias("herd_id"),
        "pos",
    )
    usable = (F.col("test_id") != "") & (F.col("dim") >= 0) & (F.col("milk_kg") > 0)
    return rows.filter(usable).withColumn("milk_kg", F.round("milk_kg", 2))


def benchmark_lactations(rows: DataFrame) -> DataFrame:
    """Benchmark rows to records: test_id, parity, herd_id (first known in file order), dim, milk_kg.

    Records are ordered by day; those of one day keep the file order.
    """
    heads = rows.groupBy("test_id").agg(
        *[F.min_by(c, F.when(F.col(c).isNotNull(), F.col("pos"))).alias(c) for c in ("parity", "herd_id")]
    )
    return al.nest_lactation(rows, order="pos").join(heads, "test_id")


def actual_rows(df: DataFrame) -> DataFrame:
    """Rows of a ground-truth file with a usable value: test_id, yield_kg, pos."""
    c = _columns(df, ("test_id", "yield_kg"))
    rows = df.select(F.trim(c["test_id"]).alias("test_id"), tx.comma_number(c["yield_kg"]).alias("yield_kg"), "pos")
    return rows.filter((F.col("test_id") != "") & (F.col("yield_kg") >= 0))


def last_per_id(rows: DataFrame) -> DataFrame:
    """The last readable value of each id, in the order of files and rows."""
    return rows.filter("yield_kg is not null").groupBy("test_id").agg(F.max_by("yield_kg", "pos").alias("yield_kg"))


def parse_actual_yields(df: DataFrame) -> DataFrame:
    """Ground truth: bad or negative values skipped, the last row per id wins."""
    return last_per_id(actual_rows(df))


def read_actual_yields(spark: SparkSession, path: str) -> DataFrame:
    """Ground truth of a file or folder; the last row over all files wins."""
    return last_per_id(delimited.read_uploads(spark, path, actual_rows))


def submission_rows(df: DataFrame) -> DataFrame:
    """Rows of a submission: test_id, yield_kg (null if unreadable), pos; a negative yield fails the job."""
    c = _columns(df, ("test_id", "yield_kg"))
    value = tx.comma_number(c["yield_kg"])
    message = F.concat(F.lit("negative yield for lactation "), F.trim(c["test_id"]))
    checked = F.when(value < 0, F.raise_error(message).cast("double")).otherwise(value)
    return df.select(F.trim(c["test_id"]).alias("test_id"), checked.alias("yield_kg"), "pos").filter("test_id <> ''")


def split_submission(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, failed): the last readable row per id, and the ids of unreadable rows."""
    return last_per_id(rows), rows.filter("yield_kg is null").select("test_id")


def parse_submission(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Own-method yields as (good, failed): the last row per id wins, unreadable rows are the failed ids,
    and a negative yield fails the job."""
    return split_submission(submission_rows(df))


def read_submission(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A submission of a file or folder as (good, failed)."""
    return split_submission(delimited.read_uploads(spark, path, submission_rows))


def aggregated_cells(df: DataFrame) -> DataFrame:
    """Each recognised statistic of a file as an array of its cells, unreadable ones null."""
    known: dict[str, list[str]] = {}
    for column in df.columns:
        canonical = al.STAT_ALIASES.get(tx.norm_header_text(column))
        if canonical and column != "pos":
            known.setdefault(canonical, []).append(column)
    if not known:
        raise ValueError("no recognised herd statistic columns")
    return df.select(*[F.array(*[tx.parse_number(F.col(f"`{c}`")) for c in cs]).alias(name) for name, cs in known.items()])


def aggregated_means(cells: DataFrame) -> DataFrame:
    """One row: the mean of every statistic over its readable cells, and ``<name>_bad``, the number of unreadable ones."""
    out = []
    for name in cells.columns:
        readable = F.filter(name, lambda v: v.isNotNull())
        values = F.sum(F.coalesce(F.size(readable), F.lit(0)))
        total = F.sum(F.coalesce(F.aggregate(readable, F.lit(0.0), lambda a, v: a + v), F.lit(0.0)))
        out += [F.try_divide(total, values).alias(name), (F.sum(F.coalesce(F.size(name), F.lit(0))) - values).alias(f"{name}_bad")]
    return cells.agg(*out)


def parse_aggregated(df: DataFrame) -> DataFrame:
    """Averaged herd statistics: one row with the mean of every recognised column over its readable
    cells, and ``<name>_bad`` with the number of unreadable ones."""
    return aggregated_means(aggregated_cells(df))


def read_aggregated(spark: SparkSession, path: str) -> DataFrame:
    """Averaged herd statistics of a file or folder; files may hold different statistics under different names."""
    return aggregated_means(delimited.read_uploads(spark, path, aggregated_cells))


def parse_herd_export(df: DataFrame) -> DataFrame:
    """Herd-software export: test_id, dim, milk_kg, direct_kg, pos. Pounds become kg; rows without id,
    day or positive milk are dropped. Columns id, dim and milk are required."""
    names = {tx.norm_header_text(c): c for c in reversed(df.columns)}

    def cell(*candidates: str) -> Column | None:
        hit = next((names[c] for c in candidates if c in names), None)
        return None if hit is None else F.col(f"`{hit}`")

    test_id, dim, milk = cell("id", "cowid"), cell("dim", "daysinmilk"), cell("milk")
    if test_id is None or dim is None or milk is None:
        raise ValueError("herd export is missing required columns (ID, DIM, MILK)")
    direct = cell("305me")
    direct_kg = tx.lb_to_kg(tx.parse_number(direct)) if direct is not None else F.lit(None).cast("double")
    rows = df.select(
        F.trim(test_id).alias("test_id"),
        tx.whole(tx.parse_number(dim)).alias("dim"),
        tx.parse_number(milk).alias("milk_lb"),
        direct_kg.alias("direct_kg"),
        "pos",
    )
    usable = rows.filter((F.col("test_id") != "") & F.col("dim").isNotNull() & (F.col("milk_lb") > 0))
    return usable.select("test_id", "dim", tx.lb_to_kg(F.col("milk_lb")).alias("milk_kg"), "direct_kg", "pos")

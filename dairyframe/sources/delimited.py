"""Delimited text files of one upload: a header per file, one order over all files, line breaks inside quotes.

A folder may hold files with columns in different orders, under different names and with different delimiters. A header catalogue
tells which files share a header; each distinct header is one read, and the reads are united by name.
"""

from __future__ import annotations

import csv
import re
from collections.abc import Callable
from functools import reduce
from typing import NamedTuple
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from dairyframe.session import scratch_path

BYTE_ORDER_MARK = "﻿"
#: Positions count blocks of this many bytes over all files, then rows inside a task.
BLOCK = 12
ROWS = 28


class Header(NamedTuple):
    """Files that start with the same line."""

    line: str
    sep: str
    files: list[str]

    @property
    def columns(self) -> list[str]:
        return next(csv.reader([self.line], delimiter=self.sep), [])


def delimiter_of(line: str) -> str:
    """``;`` when it outnumbers ``,``, else ``,``."""
    return ";" if line.count(";") > line.count(",") else ","


def _place() -> list[Column]:
    row = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    return [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), row.alias("_row")]


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Every line with its file, split and row; a carriage return before a line feed stays part of the line."""
    reader = spark.read.option("lineSep", "\n").option("recursiveFileLookup", "true")
    return reader.text(path).select("value", *_place())


def file_order(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(_file, _base): how many blocks lie in the files before this one, by path.

    One row per file, from the listing alone: no file is opened. The driver holds the same listing to plan the scan, so the table is
    safe to broadcast.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    sizes = listed.select(F.col("_metadata.file_path").alias("_file"), (F.shiftright("length", BLOCK) + 1).alias("_blocks"))
    before = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select("_file", F.coalesce(F.sum("_blocks").over(before), F.lit(0)).alias("_base"))


def _with_pos(rows: DataFrame, order: DataFrame) -> DataFrame:
    """``pos``, unique and ordered by path, then place in the file, in place of _file, _start and _row.

    Exact for splits of 4 KB to 256 MB (the default is 128 MB) and folders below 128 TB.
    """
    pos = F.shiftleft(F.col("_base") + F.shiftright("_start", BLOCK), ROWS) + F.col("_row")
    joined = rows.join(F.broadcast(order), "_file")
    return joined.select(*[F.col(f"`{c}`") for c in rows.columns if c not in ("_file", "_start", "_row")], pos.alias("pos"))


def header_catalogue(spark: SparkSession, path: str | list[str]) -> list[Header]:
    """The distinct headers of all files below ``path``, each with its files; files without any line are left out.

    A header is the first line of a file that isn't blank. One scan over plain lines, combined per file before its shuffle, finds them;
    the driver sees one line per distinct header and the file names it has listed itself.
    """
    clean = F.ltrim(F.rtrim("value", F.lit("\r")), F.lit(BYTE_ORDER_MARK))
    lines = _lines(spark, path).filter("_start = 0").withColumn("value", clean).filter(F.trim("value") != "")
    heads = lines.groupBy("_file").agg(F.min_by("value", "_row").alias("line"))
    found = heads.groupBy("line").agg(F.array_sort(F.collect_list("_file")).alias("files")).collect()
    return sorted((Header(r["line"], delimiter_of(r["line"]), r["files"]) for r in found), key=lambda h: h.files[0])


def _read(spark: SparkSession, header: Header, sep: str | None) -> DataFrame:
    """The files of one header as text columns; names are taken literally, not as patterns."""
    files = [re.sub(r"([\[\]{}*?\\])", r"\\\1", unquote(f)) for f in header.files]
    rows = spark.read.csv(files, header=True, sep=sep or header.sep, inferSchema=False, escape='"')
    names = [c.lstrip(BYTE_ORDER_MARK) for c in rows.columns]
    return rows.select("*", *_place()).toDF(*names, "_file", "_start", "_row")


def read_groups(spark: SparkSession, path: str, *, sep: str | None = None, multi_line: bool = False) -> list[tuple[Header, DataFrame]]:
    """One frame of text columns and ``pos`` for each distinct header of the files below ``path``."""
    headers = header_catalogue(spark, path)
    order = file_order(spark, path)
    if multi_line:
        lines = _written_lines(spark, path)
        return [(h, _with_pos(_quoted_rows(lines, h, sep or h.sep), order)) for h in headers]
    return [(h, _with_pos(_read(spark, h, sep), order)) for h in headers]


def read_delimited(
    spark: SparkSession, path: str, *, sep: str | None = None, max_rows: int | None = None, multi_line: bool = False
) -> DataFrame:
    """Delimited files with headers as text columns plus ``pos``; a byte-order mark is dropped.

    Files may differ in the order of their columns and in their delimiter (found per file unless ``sep`` is given); they are united by
    column name, and a column that a file lacks is null there. ``pos`` grows by path, then place in the file. A doubled quote inside
    quotes is a quote. Files with line breaks inside quotes need ``multi_line``. ``max_rows`` keeps the first rows.
    """
    groups = [df for _, df in read_groups(spark, path, sep=sep, multi_line=multi_line)]
    if not groups:
        return spark.createDataFrame([], "pos long")
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), groups)
    rows = rows.select(*[F.col(f"`{c}`") for c in rows.columns if c != "pos"], "pos")
    return rows if max_rows is None else rows.orderBy("pos").limit(max_rows)


def read_uploads(spark: SparkSession, path: str, parse: Callable[[DataFrame], DataFrame], *, multi_line: bool = False) -> DataFrame:
    """``parse`` applied to the files of each header, so that every file's columns get their meaning from its own header.

    The parsed rows are united. A header that ``parse`` refuses is reported with the first file that has it.
    """
    parsed = []
    for header, rows in read_groups(spark, path, multi_line=multi_line):
        try:
            parsed.append(parse(rows))
        except ValueError as error:
            others = f" and {len(header.files) - 1} more" if len(header.files) > 1 else ""
            raise ValueError(f"{header.files[0]}{others}: {error}") from error
    if not parsed:
        raise ValueError(f"{path}: no file with a header")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parsed)


# --- line breaks inside quotes --------------------------------------------------------------------


def _written_lines(spark: SparkSession, path: str) -> DataFrame:
    """All lines, written once: what follows meets the same splits and rows however often it runs."""
    out = scratch_path(spark, "lines")
    odd = (F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))) % 2
    lines = _lines(spark, path).withColumn("odd", odd.cast("int"))
    lines.write.parquet(out)
    return spark.read.schema(lines.schema).parquet(out)


def quoted_records(lines: DataFrame) -> DataFrame:
    """Lines to records: (value, _file, _start, _row), where a record goes on while a quote is open.

    A line starts a record when an even number of quotes stands before it in its file. Each split sums its own quotes; a running sum over
    the splits of a file, one row each, says whether a split starts inside quotes and where the record began that reaches into it.
    So a file is worked on split by split, never whole, and only lines of records with several lines are shuffled by record. Quotes
    have to be balanced: cells with a quote inside are quoted themselves, with the quote doubled.
    """
    split = ["_file", "_start"]
    inside = Window.partitionBy(*split).orderBy("_row")
    before = F.coalesce(F.sum("odd").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    walked = lines.withColumn("_before", before % 2)
    # what a split hands on: its parity, and its last line that starts a record, if it starts outside or inside quotes
    start = F.struct("_start", "_row")
    per_split = walked.groupBy(*split).agg(
        (F.sum("odd") % 2).alias("_odd"),
        F.max(F.when(F.col("_before") == 0, start)).alias("_last0"),
        F.max(F.when(F.col("_before") == 1, start)).alias("_last1"),
    )
    earlier = Window.partitionBy("_file").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    state = per_split.withColumn("_open", F.coalesce(F.sum("_odd").over(earlier), F.lit(0)) % 2)
    last = F.when(F.col("_open") == 0, F.col("_last0")).otherwise(F.col("_last1"))
    state = state.withColumn("_reaches", F.last(last, ignorenulls=True).over(earlier)).select(*split, "_open", "_reaches")
    # one row per split of the files, which the driver has planned itself
    placed = walked.join(F.broadcast(state), split)
    begins = (F.col("_open") + F.col("_before")) % 2 == 0
    here = F.last(F.when(begins, start), ignorenulls=True).over(inside)
    goes_on = (F.col("_open") + F.col("_before") + F.col("odd")) % 2 == 1
    marked = placed.select("value", *split, "_row", F.coalesce(here, "_reaches").alias("_record"), begins.alias("_begins"), goes_on.alias("_goes_on"))
    single = marked.filter(F.col("_begins") & ~F.col("_goes_on")).select("value", *split, "_row")
    parts = marked.filter(~F.col("_begins") | F.col("_goes_on"))
    in_order = F.array_sort(F.collect_list(F.struct("_start", "_row", "value")))
    several = parts.groupBy("_file", "_record").agg(F.array_join(F.transform(in_order, lambda x: x["value"]), "\n").alias("value"))
    return single.unionByName(several.select("value", "_file", "_record._start", "_record._row"))


def _quoted_rows(lines: DataFrame, header: Header, sep: str) -> DataFrame:
    """Records of the files of one header as text columns, without their headers and blank lines."""
    names = Header(header.line, sep, []).columns
    # the files of one header: part of the listing that the driver holds
    files = lines.sparkSession.createDataFrame([(f,) for f in header.files], "_file string")
    own = lines.join(F.broadcast(files), "_file", "left_semi")
    body = quoted_records(own).join(F.broadcast(_first_lines(own)), ["_file", "_start", "_row"], "left_anti")
    body = body.withColumn("value", F.regexp_replace("value", "\r$", "")).filter(F.trim("value") != "")
    schema = ", ".join(f"c{i} string" for i in range(len(names)))
    parsed = body.withColumn("_c", F.from_csv("value", schema, {"sep": sep, "escape": '"'}))
    return parsed.select(*[F.col(f"_c.c{i}").alias(n) for i, n in enumerate(names)], "_file", "_start", "_row")


def _first_lines(lines: DataFrame) -> DataFrame:
    """Where each file's header stands: one row per file."""
    place = F.struct("_start", "_row")
    heads = lines.filter(F.trim(F.rtrim("value", F.lit("\r"))) != "").groupBy("_file").agg(F.min(place).alias("h"))
    return heads.select("_file", "h._start", "h._row")

"""Line dedup with levelled sorted runs of line hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from dairyframe.llm.common import join_counted, table, written
from dairyframe.session import scratch_path

NAME = "op9_line_dedup"
ORACLE = """
    WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
    l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM d),
    k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
    often AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
    m AS (SELECT k.doc_id, k.line, k.pos, o.key IS NOT NULL AND k.doc_id <> o.keeper AS gone FROM k LEFT JOIN often o ON k.key = o.key)
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
    FROM m GROUP BY doc_id"""
SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NO_ID = -(2**63)
RUN = "h binary, docs long, lines long, keeper long"


def line_key(line: Column) -> Column:
    """The line with white space stripped at both ends and A-Z lower-cased; other letters keep their case."""
    bare = F.btrim(line, F.lit(SPACE))
    plain = F.octet_length(bare) == F.length(bare)
    return F.when(plain, F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


class LineRuns:
    """Line hashes seen so far, as sorted runs in levels.

    A run has one row per hash that no earlier run held when it was written: docs, lines and keeper (largest id). Every
    batch is split by merge-joins with the runs: hashes that pass all anti-joins are a run of level 0, the others are
    additions to the one run that holds them, merge-joined into its counts and keepers when it is read. ``fanout`` runs
    of a level are compacted into one run of the next, with their additions; runs never share a hash.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, *, fanout: int = 4):
        self.spark, self.fanout = spark, fanout
        self.path = path or scratch_path(spark, "line-runs")
        self.levels: list[list[str]] = []
        self.additions: dict[str, list[str]] = {}
        self.made = 0

    def _held(self) -> list[str]:
        return [p for level in self.levels for p in level]

    def _write(self, rows: DataFrame, name: str) -> str:
        path = f"{self.path}/{name}-{self.made}"
        self.made += 1
        rows.sortWithinPartitions("h").write.parquet(path)
        return path

    def _put(self, rows: DataFrame, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        path = self._write(rows, f"level-{level}-run")
        self.levels[level].append(path)
        self.additions[path] = []

    def _plain(self, *paths: str) -> DataFrame:
        return self.spark.read.schema(RUN).parquet(*paths)

    def add(self, batch: DataFrame) -> None:
        """Add rows (h, docs, lines, keeper), one per hash; documents of different batches are distinct."""
        batch = batch.select("h", "docs", "lines", "keeper")
        if self._held():
            batch = self._plain(self._write(batch, "batch"))
        fresh = batch
        for run in self._held():
            hashes = self._plain(run).select("h").hint("merge")
            self.additions[run].append(self._write(batch.join(hashes, "h", "left_semi"), "addition"))
            fresh = fresh.join(hashes, "h", "left_anti")
        self._put(fresh, 0)
        level = 0
        while len(self.levels[level]) >= self.fanout:
            self._put(self._union(self.levels[level]), level + 1)
            self.levels[level] = []
            level += 1

    def _run(self, path: str) -> DataFrame:
        """A run with its additions."""
        if not self.additions[path]:
            return self._plain(path)
        more = self._plain(*self.additions[path]).groupBy("h")
        more = more.agg(F.sum("docs").alias("more_docs"), F.sum("lines").alias("more_lines"), F.max("keeper").alias("more_keeper"))
        none = F.lit(0)
        return self._plain(path).join(more.hint("merge"), "h", "left").select(
            "h",
            (F.col("docs") + F.coalesce("more_docs", none)).alias("docs"),
            (F.col("lines") + F.coalesce("more_lines", none)).alias("lines"),
            F.greatest("keeper", "more_keeper").alias("keeper"),
        )

    def _union(self, paths: list[str]) -> DataFrame:
        every = self._run(paths[0])
        for path in paths[1:]:
            every = every.unionByName(self._run(path))
        return every

    def totals(self) -> DataFrame:
        """One row per hash over all runs, each from the run that holds it."""
        return self._union(self._held())


def line_dedup(
    docs: DataFrame,
    *,
    min_docs: int = 3,
    min_chars: int = 20,
    batches: int = 4,
    fanout: int = 3,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """Drop lines whose key occurs in at least ``min_docs`` documents, except in the largest id holding it.

    Returns ``row`` (all input columns as one struct, so no name can clash), ``text`` (kept lines joined by
    line feeds), ``n_lines`` before dropping and ``n_dropped``; one row per input row. Keys shorter
    than ``min_chars`` code points are never dropped. A null or empty text is one empty line. Rows that
    repeat an id count as one document, and each of them is cut by its own lines; null ids are one document
    that orders before all others. No rows give no rows.

    Keys are 128-bit MD5 hashes of lines, written once per line. Documents enter the runs in ``batches`` by
    hash of the id. A line that a third of all documents hold is counted by partial aggregation and joined back by
    broadcast of the few hot hashes. Kept positions come from ``array_except``, linear in a document's lines.
    """
    text = F.coalesce(F.col(text_column), F.lit(""))
    base = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.coalesce(F.col(id_column).cast("long"), F.lit(NO_ID)).alias("id"),
        F.xxhash64(text).alias("version"),
        F.split(text, "\n", -1).alias("lines"),
    )
    keys = base.select("id", "version", F.posexplode("lines").alias("pos", "line"))
    keys = keys.select("id", "version", "pos", line_key(F.col("line")).alias("key")).filter(F.length("key") >= min_chars)
    keys = keys.select("id", "version", "pos", F.unhex(F.md5("key")).alias("h"), F.pmod(F.xxhash64("id"), F.lit(batches)).alias("batch"))
    keys = written(keys, "line-keys")

    runs = LineRuns(docs.sparkSession, fanout=fanout)
    for b in range(batches):
        per_doc = keys.filter(F.col("batch") == b).groupBy("h", "id").agg(F.count(F.lit(1)).alias("n"))
        runs.add(per_doc.groupBy("h").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("lines"), F.max("id").alias("keeper")))
    often = written(runs.totals().filter(F.col("docs") >= min_docs).select("h", "lines", "keeper"), "line-often")

    gone = join_counted(keys, often, ["h"], "lines", keys.count()).filter(F.col("id") != F.col("keeper"))
    gone = gone.groupBy("id", "version").agg(F.collect_set("pos").alias("gone"))
    cut = base.join(gone, ["id", "version"], "left")
    none = F.array().cast("array<int>")
    stay = F.array_sort(F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.coalesce("gone", none)))
    kept = F.when(F.col("gone").isNull(), F.array_join("lines", "\n")).otherwise(F.array_join(F.transform(stay, lambda i: F.get("lines", i)), "\n"))
    return cut.select(
        "row",
        kept.alias("text"),
        F.size("lines").cast("long").alias("n_lines"),
        F.when(F.col("gone").isNull(), F.lit(0)).otherwise(F.size("gone")).cast("long").alias("n_dropped"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = line_dedup(table(spark, sf_dir, "documents"))
    digest = F.sha2(F.col("text").cast("binary"), 256)
    return cut.select(F.col("row.doc_id").alias("doc_id"), "n_lines", "n_dropped", digest.alias("kept_sha256"))

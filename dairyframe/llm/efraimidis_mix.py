"""Mixing sources to target weights by Efraimidis-Spirakis sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from dairyframe.llm.common import join_counted, table, written

NAME = "op7_mix_sources"
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
SLICES = 4096
QUALITY = {1: 1.0, 0: 0.25}
UNKNOWN_QUALITY = 0.5
#: Every rule in SQL; md5 gives both engines the same uniform numbers.
ORACLE = """
    WITH q AS (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id),
    d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
                 CASE quality WHEN 1 THEN 1.0::DOUBLE WHEN 0 THEN 0.25::DOUBLE ELSE 0.5::DOUBLE END AS w
          FROM documents LEFT JOIN q USING (doc_id)),
    s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
    r AS (SELECT *, [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INT) + 1] AS weight FROM s),
    c AS (SELECT *, row_number() OVER (ORDER BY source_size::DOUBLE / weight, source NULLS LAST) AS n FROM r),
    p AS (SELECT *, coalesce(sum(2 * source_size) OVER before, 0)::DOUBLE AS full_below,
                 (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0))::DOUBLE AS open_weight,
                 1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE AS budget
          FROM c WINDOW before AS (ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    f AS (SELECT *, (budget - full_below) / open_weight AS rate FROM p),
    lvl AS (SELECT min(n) AS n FROM f WHERE rate * weight <= 2 * source_size),
    t AS (SELECT f.source, f.source_size,
                 CASE WHEN lvl.n IS NULL OR f.n < lvl.n THEN (2 * f.source_size)::DOUBLE ELSE g.rate * f.weight END AS target
          FROM f, lvl LEFT JOIN f g ON g.n = lvl.n),
    b AS (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE least(floor(target / source_size), 2) END::BIGINT AS epochs FROM t),
    e AS (SELECT *, CAST(round(target - epochs * source_size) AS BIGINT) AS extra FROM b),
    k AS (SELECT d.doc_id, d.size, e.source_size, e.target, e.epochs, e.extra,
                 sum(d.size) OVER (PARTITION BY e.source ORDER BY
                     -ln((('0x' || substr(md5(CAST(d.doc_id AS VARCHAR) || ':7'), 1, 13))::BIGINT + 1)::DOUBLE / 4503599627370497.0::DOUBLE) / d.w, d.doc_id
                     ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - d.size AS before
          FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
    SELECT doc_id, size, source_size, target, CAST(size * epochs + greatest(0, least(size, extra - before)) AS BIGINT) AS taken FROM k"""


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` words; null counts none."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Targets per source from rows (name, source, source_size, units).

    Weights repeat over the sources by code point, null last. Together the targets are ``share`` of all
    words; none exceeds ``most`` times its source, and what is cut off goes to the others by weight. That
    level is found in one pass over the sources in order of size / weight: the first one that stays below its
    limit with all smaller ones at theirs sets the rate for the rest. Two windows sort the sources, one row each.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    which = (F.row_number().over(by_name) - 1) % len(weights) + 1
    ranked = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), which.cast("int")))
    fill = F.col("source_size").cast("double") / F.col("weight")
    order = [fill, F.col("source").asc_nulls_last()]
    ranked = ranked.withColumn("n", F.row_number().over(Window.orderBy(*order)))
    before = Window.orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    limit = F.lit(most) * F.col("source_size")
    level = ranked.withColumns(
        {
            "full_below": F.coalesce(F.sum(limit).over(before), F.lit(0.0)),
            "open_weight": (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))).cast("double"),
            "budget": F.lit(float(share)) * F.sum("source_size").over(everything).cast("double"),
        }
    ).withColumn("rate", (F.col("budget") - F.col("full_below")) / F.col("open_weight"))
    first = F.min(F.when(F.col("rate") * F.col("weight") <= limit, F.struct("n", "rate"))).over(everything)
    level = level.withColumn("first", first)
    target = F.when(F.col("first").isNull() | (F.col("n") < F.col("first.n")), limit).otherwise(F.col("first.rate") * F.col("weight"))
    level = level.withColumn("target", target)
    whole = F.least(F.floor(F.col("target") / F.nullif(F.col("source_size"), F.lit(0))), F.lit(int(most)))
    level = level.withColumn("epochs", F.coalesce(whole, F.lit(0)).cast("long"))
    extra = F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long")
    return level.select("name", "source", "source_size", "units", "weight", "target", "epochs", extra.alias("extra"))


def sampling_key(id_column: Column, quality: Column, seed: int) -> Column:
    """Exponential key with rate ``quality``: the smallest keys form an Efraimidis-Spirakis sample."""
    text = F.concat(F.coalesce(id_column.cast("string"), F.lit("")), F.lit(f":{seed}"))
    number = F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") + 1
    return -F.ln(number.cast("double") / F.lit(2.0**52 + 1)) / quality


def mix_sources(
    docs: DataFrame,
    *,
    quality: DataFrame | None = None,
    weights: Sequence[int] = WEIGHTS,
    share: float = SHARE,
    most: float = MOST,
    seed: int = 7,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
) -> DataFrame:
    """Decide how many words of each document the mix takes, repeats counted.

    Returns one row per distinct (doc_id, source, version), where version is a hash of the text: copies (input
    rows alike in these), size, source_size, target, epochs (complete passes of its source), part (words the
    fractional pass takes from each copy) and taken = size * epochs + part. ``quality`` holds (doc_id,
    quality), one row per id; ids without a weight above 0 get UNKNOWN_QUALITY. The fractional pass
    takes documents by ascending exponential key until the source's budget is met; the last one gives only
    its first words, so a source meets its target to the word (repeated rows share the last part evenly,
    rounded down). Nothing exceeds ``most`` complete passes. Null and empty texts have size 0 and take nothing. A null
    source is a source of its own, last in order. Equal keys order by id, size and version. The keys are
    hashes of id and seed, so reruns agree. No rows give no rows; other columns are ignored.

    Keys are cut into slices. Sums per (source, slice) find the one slice where a source's budget ends, and only
    that slice's rows are sorted, so a source with a third of all rows is never ordered in one task.
    Per-source rows reach the documents by broadcast for the few hot sources, by a shuffled join for others.
    """
    text = F.col(text_column)
    rows = docs.select(
        F.col(id_column).alias("doc_id"), F.col(source_column).cast("string").alias("source"), F.xxhash64(text).alias("version"), word_count(text).alias("size")
    )
    units = rows.groupBy("doc_id", "source", "version", "size").agg(F.count(F.lit(1)).alias("copies"))
    if quality is None:
        units = units.withColumn("quality", F.lit(UNKNOWN_QUALITY))
    else:
        units = units.join(quality.select("doc_id", "quality").filter("quality > 0"), "doc_id", "left")
        units = units.withColumn("quality", F.coalesce("quality", F.lit(UNKNOWN_QUALITY)))
    units = units.withColumn("key", sampling_key(F.col("doc_id"), F.col("quality"), seed)).drop("quality")
    units = units.withColumn("words", F.col("size") * F.col("copies"))
    # 1 - exp(-key / 2) spreads the keys over [0, 1) in their order
    units = units.withColumn("slice", F.floor((F.lit(1.0) - F.exp(-F.col("key") / 2)) * SLICES).cast("int"))
    # a null source joins as a key of its own
    units = units.withColumn("name", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")))
    units = written(units, "mix-units")

    slices = units.groupBy("name", "source", "slice").agg(F.sum("words").alias("words"), F.count(F.lit(1)).alias("units"))
    slices = written(slices, "mix-slices")
    sizes = slices.groupBy("name", "source").agg(F.sum("words").alias("source_size"), F.sum("units").alias("units"))
    targets = written(source_targets(sizes, weights, share, most), "mix-targets")
    through = Window.partitionBy("name").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    edges = slices.select("name", "slice", "words", F.coalesce(F.sum("words").over(through), F.lit(0)).alias("below"))
    edges = edges.join(targets.select("name", "extra"), "name")
    edges = edges.filter((F.col("below") < F.col("extra")) & (F.col("extra") <= F.col("below") + F.col("words")))
    targets = targets.join(edges.select("name", F.col("slice").alias("last"), "below"), "name", "left")
    targets = written(targets.drop("source"), "mix-limits")

    placed = join_counted(units, targets, ["name"], "units", units.count())
    at_edge = F.col("slice").eqNullSafe(F.col("last"))
    in_order = Window.partitionBy("name", "slice").orderBy("key", "doc_id", "size", "version")
    so_far = F.sum("words").over(in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    left = F.col("extra") - (F.col("below") + so_far - F.col("words"))
    edge = placed.filter(at_edge).withColumn("part", F.floor(F.greatest(F.lit(0), F.least(F.col("words"), left)) / F.col("copies")).cast("long"))
    plain = placed.filter(~at_edge).withColumn("part", F.when(F.col("slice") < F.col("last"), F.col("size")).otherwise(F.lit(0)).cast("long"))
    columns = ["doc_id", "source", "version", "copies", "size", "source_size", "target", "epochs", "part"]
    settled = edge.select(columns).unionByName(plain.select(columns))
    return settled.withColumn("taken", F.col("size") * F.col("epochs") + F.col("part"))


def quality_weights(labels: DataFrame) -> DataFrame:
    """(doc_id, quality weight) from labels; the best label of an id counts."""
    best = labels.filter("doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("label"))
    weight = F.when(F.col("label") == 1, QUALITY[1]).when(F.col("label") == 0, QUALITY[0])
    return best.select("doc_id", weight.alias("quality"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mix_sources(table(spark, sf_dir, "documents"), quality=quality_weights(table(spark, sf_dir, "labels")))
    rows = mix.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return rows.select("doc_id", "size", "source_size", "target", "taken")

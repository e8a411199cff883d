"""From documents to packed training sequences: every stage is written and reread as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from dairyframe.llm import bigru_language, coordinate_near_dedup, efraimidis_mix, ffd_packing, line_runs
from dairyframe.llm.common import id_crc_mod, table, written

#: Trained and hashed stages can't be written in SQL; tests/llm compares them with plain versions.
ORACLE_SQL = None


#: A text of so many characters whose pooled language probability stays below the floor is in none of the learned languages. Chosen on
#: documents the network is trained on: texts in one language score 0.5 and more, mixed ones down to 0.42, and those have to stay;
#: shorter texts are never judged by it.
LONG_ENOUGH, FLOOR = 200, 0.4


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no recognisable language go; a missing ``lang`` becomes the predicted one.

    That is: texts without any letter (null and empty ones too), and texts of LONG_ENOUGH characters or more for which the network gives
    no language FLOOR of the probability. Rows that repeat an id are judged each by their own text. No rows give no rows.
    """
    model = bigru_language.fit(docs.filter(id_crc_mod("doc_id", 4) != 2))
    sure = (F.length("row.text") < LONG_ENOUGH) | (F.col("score") >= FLOOR)
    found = bigru_language.identify(docs, model).filter((F.col("lang_pred") != bigru_language.UNDETERMINED) & sure)
    lang = F.coalesce("row.lang", "lang_pred").alias("lang")
    return found.select(*[lang if c == "lang" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of at least 20 characters found in 3 documents or more stay in the largest doc_id only; n_chars follows.

    No document goes, also if all its lines do. Rows that repeat an id are one document for the count and each keep their other
    lines. No rows give no rows.
    """
    cut = line_runs.line_dedup(docs)
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return cut.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at 0.8 one stays, as one row.

    Rows are told apart by id and text, by a 64-bit hash of both: rows that repeat an id, or have none, with different texts are
    documents of their own; rows alike in both are copies. Texts without a word are linked with nothing, so each stays once per id.
    Equal rows are reduced where they lie before they are shuffled. No rows give no rows.
    """
    key = F.xxhash64(F.col("doc_id").isNull(), "doc_id", F.coalesce("text", F.lit("")))
    keyed = docs.select(key.alias("key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    groups = coordinate_near_dedup.near_groups(keyed.select("key", "row.text"), shingle=5, similar=80, id_column="key")
    kept = groups.filter("kept").select(F.col("doc_id").alias("key"))
    one = keyed.groupBy("key").agg(F.first("row").alias("row"))
    return one.join(kept, "key", "left_semi").select("row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Complete epochs repeat a document's row; the fractional pass adds one more, cut where its source's target ends.

    Texts without a word take part in no mix and go. A null source is a source; rows that repeat an id are mixed each by their
    own text; ties of the random keys are broken by id and text, so reruns agree. No rows give no rows.
    """
    weights = efraimidis_mix.quality_weights(table(spark, sf_dir, "labels"))
    mix = efraimidis_mix.mix_sources(docs, quality=weights)
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.col("doc_id").alias("i"),
        F.col("source").cast("string").alias("s"),
        F.xxhash64("text").alias("v"),
    )
    same = F.col("i").eqNullSafe(F.col("doc_id")) & F.col("s").eqNullSafe(F.col("source")) & (F.col("v") == F.col("version"))
    taken = rows.join(mix, same)
    # copy 0 is the cut one, the others are whole
    partial = (F.col("part") > 0) & (F.col("part") < F.col("size"))
    whole = (F.col("epochs") + (F.col("part") == F.col("size")).cast("long")).cast("int")
    copies = F.array_repeat(F.lit(1), whole)
    copies = F.when(partial, F.concat(F.array(F.lit(0)), copies)).otherwise(copies)
    taken = taken.filter("size > 0").withColumn("__copy", F.explode(copies))
    words = F.filter(F.split(F.col("row.text"), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    head = F.array_join(F.slice(words, F.lit(1), F.greatest(F.col("part"), F.lit(1)).cast("int")), " ")
    text = F.when(F.col("__copy") == 0, head).otherwise(F.col("row.text"))
    new = {"text": text, "n_chars": F.length(text).cast("long")}
    return taken.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 1024 tokens; a null or empty text is its closing token alone. No rows give no pieces."""
    return ffd_packing.pack(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

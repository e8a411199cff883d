"""Scores of the trained models against plain forward passes, and pipeline stages on odd tables."""

import glob
import math
import os
import random
import re
import tempfile

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from dairyframe.llm import bigru_language as lang, counterfactual_toxicity as tox

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def slow_scores(model, data):
    """Pooled language probabilities of one text, position by position, one span after the other."""

    def soft(x):
        return x / (1 + abs(x))

    def states(w, span, order):
        size, h, out = w["u"].shape[0], np.zeros(w["u"].shape[0]), {}
        for t in order:
            a, g = w["e"][span[t]].astype(float), h @ w["u"].astype(float)
            z = 0.5 + 0.5 * soft(a[:size] + g[:size])
            r = 0.5 + 0.5 * soft(a[size : 2 * size] + g[size : 2 * size])
            n = soft(a[2 * size :] + r * g[2 * size :])
            h = (1 - z) * n + z * h
            out[t] = h
        return out

    pooled = np.zeros(len(model.languages))
    for at in range(0, len(data), lang.SPAN):
        # short spans are filled with byte 0, which the backward pass reads first
        span = data[at : at + lang.SPAN].ljust(lang.SPAN, b"\0")
        there = states(model.forward, span, range(lang.SPAN))
        back = states(model.backward, span, range(lang.SPAN - 1, -1, -1))
        for t in range(lang.SPAN):
            if span[t]:
                logits = there[t] @ model.forward["o"] + back[t] @ model.backward["o"] + model.b
                p = np.exp(logits - logits.max())
                pooled += p / p.sum()
    return pooled / pooled.sum()


def test_language_query_equals_a_slow_forward_pass(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = lang.fit(docs.filter(lang.id_crc_mod("doc_id", 4) != 2))
    texts = {r.doc_id: r.text for r in docs.collect()}
    found = {r.doc_id: r for r in lang.query(spark, SF).collect()}
    assert found.keys() == texts.keys()
    for i in random.Random(1).sample(sorted(texts), 12):
        scores = slow_scores(model, (texts[i] or "")[:2000].encode())
        whole = lang.document_scores(model, [(texts[i] or "")[:2000].encode()])[0]
        assert np.allclose(scores, whole, atol=1e-4)
        if len(texts[i] or "") <= 2000:
            assert found[i].lang_pred == model.languages[int(scores.argmax())] and abs(found[i].score - scores.max()) < 1e-4


def test_languages_share_the_sample(spark):
    docs = spark.range(400).select("id", F.concat(F.lit("word "), F.col("id")).alias("text"), (F.col("id") % 40).cast("string").alias("lang")).toDF("doc_id", "text", "lang")
    assert len(lang.fit(docs, per_language=3).languages) == 40


def slow_toxicity(model, text):
    low = text.lower()
    best = model.bias
    for sentence in re.split(r"[.!?\n]+", low):
        words = set(re.findall(r"[^\W\d_]+", sentence))
        best = max(best, model.bias + sum(w for word, w in model.weights.items() if word in words))
        if all(word not in low for word in model.weights):
            best = model.bias
    return 1 / (1 + math.exp(-best))


def test_toxicity_query_equals_plain_scores(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    held = tox.id_crc_mod("doc_id", 3) == 1
    model = tox.fit(docs.filter(~held), labels.filter(~held))
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in tox.query(spark, SF).collect():
        assert abs(r.score - slow_toxicity(model, texts[r.doc_id])) < 1e-9 and r.predicted == int(r.score >= 0.7)


def test_toxicity_scores_with_a_known_model(spark):
    model = tox.Classifier({"trash": 2.0, "good": -3.0, "ärger": 1.0, "trashy": 0.5}, -1.0)
    texts = ["", "trash", "Trash good", "trash. good", "trashy ÄRGER trash!", "a\ntrash b", "trash1 trash_x", "good", "x" * 100_000 + " trash", None, "good. good"]
    docs = spark.createDataFrame([(i % 9, t, "k") for i, t in enumerate(texts)], "doc_id long, text string, score string")
    got = sorted((r.doc_id, round(r.score, 9)) for r in tox.score_documents(docs, model).collect())
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        sentences = [set(re.findall(r"[^\W\d_]+", s)) for s in re.split(r"[.!?\n]+", (t or "").lower())]
        inside = [sum(model.weights[w] for w in s if w in model.weights) for s in sentences if s & set(model.weights)]
        empty = len(inside) < len(sentences)
        best = max([*inside, 0.0] if empty or not inside else inside) + model.bias
        assert any(d == i % 9 and abs(s - 1 / (1 + math.exp(-best))) < 1e-8 for d, s in got), t


def test_more_bags_than_the_sample_are_weighted_up(spark):
    rows = [([], 0, 900)] + [([f"w{i}"], i % 2, 1 + i % 3) for i in range(4000)]
    bags = spark.createDataFrame(rows, "bag array<string>, toxic int, count long")
    every, some = tox.sampled_bags(bags, 10_000), tox.sampled_bags(bags, 500)
    assert len(every) == 4001 and sum(n for _, _, n in every) == 900 + sum(1 + i % 3 for i in range(4000))
    assert 400 < len(some) < 620 and (set(), 0, 900) in some
    assert abs(sum(n for _, _, n in some) / sum(n for _, _, n in every) - 1) < 0.15


def test_more_words_than_any_old_bound_carry_weight(spark):
    """1,200 toxic words, each in twelve documents: all are learned."""
    docs = spark.range(28_800).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") % 2 == 0, F.concat(F.lit("bad"), F.translate((F.col("id") / 2 % 1200).cast("int").cast("string"), "0123456789", "abcdefghij"), F.lit(" common text "), F.translate(F.col("id").cast("string"), "0123456789", "klmnopqrst")))
        .otherwise(F.concat(F.lit("nice common text "), F.translate(F.col("id").cast("string"), "0123456789", "klmnopqrst"))).alias("text"),
    )
    # many plain sentences make a toxic word stand out
    plain = spark.range(30_000, 110_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("plain "), F.translate(F.col("id").cast("string"), "0123456789", "klmnopqrst")).alias("text"))
    every = docs.unionByName(plain)
    labels = every.select("doc_id", (F.col("text").startswith("bad")).cast("int").alias("toxic"))
    model = tox.fit(every, labels, terms=())
    words = [w for w in model.weights if w.startswith("bad")]
    assert len(words) == 1200 and min(model.weights[w] for w in words) > 0


def test_the_filter_loses_no_labelled_text(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("a text").alias("text"))
    marks = spark.range(0, 20_000, 100).select(F.col("id").cast("int").alias("doc_id"))
    for bits, most in ((tox.FILTER_BITS, 202), (1 << 12, 1500), (64, 20_000)):
        passed = [r.doc_id for r in tox.maybe_labelled(docs, marks, bits).collect()]
        assert len(passed) == len(set(passed)) <= most and set(passed) >= set(range(0, 20_000, 100))


def test_labelled_sentences_equal_plain_code(spark):
    texts = ["Bad one. bad two!", "bad one. Good", None, "", "good\n\nBAD one", "12. 3!", "Ärger x_y", "never labelled. bad one"]
    docs = [(i, t) for i, t in enumerate(texts)] + [(1, "second text of an id. good"), (None, "no id. bad one"), (-5, "bad one")]
    labels = [(0, 1), (1, 0), (1, 1), (2, 1), (3, 0), (4, 0), (5, 1), (6, None), (6, 0), (None, 1), (-5, 1), (99, 1)]
    toxic, want = {}, {}
    for i, y in labels:
        if i is not None and y is not None:
            toxic[i] = max(toxic.get(i, 0), y)
    for i, t in docs:
        for sentence in re.split(r"[.!?\n]+", (t or "").lower()):
            if i in toxic and re.search(r"[^\W\d_]", sentence):
                want[sentence, toxic[i]] = tuple(sorted(set(re.findall(r"[^\W\d_]+", sentence)))), toxic[i]
    made = tox.labelled_sentences(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert sorted((tuple(sorted(r.words)), r.toxic) for r in made.collect()) == sorted(want.values())
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert tox.labelled_sentences(spark.createDataFrame(docs, "doc_id long, text string"), none).count() == 0


def test_texts_without_a_label_are_not_shuffled(spark, tmp_path):
    """8 MB of texts, one in a hundred labelled: what the join writes to disk is a small part of them."""
    noise = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(64)), lambda k: F.sha2(F.concat_ws(" ", k, "id").cast("binary"), 256)), " ")
    spark.range(2000).select(F.col("id").alias("doc_id"), noise.alias("text")).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.range(0, 2000, 100).select(F.col("id").alias("doc_id"), (F.col("id") % 200 == 0).cast("int").alias("toxic"))
    folder = os.environ.get("SPARK_LOCAL_DIRS") or spark.conf.get("spark.local.dir", tempfile.gettempdir())
    files = lambda: {f for part in folder.split(",") for f in glob.glob(f"{part}/blockmgr-*/*/shuffle_*.data")}
    before = files()
    assert tox.labelled_sentences(docs, labels).count() == 20
    assert 0 < sum(os.path.getsize(f) for f in files() - before) < 1_000_000


def test_near_stage_keeps_unrelated_texts_of_one_id(spark):
    texts = [" ".join(f"{w}{i}" for i in range(30)) for w in ("alpha", "beta", "gamma", "delta")]
    rows = [(None, texts[0], "en", "a", 1), (None, texts[1], "en", "a", 1), (7, texts[2], "en", "a", 1), (7, texts[3], "en", "a", 1), (7, texts[3], "en", "a", 1), (8, texts[2] + " end", "en", "a", 1), (9, None, None, None, None), (9, "", None, None, None)]
    got = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, DOCS), SF).collect()
    assert sum((r.text or "").startswith("alpha") for r in got) == sum((r.text or "").startswith("beta") for r in got) == 1
    assert sum((r.text or "").startswith("gamma") for r in got) == sum((r.text or "").startswith("delta") for r in got) == 1
    assert sum(not r.text for r in got) == 1


def test_language_stage_rejects_long_texts_below_the_floor(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    everything = {r.doc_id for r in docs.filter(F.col("text").rlike("\\p{L}")).collect()}
    kept = lambda: {r.doc_id for r in corpus_pipeline.language_id(spark, docs, SF).select("doc_id").collect()}
    assert kept() == everything  # clean documents all stay
    monkeypatch.setattr(corpus_pipeline, "FLOOR", 0.97)
    model = lang.fit(docs.filter(lang.id_crc_mod("doc_id", 4) != 2))
    scores = lang.identify(docs, model).select("row.doc_id", "row.text", "score").collect()
    low = {r.doc_id for r in scores if r.doc_id in everything and len(r.text) >= corpus_pipeline.LONG_ENOUGH and r.score < 0.97}
    assert low and kept() == everything - low


def test_every_stage_takes_an_empty_table(spark):
    none = spark.createDataFrame([], DOCS)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, none, SF)
        assert out.count() == 0 and (name == "packing" or out.columns == none.columns)

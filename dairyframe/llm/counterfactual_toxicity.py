"""Toxicity scores by a classifier that is penalised when swapping identity terms changes its score."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from dairyframe.llm.common import id_crc_mod, table, written

NAME = "op2_toxicity"
ORACLE = None
THRESHOLD = 0.7
#: About how many distinct bags of chosen words, with label and count, the driver fits on; beyond that a hashed sample of them is weighted up.
SAMPLE_BAGS = 20_000
#: A word may carry a weight if the likelihood ratio (G) of its use in toxic and other sentences reaches STANDOUT, at least
#: this share of the sentences that hold it is toxic, and they come from several documents. None depends on the input's size.
STANDOUT = 30.0
LEAST_SHARE = 0.8
LEAST_DOCUMENTS = 5
#: Bits of the filter that holds back unlabelled texts before the join with the labels; its size does not depend on the data.
FILTER_BITS = 1 << 25
#: Neutral words for groups of people, one list per kind of group. Terms of a list stand in for each other.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys", "woman", "man"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("gay", "lesbian", "bisexual", "transgender", "straight"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("immigrants", "refugees", "foreigners", "citizens"),
    ("disabled", "blind", "deaf", "elderly", "young"),
    ("frauen", "männer", "mädchen", "jungen"),
    ("christen", "muslime", "juden", "hindus"),
    ("femmes", "hommes", "filles", "garçons"),
    ("chrétiens", "musulmans", "juifs", "hindous"),
    ("mujeres", "hombres", "niñas", "niños"),
    ("cristianos", "musulmanes", "judíos", "hindúes"),
)
WORD = re.compile(r"[^\W\d_]+")
SENTENCE = re.compile(r"[.!?\n]+")


@dataclass
class Classifier:
    """A logistic model over the words of a sentence."""

    weights: dict[str, float]
    bias: float


def swaps(words: set[str], terms: Sequence[Sequence[str]]) -> list[set[str]]:
    """Sentences with one identity term replaced by each other term of its list."""
    made = []
    for group in terms:
        for term in group:
            if term in words:
                made += [(words - {term}) | {other} for other in group if other != term]
    return made


def likelihood_ratio(toxic: int, other: int, rate: float) -> float:
    """G statistic of a word found in so many toxic and other sentences against the share of toxic ones; 0 if it isn't above."""
    n = toxic + other
    if not 0 < rate < 1 or toxic <= rate * n:
        return 0.0
    return 2 * (toxic * np.log(toxic / (rate * n)) + (other * np.log(other / ((1 - rate) * n)) if other else 0.0))


def fit_sentences(
    sentences: Sequence[tuple[str, int]],
    *,
    terms: Sequence[Sequence[str]] = IDENTITY_TERMS,
    penalty: float = 10.0,
    standout: float = STANDOUT,
    least_share: float = LEAST_SHARE,
) -> Classifier:
    """Fit (sentence, label) pairs that fit in memory; repeated sentences count once per label."""
    bags = sorted({(frozenset(WORD.findall(s.lower())), y) for s, y in sentences}, key=lambda p: (p[1], sorted(p[0])))
    bags = [(set(b), y, 1) for b, y in bags if b]
    counts: dict[str, list[int]] = {}
    for bag, y, _ in bags:
        for word in bag:
            counts.setdefault(word, [0, 0])[y] += 1
    rate = sum(y for _, y, _ in bags) / max(1, len(bags))
    chosen = {w for w, (n0, n1) in counts.items() if n1 >= least_share * (n0 + n1) and likelihood_ratio(n1, n0, rate) >= standout}
    return fit_bags(bags, chosen, terms=terms, penalty=penalty)


def fit_bags(
    bags: Sequence[tuple[set[str], int, float]],
    chosen: set[str],
    *,
    terms: Sequence[Sequence[str]] = IDENTITY_TERMS,
    penalty: float = 10.0,
    shrink: float = 1.0,
    rounds: int = 400,
) -> Classifier:
    """Weights of the ``chosen`` words from (words, label, number of sentences).

    ``penalty`` weighs squared score changes under identity swaps; identity terms found in a bag are always in, so
    the penalty acts on them.
    """
    if not bags:
        return Classifier({}, -2.0)
    seen = set().union(*(b for b, _, _ in bags))
    chosen = chosen | {t for group in terms for t in group if t in seen}
    swapped_terms = {t for group in terms for t in group if chosen & set(group)}
    vocabulary = {w: i for i, w in enumerate(sorted(chosen | swapped_terms))}
    labels, weight = np.array([y for _, y, _ in bags], float), np.array([n for _, _, n in bags], float)
    toxic, every = float(labels @ weight), float(weight.sum())

    def pairs(sets: list[set[str]]) -> tuple[np.ndarray, np.ndarray]:
        found = [(i, vocabulary[w]) for i, bag in enumerate(sets) for w in sorted(bag) if w in vocabulary]
        both = np.array(found, np.int64).reshape(-1, 2)
        return both[:, 0], both[:, 1]

    plain, other, times = [], [], []
    for bag, _, n in bags:
        for changed in swaps(bag, terms):
            plain.append(bag)
            other.append(changed)
            times.append(n)
    rows, cols = pairs([b for b, _, _ in bags])
    r0, c0 = pairs(plain)
    r1, c1 = pairs(other)
    n, size, many = len(bags), len(vocabulary), len(plain)
    pull = 2 * penalty * np.array(times, float) / max(1, sum(times))
    w, bias = np.zeros(size), float(np.log((toxic + 1) / (every - toxic + 1)))
    m, v = np.zeros(size + 1), np.zeros(size + 1)
    for step in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-(np.bincount(rows, weights=w[cols], minlength=n) + bias)))
        error = (p - labels) * weight / every
        grad = np.bincount(cols, weights=error[rows], minlength=size) + shrink * w / every
        if many:
            change = (np.bincount(r0, weights=w[c0], minlength=many) - np.bincount(r1, weights=w[c1], minlength=many)) * pull
            grad += np.bincount(c0, weights=change[r0], minlength=size) - np.bincount(c1, weights=change[r1], minlength=size)
        g = np.append(grad, error.sum())
        m += 0.1 * (g - m)
        v += 0.001 * (g * g - v)
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-10)
        w -= move[:-1]
        bias -= float(move[-1])
    return Classifier({k: float(w[i]) for k, i in vocabulary.items() if w[i]}, bias)


def maybe_labelled(texts: DataFrame, marks: DataFrame, filter_bits: int = FILTER_BITS) -> DataFrame:
    """The rows of ``texts`` whose id may be in ``marks``: all that are, and the few others whose hash meets one of theirs.

    The join with the labels shuffles whole texts, so those that cannot have one are left where they are. Every task gets
    ``filter_bits`` bits at most, however many labels there are; the join itself decides.
    """
    place = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(filter_bits))
    bits = marks.select(place.alias("place")).groupBy(F.bitmap_bucket_number("place").alias("bucket"))
    bits = bits.agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits"))
    at = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.substr("bits", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    passed = (F.bitmap_bucket_number(place) == F.col("bucket")) & (F.getbit(byte, (at % 8).cast("int")) == 1)
    return texts.join(F.broadcast(bits), passed, "left_semi")


def labelled_sentences(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(words, toxic, slot): the distinct words of every sentence of the labelled documents, equal sentences once per label.

    ``slot`` is one bit of 64 by the smallest id that holds the sentence.
    """
    marks = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    texts = maybe_labelled(docs.filter(F.col("text").isNotNull()).select("doc_id", "text"), marks)
    # labels grow with the documents, so they are joined alike at every size
    rows = texts.join(marks.hint("merge"), "doc_id").select("doc_id", "toxic", F.explode(F.split(F.lower("text"), "[.!?\n]+")).alias("sentence"))
    rows = rows.filter(F.col("sentence").rlike("\\p{L}")).groupBy("sentence", "toxic").agg(F.min("doc_id").alias("doc_id"))
    words = F.array_remove(F.array_distinct(F.split("sentence", "\\P{L}+")), "")
    slot = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64("doc_id"), F.lit(64)).cast("int"))
    return rows.select(words.alias("words"), "toxic", slot.alias("slot"))


def standout_words(sentences: DataFrame, rate: float) -> list[str]:
    """The words of toxic sentences, by likelihood ratio over all ``sentences``: every word that passes, in order."""
    if not 0 < rate < 1:
        return []
    n1, n = F.col("n1"), F.col("n")
    counts = sentences.select(F.explode("words").alias("word"), "toxic", "slot").groupBy("word")
    counts = counts.agg(F.sum("toxic").alias("n1"), F.count(F.lit(1)).alias("n"), F.bit_or("slot").alias("slots"))
    counts = counts.filter((n1 >= LEAST_SHARE * n) & (n1 > rate * n) & (F.bit_count("slots") >= LEAST_DOCUMENTS))
    rest = F.when(n > n1, (n - n1) * F.log((n - n1) / ((1 - rate) * n))).otherwise(0.0)
    counts = counts.withColumn("g", 2 * (n1 * F.log(n1 / (rate * n)) + rest)).filter(F.col("g") >= STANDOUT)
    return sorted(r.word for r in counts.select("word").collect())


def sampled_bags(bags: DataFrame, most: int = SAMPLE_BAGS) -> list[tuple[set[str], int, float]]:
    """(words, label, weight) of written ``bags`` (bag, toxic, count): all of them, or about ``most`` if there are more.

    Each bag is in the sample by the hash of its words and label, all at one rate, and weighs its count over that rate, so rare words
    are as likely to be heard as common ones. The empty bag, which holds most sentences, is always in.
    """
    rate = min(1.0, most / max(1, bags.count()))
    chance = F.pmod(F.xxhash64("bag", "toxic"), F.lit(1 << 30)) / float(1 << 30)
    found = bags.filter((F.size("bag") == 0) | (chance < rate)).orderBy("toxic", "bag").collect()
    return [(set(r.bag), r.toxic, r["count"] / (rate if r.bag else 1.0)) for r in found]


def fit(
    docs: DataFrame, labels: DataFrame, *, terms: Sequence[Sequence[str]] = IDENTITY_TERMS, penalty: float = 10.0, sample: int = SAMPLE_BAGS
) -> Classifier:
    """Train on the sentences of all labelled documents; a sentence has its document's label.

    ``labels`` holds (doc_id, toxic), one row per id (the largest label counts); null labels are left out. Words are counted
    and chosen by Spark over all these sentences, and so are the combinations of chosen words and identity terms. The driver gets the
    chosen words, which are the model, and about ``sample`` combinations with their counts, on which it fits the weights.
    """
    sentences = written(labelled_sentences(docs, labels), "toxicity-sentences", codec="zstd")
    totals = {r.toxic: r["count"] for r in sentences.groupBy("toxic").count().collect()}
    if not totals:
        return Classifier({}, -2.0)
    chosen = standout_words(sentences, totals.get(1, 0) / sum(totals.values()))
    known = sorted({*chosen, *(t for group in terms for t in group)})
    bag = F.array_sort(F.filter("words", lambda w: w.isin(known)))
    bags = written(sentences.select(bag.alias("bag"), "toxic").groupBy("bag", "toxic").count(), "toxicity-bags")
    return fit_bags(sampled_bags(bags, sample), set(chosen), terms=terms, penalty=penalty)


def score_text(text: str, model: Classifier, finder) -> float:
    """The highest sentence score; words the model doesn't know add nothing. ``finder`` is an automaton of its words."""
    low = text.lower()
    hits = []
    for end, word in finder.iter(low):
        start = end - len(word) + 1
        if (start == 0 or not low[start - 1].isalpha()) and (end + 1 == len(low) or not low[end + 1].isalpha()):
            hits.append((start, word))
    best = model.bias
    if hits:
        edges = [m.start() for m in SENTENCE.finditer(low)]
        owner = np.searchsorted(edges, [s for s, _ in hits])
        by_sentence: dict[int, set[str]] = {}
        for s, (_, word) in zip(owner, hits):
            by_sentence.setdefault(int(s), set()).add(word)
        found = [model.bias + sum(model.weights[w] for w in sorted(words)) for words in by_sentence.values()]
        best = max(found) if len(by_sentence) > len(edges) else max([best, *found])
    return float(1 / (1 + np.exp(-np.clip(best, -500, 500))))


def word_finder(model: Classifier):
    import ahocorasick

    finder = ahocorasick.Automaton()
    for word in model.weights or {"": 0.0}:
        if word:
            finder.add_word(word, word)
    finder.make_automaton()
    return finder


def score_documents(docs: DataFrame, model: Classifier, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id and score (0 to 1) of every row's whole text: that of its most toxic sentence.

    Null and empty texts, and texts without a known word, get the base score. One row per input row; repeated rows get
    equal scores. Other columns are ignored. The model is a few hundred words, so it travels with the tasks.
    """
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = word_finder(model)
        for batch in batches:
            if len(finder):
                values = [score_text(x.as_py(), model, finder) for x in batch.column("text")]
            else:
                values = [float(1 / (1 + np.exp(-model.bias)))] * batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(values, pa.float64())], names=["doc_id", "score"])

    return rows.mapInArrow(score, "doc_id long, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = id_crc_mod("doc_id", 3) == 1
    model = fit(docs.filter(~held), labels.filter(~held))
    scored = score_documents(docs, model)
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))

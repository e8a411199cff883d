"""Language ID by a bidirectional gated recurrent network over bytes."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from dairyframe.llm.common import id_crc_mod, table

NAME = "op4_language_id"
ORACLE = None
UNDETERMINED = "und"
#: Bytes the network reads in one go; a text is cut into consecutive spans of this length.
SPAN = 64
HIDDEN = 8
#: Bounds of the training sample: documents per language, and spans taken from each.
SAMPLE_PER_LANGUAGE = 1500
SPANS_PER_DOCUMENT = 2
#: Bound of the sample over all languages; many languages share it evenly.
SAMPLE = 20_000
LANES = 4096
SLICES = 64


@dataclass
class BiGRU:
    """Weights per direction: e (256 x 3H: input with bias for update, reset, candidate), u (H x 3H), o (H x C); b (C)."""

    languages: list[str]
    forward: dict[str, np.ndarray]
    backward: dict[str, np.ndarray]
    b: np.ndarray


def _soft(x: np.ndarray) -> np.ndarray:
    """x / (1 + abs(x)): stands in for tanh, and 0.5 + 0.5 of it for the logistic function; far cheaper per byte."""
    return x / (1 + np.abs(x))


def _run(w: dict[str, np.ndarray], x: np.ndarray, order: Sequence[int]) -> tuple[np.ndarray, list]:
    """Hidden state after each position (T, B, H) and what back-propagation needs."""
    size = w["u"].shape[0]
    h = np.zeros((x.shape[0], size), np.float32)
    out, kept = np.empty((x.shape[1], x.shape[0], size), np.float32), []
    for t in order:
        a, g = w["e"][x[:, t]], h @ w["u"]
        zr = 0.5 + 0.5 * _soft(a[:, : 2 * size] + g[:, : 2 * size])
        z, r = zr[:, :size], zr[:, size:]
        n = _soft(a[:, 2 * size :] + r * g[:, 2 * size :])
        kept.append((h, z, r, n, g[:, 2 * size :]))
        h = n + z * (h - n)
        out[t] = h
    return out, kept


def _back(w: dict[str, np.ndarray], x: np.ndarray, order: Sequence[int], kept: list, dout: np.ndarray) -> dict[str, np.ndarray]:
    """Gradients by back-propagation through time."""
    size = w["u"].shape[0]
    du = np.zeros_like(w["u"])
    da = np.empty((x.shape[1], x.shape[0], 3 * size), np.float32)
    dh = np.zeros((x.shape[0], size), np.float32)
    for t, (h, z, r, n, gn) in zip(reversed(order), reversed(kept)):
        dh = dh + dout[t]
        dn = dh * (1 - z) * (1 - np.abs(n)) ** 2
        dz = dh * (h - n) * 0.5 * (1 - np.abs(2 * z - 1)) ** 2
        dr = dn * gn * 0.5 * (1 - np.abs(2 * r - 1)) ** 2
        da[t] = np.concatenate([dz, dr, dn], 1)
        dg = np.concatenate([dz, dr, dn * r], 1)
        du += h.T @ dg
        dh = dh * z + dg @ w["u"].T
    at, flat = x.T.ravel(), da.reshape(-1, 3 * size)
    de = np.stack([np.bincount(at, weights=flat[:, j], minlength=256) for j in range(3 * size)], 1)
    return {"e": de.astype(np.float32), "u": du}


def train(spans: np.ndarray, labels: np.ndarray, languages: list[str], *, hidden: int = HIDDEN, steps: int = 320, rate: float = 0.02, seed: int = 4) -> BiGRU:
    """Fit spans (N, SPAN) of bytes, each position labelled with its span's language; byte 0 fills short spans.

    Adam on the mean cross-entropy of all filled positions, whole epochs until ``steps`` batches are done.
    """
    rng = np.random.default_rng(seed)
    classes = len(languages)

    def start() -> dict[str, np.ndarray]:
        made = {"e": rng.normal(0, 0.3, (256, 3 * hidden)), "u": rng.normal(0, 0.3, (hidden, 3 * hidden)), "o": rng.normal(0, 0.3, (hidden, classes))}
        return {k: v.astype(np.float32) for k, v in made.items()}

    f, r, b = start(), start(), np.zeros(classes, np.float32)
    weights = [f["e"], f["u"], f["o"], r["e"], r["u"], r["o"], b]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    there, back, step, batch = list(range(spans.shape[1])), list(range(spans.shape[1]))[::-1], 0, 192
    per_epoch = max(1, -(-len(spans) // batch))
    total = per_epoch * -(-steps // per_epoch) if len(spans) else 0
    for _ in range(total // per_epoch):
        for rows in np.array_split(rng.permutation(len(spans)), per_epoch):
            x, y = spans[rows], labels[rows]
            hf, kf = _run(f, x, there)
            hr, kr = _run(r, x, back)
            logits = hf @ f["o"] + hr @ r["o"] + b
            logits -= logits.max(-1, keepdims=True)
            p = np.exp(logits)
            p /= p.sum(-1, keepdims=True)
            p[:, np.arange(len(y)), y] -= 1
            p *= (x.T != 0)[:, :, None] / np.float32(max(1, (x != 0).sum()))
            gf = _back(f, x, there, kf, p @ f["o"].T)
            gr = _back(r, x, back, kr, p @ r["o"].T)
            flat = p.reshape(-1, classes)
            grads = [gf["e"], gf["u"], hf.reshape(-1, hidden).T @ flat, gr["e"], gr["u"], hr.reshape(-1, hidden).T @ flat, flat.sum(0)]
            step += 1
            now = rate * (1 - step / (total + 1))
            for w, g, m, v in zip(weights, grads, first, second):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                w -= now * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return BiGRU(languages, f, r, b)


def _split(w: dict[str, np.ndarray]) -> tuple:
    """Weights per gate, each contiguous; the candidate's reset factor 0.5 is folded into its recurrent weights."""
    size = w["u"].shape[0]
    e = [np.ascontiguousarray(w["e"][:, i * size : (i + 1) * size]) for i in range(3)]
    u = [np.ascontiguousarray(w["u"][:, i * size : (i + 1) * size]) for i in range(3)]
    return e, [u[0], u[1], u[2] * np.float32(0.5)], w["o"]


def _add_logits(w: tuple, x: np.ndarray, order: Sequence[int], out: np.ndarray) -> None:
    """Add one direction's share to the logits ``out`` (T, B, C) for bytes ``x`` (T, B)."""
    (ez, er, en), (uz, ur, un), o = w
    size, lanes = uz.shape[0], x.shape[1]
    h = np.zeros((lanes, size), np.float32)
    a, g, n, m = (np.empty((k, lanes, size), np.float32) for k in (2, 2, 1, 1))
    n, m, one, half = n[0], m[0], np.float32(1), np.float32(0.5)
    share = np.empty((lanes, o.shape[1]), np.float32)
    for t in order:
        np.take(ez, x[t], axis=0, out=a[0], mode="clip")
        np.take(er, x[t], axis=0, out=a[1], mode="clip")
        np.matmul(h, uz, out=g[0])
        np.matmul(h, ur, out=g[1])
        a += g
        np.abs(a, out=g)
        g += one
        a /= g
        a += one  # twice the gates
        np.matmul(h, un, out=n)
        n *= a[1]
        np.take(en, x[t], axis=0, out=m, mode="clip")
        n += m
        np.abs(n, out=m)
        m += one
        n /= m
        h -= n
        a[0] *= half
        h *= a[0]
        h += n
        np.matmul(h, o, out=share)
        out[t] += share


def span_scores(model: BiGRU, x: np.ndarray) -> np.ndarray:
    """Sums over the filled positions of the language probabilities: (N, C) for spans (N, SPAN)."""
    f, r = _split(model.forward), _split(model.backward)
    sums = np.empty((len(x), len(model.languages)), np.float32)
    there = range(x.shape[1])
    for at in range(0, len(x), LANES):
        part = np.ascontiguousarray(x[at : at + LANES].T).astype(np.intp)
        logits = np.empty((*part.shape, len(model.languages)), np.float32)
        logits[:] = model.b
        _add_logits(f, part, there, logits)
        _add_logits(r, part, there[::-1], logits)
        np.exp(np.clip(logits, -60, 60), out=logits)
        total = logits.sum(-1)
        total = (part != 0) / total
        sums[at : at + LANES] = np.einsum("tbc,tb->bc", logits, total.astype(np.float32), optimize=False)
    return sums


def spans_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, span: int = SPAN) -> tuple[np.ndarray, np.ndarray]:
    """Texts data[starts:ends] cut into spans, short ones filled with byte 0, and the text each span belongs to."""
    counts = -(-(ends - starts) // span)
    owner = np.repeat(np.arange(len(starts)), counts)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    at = (starts[owner] + nth * span)[:, None] + np.arange(span)
    x = data[np.minimum(at, max(0, len(data) - 1))]
    return np.where(at < ends[owner][:, None], x, 0).astype(np.uint8), owner


def document_scores(model: BiGRU, texts: list[bytes]) -> np.ndarray:
    """Mean position probabilities per text (N, C); zeros for empty texts. Works in pieces of bounded size."""
    sums = np.zeros((len(texts), len(model.languages)))
    sizes = np.array([len(t) for t in texts], np.int64)
    i = 0
    while i < len(texts):
        j, held = i, 0
        while j < len(texts) and (j == i or held + sizes[j] <= 1 << 20):
            held += sizes[j]
            j += 1
        data = np.frombuffer(b"".join(texts[i:j]), np.uint8)
        ends = np.cumsum(sizes[i:j])
        for lo in range(0, max(1, int(held)), 1 << 22):  # a text beyond 4 MB goes span-aligned piece by piece
            hi = lo + (1 << 22)
            if held:
                s, e = np.clip(ends - sizes[i:j], lo, hi), np.clip(ends, lo, hi)
                x, owner = spans_of(data, s, e)
                np.add.at(sums, owner + i, span_scores(model, x))
        i = j
    return sums / np.maximum(1e-9, sums.sum(1, keepdims=True))


def training_spans(docs: DataFrame, *, id_column: str, text_column: str, lang_column: str, per_language: int, per_document: int) -> DataFrame:
    """(lang, span): spans at hashed places of about ``per_language`` documents of each language with small id hashes."""
    data = F.coalesce(F.col(text_column), F.lit("")).cast("binary")
    rows = docs.filter(F.col(lang_column).isNotNull() & F.col(text_column).rlike("\\p{L}"))
    last = F.greatest(F.lit(1), F.octet_length(data) - SPAN + 1)
    place = [F.substring(data, F.pmod(F.xxhash64(F.col(id_column), F.lit(i)), last).cast("int") + 1, F.lit(SPAN)) for i in range(per_document)]
    rows = rows.select(F.col(lang_column).cast("string").alias("lang"), F.xxhash64(id_column).alias("h"), F.array(*place).alias("spans"))
    # first within slices of a language, so that no task ranks all documents of one
    rows = rows.withColumn("slice", F.pmod(F.xxhash64("h"), F.lit(SLICES)))
    rank = F.row_number().over(Window.partitionBy("lang", "slice").orderBy("h", "spans"))
    rows = rows.withColumn("rank", rank).filter(F.col("rank") <= max(1, 4 * per_language // SLICES)).drop("rank")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "spans"))
    chosen = rows.withColumn("rank", rank).filter(F.col("rank") <= per_language)
    return chosen.select("lang", F.explode("spans").alias("span"))


def fit(
    docs: DataFrame,
    *,
    id_column: str = "doc_id",
    text_column: str = "text",
    lang_column: str = "lang",
    per_language: int = SAMPLE_PER_LANGUAGE,
    per_document: int = SPANS_PER_DOCUMENT,
) -> BiGRU:
    """Train on a bounded sample of the labelled rows of ``docs``: SPAN bytes from each of a few documents per language.

    A language gives at most ``per_language`` documents, and all together about SAMPLE, at least one each.
    """
    many = docs.agg(F.count_distinct(lang_column)).first()[0]
    per_language = max(1, min(per_language, SAMPLE // max(1, many)))
    sample = training_spans(
        docs, id_column=id_column, text_column=text_column, lang_column=lang_column, per_language=per_language, per_document=per_document
    ).collect()
    sample = sorted((r.lang, bytes(r.span)) for r in sample)
    languages = sorted({lang for lang, _ in sample})
    spans = np.zeros((len(sample), SPAN), np.uint8)
    for i, (_, part) in enumerate(sample):
        spans[i, : len(part)] = np.frombuffer(part, np.uint8)
    return train(spans, np.array([languages.index(lang) for lang, _ in sample], np.int64), languages)


def identify(docs: DataFrame, model: BiGRU, *, carry: Sequence[str] | None = None, text_column: str = "text") -> DataFrame:
    """Predict the language of every row's whole text.

    Returns ``row`` (the columns ``carry``, all by default, as one struct), lang_pred and score: the pooled probability
    of that language, 0 to 1. Texts that are null or have no letter are ``und`` with score 0; so is everything if the
    model has learned no language. One row per input row, whatever repeats; equal scores go to the first language in
    order. Every position of a text is labelled, long texts in spans, so memory doesn't grow with a text.
    """
    carry = list(docs.columns if carry is None else carry)
    text = F.coalesce(F.col(text_column), F.lit(""))
    letters = F.coalesce(F.col(text_column).rlike("\\p{L}"), F.lit(False))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"), text.cast("binary").alias("data"), letters.alias("letters"))
    schema = T.StructType([rows.schema["row"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            letters_ = batch.column("letters").to_numpy(zero_copy_only=False).astype(bool)
            if model.languages:
                scores = document_scores(model, [x if ok else b"" for x, ok in zip(batch.column("data").to_pylist(), letters_)])
                best = scores.argmax(1)
                names = [model.languages[i] if ok else UNDETERMINED for i, ok in zip(best, letters_)]
                value = np.where(letters_, scores[np.arange(len(best)), best], 0.0)
            else:
                names, value = [UNDETERMINED] * len(letters_), np.zeros(len(letters_))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(names, pa.string()), pa.array(np.clip(value, 0, 1))], names=["row", "lang_pred", "score"])

    return rows.mapInArrow(label, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = id_crc_mod("doc_id", 4) == 2
    model = fit(docs.filter(~held))
    found = identify(docs.select("doc_id", held.alias("held_out"), "text"), model, carry=["doc_id", "held_out"])
    return found.select("row.doc_id", "row.held_out", "lang_pred", "score")

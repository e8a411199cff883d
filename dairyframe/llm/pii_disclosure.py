"""Personal data, and the terms that give it away by how they occur with it in the corpus."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from dairyframe.llm import words
from dairyframe.llm.common import table, written

NAME = "op12_pii_sanitise"
#: Trained on nothing SQL could repeat: positions of matches without retries and corpus statistics; tests compare with plain code.
ORACLE = None
KINDS = ("email", "ip", "card", "phone")
TERM = "term"
#: Words on either side of personal data that count as occurring with it.
REACH = 8
#: A term is judged against an entity when they occur together in so many documents and in so many different wordings.
DOCUMENTS, WORDINGS = 3, 3
#: Share of an entity's information content that a term may give away; above it is generalised, above the second removed.
GENERALISE, REMOVE = 0.75, 0.95
#: Bits of the filter that passes the words to be counted; its size does not depend on the data.
FILTER_BITS = 1 << 20
_SPANS = "array<struct<kind:string,start:int,end:int>>"
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
#: Words are runs of ASCII letters and digits and of anything beyond ASCII.
_TERM_BYTES = words.fold_table([*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 255)])


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Every @ with a domain behind it and a part before it that no earlier match has used; one pass at any length."""
    at, last = text.find("@"), 0
    while at >= 0:
        domain = _DOMAIN.match(text, at + 1)
        start = at
        if domain:
            while start > last and text[start - 1] in _LOCAL:
                start -= 1
        if start < at:
            last = domain.end()
            yield start, last
        at = text.find("@", at + 1)


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _is_ip(found: str) -> bool:
    return all(len(p) <= 3 and int(p or "0") <= 255 for p in (part.lstrip("0") for part in found.split(".")))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of e-mail addresses, IP addresses, card numbers and phone numbers, by kind and start, in code points.

    Patterns are written without backtracking (a run of digits is entered at its start and never given back), which leaves the
    leftmost matches as they are and keeps very long runs linear.
    """
    out = [(0, *s) for s in _emails(text)]
    out += [(1, *m.span()) for m in _IP.finditer(text) if _is_ip(m.group())]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m.group())) <= 19 and _luhn(d):
            out.append((2, *m.span()))
    out += [(3, *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15]
    return out


def entity(kind: int, found: str) -> int:
    """One number for all ways to write the same address or number."""
    value = found.lower() if kind < 2 else _digits(found)
    return int.from_bytes(hashlib.blake2b(f"{kind}:{value}".encode(), digest_size=8).digest(), "little", signed=True)


def _signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def terms(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end in code points of each word of ``text``, upper and lower case alike."""
    data = np.frombuffer(text.encode(), np.uint8)
    h, starts, ends = words.word_hashes(data, _TERM_BYTES)
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return _signed(h), points[starts], points[ends]


def _beside(spans: list[tuple[int, int, int]], starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which words lie outside all spans."""
    free = np.ones(len(starts), bool)
    for _, start, end in spans:
        free[np.searchsorted(ends, start, "right") : np.searchsorted(starts, end, "left")] = False
    return free


def neighbours(text: str, spans: list[tuple[int, int, int]], reach: int) -> set[tuple[int, int, int]]:
    """(entity, term, wording) for each word within ``reach`` words of personal data; a wording is the hash of all of them."""
    h, starts, ends = terms(text)
    free = _beside(spans, starts, ends) & (ends - starts > 1)
    h, starts, ends = h[free], starts[free], ends[free]
    out = set()
    for kind, start, end in spans:
        before = int(np.searchsorted(ends, start, "right"))
        after = int(np.searchsorted(starts, end, "left"))
        near = np.concatenate([h[max(0, before - reach) : before], h[after : after + reach]])
        wording = int.from_bytes(hashlib.blake2b(near.tobytes(), digest_size=8).digest(), "little", signed=True)
        own = entity(kind, text[start:end])
        out |= {(own, int(t), wording) for t in near}
    return out


def _detected(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """rid, doc_id, base spans of every document, and the text of those that have any."""
    id_type = docs.schema[id_column].dataType.simpleString()
    slim = docs.select(
        F.monotonically_increasing_id().alias("rid"), F.col(id_column).alias("doc_id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text")
    )
    spans_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def detect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, texts = [], []
            for text in batch.column("text").to_pylist():
                found = base_spans(text)
                rows.append([{"kind": KINDS[k], "start": s, "end": e} for k, s, e in found])
                texts.append(text if found else None)
            columns = [batch.column("rid"), batch.column("doc_id"), pa.array(rows, spans_type), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["rid", "doc_id", "base", "text"])

    return slim.mapInArrow(detect, f"rid long, doc_id {id_type}, base {_SPANS}, text string")


def _as_tuples(spans: list[dict]) -> list[tuple[int, int, int]]:
    return [(KINDS.index(s["kind"]), s["start"], s["end"]) for s in spans]


def co_occurrences(found: DataFrame, reach: int) -> DataFrame:
    """(rid, entity, term, wording), distinct: what stands beside the personal data of each document."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for rid, base, text in zip(*(c.to_pylist() for c in batch.columns)):
                out += [(rid, *x) for x in neighbours(text, _as_tuples(base), reach)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["rid", "entity", "term", "wording"])

    return found.filter("size(base) > 0").select("rid", "base", "text").mapInArrow(pairs, "rid long, entity long, term long, wording long")


def _word_filter(asked: DataFrame) -> np.ndarray:
    """Packed bits of the terms to be counted: at most FILTER_BITS numbers come to the driver, however many terms there are."""
    places = asked.select(F.pmod("term", F.lit(FILTER_BITS)).alias("at")).distinct().toPandas()["at"]
    bits = np.zeros(FILTER_BITS, bool)
    bits[places.to_numpy(np.int64)] = True
    return np.packbits(bits)


def document_counts(docs: DataFrame, text_column: str, packed: np.ndarray) -> DataFrame:
    """(term, docs): in how many of all documents each word stands that the filter passes."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(packed).astype(bool)
        for batch in batches:
            texts = [t.encode() for t in batch.column(0).to_pylist() if t]
            held = []
            for first, end in words.blocks(texts):
                part = texts[first:end]
                stops = np.cumsum([len(t) + 1 for t in part])
                h, starts, _ = words.word_hashes(np.frombuffer(b"\n".join(part) + b"\n", np.uint8), _TERM_BYTES)
                h = _signed(h)
                passed = bits[h % FILTER_BITS]
                owner = np.searchsorted(stops, starts[passed], "right")
                held.append(np.unique(np.stack([owner, h[passed]], axis=1), axis=0)[:, 1])
            term, n = np.unique(np.concatenate(held) if held else np.zeros(0, np.int64), return_counts=True)
            if len(term):
                yield pa.RecordBatch.from_arrays([pa.array(term), pa.array(n.astype(np.int64))], ["term", "docs"])

    text = docs.select(F.col(text_column).cast("string").alias("text"))
    return text.mapInArrow(count, "term long, docs long").groupBy("term").agg(F.sum("docs").alias("docs"))


def disclosures(docs: DataFrame, text_column: str, pairs: DataFrame, *, documents: int, wordings: int) -> DataFrame:
    """(entity, term, disclosure) of terms that occur with an entity often enough to be judged.

    ``disclosure`` is the pointwise mutual information of term and entity over the information content of the entity, both over
    all documents: 1 if the term never stands without the entity, 0 if they are independent.
    """
    together = pairs.groupBy("entity", "term").agg(F.count_distinct("rid").alias("both"), F.count_distinct("wording").alias("wordings"))
    together = written(together.filter((F.col("both") >= documents) & (F.col("wordings") >= wordings)), "pii-pairs")
    alone = pairs.select("entity", "rid").distinct().groupBy("entity").agg(F.count("rid").alias("with_entity"))
    counts = document_counts(docs, text_column, _word_filter(together))
    n = float(docs.count())
    content = F.log2(F.lit(n) / F.col("with_entity"))
    shared = F.log2(F.lit(n) * F.col("both") / (F.col("docs") * F.col("with_entity")))
    scored = together.join(counts, "term").join(alone, "entity")
    return scored.select("entity", "term", F.when(content > 0, shared / content).otherwise(0.0).alias("disclosure"))


def _marked(rows: DataFrame) -> DataFrame:
    """Rows with base spans, text, and lists ``general`` and ``gone`` of terms: all spans and the text without them."""
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_spans, clean = [], []
            _, bases, texts, general, gone = (c.to_pylist() for c in batch.columns)
            for base, text, some, most in zip(bases, texts, general, gone):
                spans, out = _as_tuples(base), [*base]
                put = [(s["start"], s["end"], f"[{s['kind'].upper()}]") for s in base]
                if some or most:
                    h, starts, ends = terms(text)
                    for listed, stand_in in ((some, "[TERM]"), (most, "")):
                        hit = np.flatnonzero(np.isin(h, np.array(listed or [], np.int64)) & _beside(spans, starts, ends) & (ends - starts > 1))
                        out += [{"kind": TERM, "start": int(starts[i]), "end": int(ends[i])} for i in hit]
                        put += [(int(starts[i]), int(ends[i]), stand_in) for i in hit]
                out[len(base) :] = sorted(out[len(base) :], key=lambda s: s["start"])
                all_spans.append(out)
                clean.append(replaced(text, put))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bases, span), pa.array(all_spans, span), pa.array(clean, pa.string())], ["doc_id", "base", "spans", "clean_text"])

    return rows.select("doc_id", "base", "text", "general", "gone").mapInArrow(mark, f"doc_id {id_type}, base {_SPANS}, spans {_SPANS}, clean_text string")


def replaced(text: str, put: list[tuple[int, int, str]]) -> str:
    """``text`` with (start, end, stand-in) put in; of overlapping spans the stand-in of the first stays."""
    parts, at = [], 0
    for start, end, stand_in in sorted(put):
        if start >= at:
            parts += [text[at:start], stand_in]
        at = max(at, end)
    return "".join([*parts, text[at:]])


def sanitise(
    docs: DataFrame,
    *,
    reach: int = REACH,
    documents: int = DOCUMENTS,
    wordings: int = WORDINGS,
    generalise: float = GENERALISE,
    remove: float = REMOVE,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """doc_id, ``base`` spans, all ``spans`` and ``clean_text`` of every row (null where there is nothing to take out).

    Base spans are e-mail and IP addresses, card and phone numbers. A term is a word within ``reach`` words of one of them in this
    document. Over the corpus, a term and an entity (one address or number) are judged if they occur together in ``documents``
    documents and ``wordings`` different surroundings, so copies of one text prove nothing. A term that gives away ``generalise`` of the
    entity's information content is generalised to ``[TERM]``, above ``remove`` it is removed, wherever it stands in a document
    that holds it beside that entity. Personal data itself becomes the name of its kind.

    Null texts are empty; rows without personal data have no spans; rows that repeat an id are each judged by
    their own text; very long texts are read whole, in one pass a pattern. No rows give no result; other columns are ignored.
    Only documents with personal data are written with their text. Words of all documents are counted through a filter of a fixed number
    of bits, so what is shuffled is the counts of words that stand beside personal data.
    """
    found = written(_detected(docs, id_column, text_column), "pii-found")
    pairs = written(co_occurrences(found, reach), "pii-co-occurrences")
    judged = disclosures(docs, text_column, pairs, documents=documents, wordings=wordings).filter(F.col("disclosure") >= generalise)
    here = pairs.select("rid", "entity", "term").distinct().join(judged, ["entity", "term"]).groupBy("rid", "term").agg(F.max("disclosure").alias("most"))
    high = F.col("most") >= remove
    listed = here.groupBy("rid").agg(F.collect_list(F.when(~high, F.col("term"))).alias("general"), F.collect_list(F.when(high, F.col("term"))).alias("gone"))
    none = found.filter("size(base) = 0").select("doc_id", "base", F.col("base").alias("spans"), F.lit(None).cast("string").alias("clean_text"))
    some = found.filter("size(base) > 0").join(listed, "rid", "left")
    return none.unionByName(_marked(some))


def _joined(spans: str):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _is(kind: str):
    return lambda found: found == kind


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = sanitise(table(spark, sf_dir, "documents"))
    counts = [F.size(F.filter("base.kind", _is(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return done.select("doc_id", *counts, F.sha2(_joined("base").cast("binary"), 256).alias("base_sha256"), _joined("spans").alias("spans"))

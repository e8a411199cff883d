"""Packing token sequences by first-fit decreasing in randomised groups of documents."""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from dairyframe.llm.common import table

NAME = "op6_packing"
ORACLE = None
ROOM = 1024
GROUP = 4096
#: A bin filled to less than this share is cut anew, so that padding stays small.
FULL = 15 / 16
TOKENS = "doc_id long, doc_tokens long, full_crcs array<long>, tail binary, group int"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
SPECIAL = "<|endoftext|>"
_ENCODERS: dict = {}


def encoder(ranks_path: str | None = None):
    """The byte-level BPE of ``byte_bpe_50k.json`` from its rank file: same vocabulary, same ids, four times as fast."""
    import public_tokenizers
    import tiktoken

    path = ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    if path not in _ENCODERS:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _ENCODERS[path] = tiktoken.Encoding(
            "byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={SPECIAL: len(ranks)}
        )
    return _ENCODERS[path]


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


class TournamentTree:
    """Free room per bin with the maximum of each pair above it, so the first bin with room is one walk down."""

    def __init__(self, bins: int):
        self.size = 1 << max(0, bins - 1).bit_length()
        self.room = [ROOM] * (2 * self.size)

    def place(self, length: int) -> int:
        """Put ``length`` into the leftmost bin with room and return the bin."""
        room, node = self.room, 1
        while node < self.size:
            node *= 2
            if room[node] < length:
                node += 1
        room[node] -= length
        at = node - self.size
        node >>= 1
        while node:
            left, right = room[2 * node], room[2 * node + 1]
            best = left if left > right else right
            if room[node] == best:
                break
            room[node] = best
            node >>= 1
        return at


def first_fit_decreasing(lengths: list[int]) -> list[list[int]]:
    """Bins of indices into ``lengths``, each at most ROOM long in all."""
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    tree, bins = TournamentTree(len(lengths)), []
    for i in order:
        at = tree.place(lengths[i])
        if at == len(bins):
            bins.append([])
        bins[at].append(i)
    return bins


def pack_group(lengths: list[int]) -> list[list[tuple[int, int, int]]]:
    """Sequences of (index, first token, tokens) for pieces shorter than ROOM.

    First-fit decreasing; what lies in bins below FULL is then cut to fill whole sequences, and the last
    rest is cut at powers of two, which need no padding.
    """
    packed, loose = [], []
    for one in first_fit_decreasing(lengths):
        if sum(lengths[i] for i in one) >= FULL * ROOM:
            packed.append([(i, 0, lengths[i]) for i in one])
        else:
            loose += one
    left = sum(lengths[i] for i in loose)
    sizes = [ROOM] * (left // ROOM) + [1 << b for b in range(ROOM.bit_length() - 2, -1, -1) if left % ROOM >> b & 1]
    pieces = iter([(i, lengths[i]) for i in loose])
    i, end, at = -1, 0, 0
    for size in sizes:
        bin_: list[tuple[int, int, int]] = []
        while size:
            if at == end:
                i, end = next(pieces)
                at = 0
            n = min(size, end - at)
            bin_.append((i, at, n))
            at, size = at + n, size - n
        packed.append(bin_)
    return packed


def tokenised(docs: DataFrame, groups: int, seed: int, id_column: str, text_column: str, ranks_path: str | None = None) -> DataFrame:
    """One row per document: token count with the closing id 0, CRCs of its whole ROOM-token pieces, the rest's ids."""
    text = F.coalesce(F.col(text_column), F.lit(""))
    # equal rows fall into groups by their ids, others by id and text
    group = F.pmod(F.xxhash64(F.col(id_column), text, F.lit(seed)), F.lit(groups)).cast("int")
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), text.alias("text"), group.alias("group"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(ranks_path)
        for batch in batches:
            names = {n: batch.column(n) for n in ("doc_id", "text", "group")}
            counts, crcs, tails = [], [], []
            for value in names["text"]:
                ids = code.encode_to_numpy(value.as_py(), allowed_special="all")
                ids = np.append(ids, np.uint32(0)).astype("<u4")
                whole = len(ids) // ROOM
                counts.append(len(ids))
                crcs.append([zlib.crc32(ids[i * ROOM : (i + 1) * ROOM].tobytes()) for i in range(whole)])
                tails.append(ids[whole * ROOM :].astype("<u2").tobytes())
            yield pa.RecordBatch.from_arrays(
                [names["doc_id"], pa.array(counts, pa.int64()), pa.array(crcs, pa.list_(pa.int64())), pa.array(tails, pa.binary()), names["group"]],
                names=["doc_id", "doc_tokens", "full_crcs", "tail", "group"],
            )

    return rows.mapInArrow(encode, TOKENS)


def pack(
    docs: DataFrame,
    *,
    group_size: int = GROUP,
    seed: int = 6,
    id_column: str = "doc_id",
    text_column: str = "text",
    ranks_path: str | None = None,
) -> DataFrame:
    """Pack all rows into sequences of at most ROOM tokens: one row per piece, as PIECES lists them.

    Each row's tokens end with id 0; a null or empty text has that id alone. Whole ROOM-token pieces are
    sequences of their own, the rests are packed by first-fit decreasing, run independently in random
    groups of about ``group_size`` documents (hash of id, text and seed). Rows that repeat an id are packed as
    documents of their own under that id; null ids stay null. No rows give no rows; other columns are
    ignored. Token ids fit 16 bits, so a rest is at most 2 KB; a group is bounded whatever a document's length.
    """
    n = docs.count()
    groups = max(1, -(-n // group_size))
    rows = tokenised(docs, groups, seed, id_column, text_column, ranks_path)

    def bins(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        # any order of equal rows gives the same pieces
        pdf = pdf.sort_values(["doc_id", "doc_tokens", "tail"], kind="stable", na_position="first")
        sequence = int(key[0]) << 36
        out: list[tuple] = []
        ids = [None if pd.isna(x) else int(x) for x in pdf["doc_id"]]
        counts, tails, whole = pdf["doc_tokens"].tolist(), pdf["tail"].tolist(), pdf["full_crcs"].tolist()
        for doc, count, crcs in zip(ids, counts, whole):
            for i, value in enumerate(crcs):
                out.append((doc, i * ROOM, ROOM, int(value), count, sequence, 0))
                sequence += 1
        short = [i for i in range(len(ids)) if len(tails[i])]
        for one in pack_group([len(tails[i]) // 2 for i in short]):
            offset = 0
            for j, first, length in one:
                i = short[j]
                part = np.frombuffer(tails[i], "<u2")[first : first + length]
                out.append((ids[i], counts[i] - len(tails[i]) // 2 + first, length, crc(part), counts[i], sequence, offset))
                offset += length
            sequence += 1
        frame = pd.DataFrame(out, columns=[c.split()[0] for c in PIECES.split(", ")])
        return frame.astype({"doc_id": "Int64"})

    return rows.groupBy("group").applyInPandas(bins, PIECES)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))

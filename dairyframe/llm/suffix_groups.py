"""Repeated byte strings found with suffix arrays, built by grouping suffixes by their Lyndon prefixes."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from dairyframe.llm.common import table, written
from dairyframe.llm.words import mix

NAME = "op1_suffix_dedup"
ORACLE = None
LENGTH = 100
#: Bytes of an anchor: every LENGTH-byte string chooses the anchor with the smallest hash inside it.
ANCHOR = 24
WIDTH = LENGTH - ANCHOR + 1
#: Positions worked on at once, and rows held before equal ones are folded.
BLOCK = 1 << 18
FOLD = 1 << 20
#: Suffixes sorted together at most; buckets of texts are cut to this.
BUCKET = 1 << 16
NO_ID = -(2**63)
_INDEX = np.uint64((1 << 20) - 1)
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_POWER = np.uint64(0xD6E8FEB86659FD93)
_INVERSE = np.uint64(pow(int(_POWER), -1, 1 << 64))


def lyndon_groups(s: Sequence[int]) -> tuple[list[list[int]], list[int]]:
    """Suffixes grouped by their Lyndon prefixes, groups ascending, and each suffix's previous-smaller pointer.

    ``s`` ends with a value smaller than all others. Groups start as the buckets of the first symbol and are
    processed from the highest down. Each suffix of a group points to the last earlier suffix of a lower
    group; that suffix's prefix goes on with this group's prefix, as often as it has children here, so those with
    more children move into higher groups right above their old one.
    """
    n = len(s)
    names = sorted(set(s))
    # group ids in a linked list by order; a group's list may hold suffixes that have since moved on
    below = list(range(-1, len(names) - 1))
    members: list[list[int]] = [[] for _ in names]
    number = {c: g for g, c in enumerate(names)}
    group = [number[c] for c in s]
    for i, g in enumerate(group):
        members[g].append(i)
    above = [g + 1 for g in range(len(names))]
    above[-1] = -1
    done = [False] * len(names)
    prev = [-1] * n
    final: list[list[int]] = []
    g = len(names) - 1
    while g >= 0:
        own = [i for i in members[g] if group[i] == g]
        done[g] = True
        if own:
            final.append(own)
            # children of one parent lie next to each other: count them
            parents: dict[int, dict[int, list[int]]] = {}
            last, count = -1, 0
            for i in own:
                j = i - 1
                while j >= 0 and done[group[j]]:
                    j = prev[j]
                prev[i] = j
                if j == last:
                    count += 1
                    continue
                if last >= 0:
                    parents.setdefault(group[last], {}).setdefault(count, []).append(last)
                last, count = j, 1
            if last >= 0:
                parents.setdefault(group[last], {}).setdefault(count, []).append(last)
            for old, by_count in parents.items():
                for count in sorted(by_count, reverse=True):
                    new = len(members)
                    members.append(by_count[count])
                    done.append(False)
                    up = above[old]
                    below.append(old)
                    above.append(up)
                    above[old] = new
                    if up >= 0:
                        below[up] = new
                    for j in by_count[count]:
                        group[j] = new
        g = below[g]
    final.reverse()
    return final, prev


def suffix_array(s: Sequence[int]) -> list[int]:
    """All suffixes in order. ``s`` ends with a value smaller than all others.

    Groups are laid out one after the other; suffixes are then taken in ascending order, and each settles the ones that end
    their Lyndon prefix where it starts: they fill their groups from the front. Nothing is renamed or sorted again.
    """
    groups, prev = lyndon_groups(s)
    n = len(s)
    slot = [0] * n
    at = 0
    starts = []
    for k, own in enumerate(groups):
        starts.append(at)
        at += len(own)
        for i in own:
            slot[i] = k
    order = [-1] * n
    order[0] = n - 1
    placed = bytearray(n)
    placed[n - 1] = 1
    for k in range(n):
        j = order[k] - 1
        while j >= 0 and not placed[j]:
            placed[j] = 1
            g = slot[j]
            order[starts[g]] = j
            starts[g] += 1
            j = prev[j]
    return order


def common_prefixes(s: Sequence[int], order: Sequence[int]) -> list[int]:
    """Length of the common prefix of each suffix in order with the one before it (Kasai's method)."""
    n = len(s)
    rank = [0] * n
    for k, i in enumerate(order):
        rank[i] = k
    out, h = [0] * n, 0
    for i in range(n):
        k = rank[i]
        if k:
            j = order[k - 1]
            while i + h < n and j + h < n and s[i + h] == s[j + h]:
                h += 1
            out[k] = h
            h = h - 1 if h else 0
        else:
            h = 0
    return out


def repeats(texts: Sequence[bytes], length: int = LENGTH) -> list[list[tuple[int, int]]]:
    """Sets of (text, start) whose ``length`` bytes are equal, found in one suffix array over all texts."""
    s: list[int] = []
    owner: list[int] = []
    first: list[int] = []
    for k, t in enumerate(texts):
        first.append(len(s))
        # every end is a symbol of its own, so no match reaches over it
        s += [b + len(texts) for b in t]
        s.append(len(texts) - k - 1)
        owner += [k] * (len(t) + 1)
    if not s:
        return []
    order = suffix_array(s)
    found, run = [], [order[0]]
    for k, h in enumerate(common_prefixes(s, order)):
        if not k:
            continue
        if h >= length:
            run.append(order[k])
        else:
            if len(run) > 1:
                found.append(run)
            run = [order[k]]
    if len(run) > 1:
        found.append(run)
    return [[(owner[i], i - first[owner[i]]) for i in run] for run in found]


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while have < width:
        step = min(have, width - have)
        x = np.minimum(x[:-step], x[step:])
        have += step
    return x


def anchors(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Anchors of texts data[starts:ends], at most BLOCK + LENGTH positions in all.

    Returns per anchor: text, first string's start, number of consecutive strings that choose it, the anchor's place after
    that start, hash of the anchor and hash of all bytes these strings cover.
    """
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < LENGTH:
        return none, none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    padded = np.concatenate([data, np.zeros(ANCHOR, np.uint8)]).astype(np.uint64)
    v = padded[:-1] | (padded[1:] << np.uint64(8))
    v = v[:-2] | (v[2:] << np.uint64(16))
    m = mix(v[:-4] | (v[4:] << np.uint64(32)))
    h = m[: n - ANCHOR + 1] + _A * m[8 : n - ANCHOR + 9] + _B * m[16 : n - ANCHOR + 17]
    h ^= h >> np.uint64(29)
    h *= _A
    h ^= h >> np.uint64(32)
    where = np.arange(len(h), dtype=np.uint64)
    chosen = (sliding_min((h & ~_INDEX) | where, WIDTH) & _INDEX).astype(np.int64)
    # a string starts at s only if it ends inside its text
    text = np.full(len(chosen), -1, np.int64)
    for k, (s, e) in enumerate(zip(starts, ends)):
        if e - s >= LENGTH:
            text[s : e - LENGTH + 1] = k
    new = np.ones(len(chosen), bool)
    new[1:] = (chosen[1:] != chosen[:-1]) | (text[1:] != text[:-1])
    low = np.flatnonzero(new)
    high = np.append(low[1:], len(chosen)) - 1
    good = text[low] >= 0
    low, high = low[good], high[good]
    power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _POWER)]), dtype=np.uint64)
    inverse = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _INVERSE)]), dtype=np.uint64)
    total = np.concatenate([[np.uint64(0)], np.cumsum(m[:n] * power[:n], dtype=np.uint64)])
    span = mix((total[high + LENGTH - 7] - total[low]) * inverse[low] + (high - low).astype(np.uint64))
    return text[low], low, high - low + 1, chosen[low] - low, h[chosen[low]], span


def packed(start: np.ndarray, off: np.ndarray, width: np.ndarray) -> np.ndarray:
    return (start << 14) | (off << 7) | width


def later(t: np.ndarray) -> np.ndarray:
    """For sorted rows (key, span, id, tag, place): does an equal (key, span) start earlier? Equal places don't."""
    if not t.shape[1]:
        return np.zeros(0, bool)
    new = np.ones(t.shape[1], bool)
    new[1:] = (t[0, 1:] != t[0, :-1]) | (t[1, 1:] != t[1, :-1])
    first = np.maximum.accumulate(np.where(new, np.arange(t.shape[1]), 0))
    return (t[2] != t[2, first]) | (t[4] >> 14 != t[4, first] >> 14)


def merged(ids: np.ndarray, tags: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """Overlapping or touching byte ranges of a document as one."""
    order = np.lexsort((start, tags, ids))
    ids, tags, start, end = ids[order], tags[order], start[order], end[order]
    if not len(ids):
        return ids, tags, start, end
    doc = np.ones(len(ids), bool)
    doc[1:] = (ids[1:] != ids[:-1]) | (tags[1:] != tags[:-1])
    # ends as a running maximum per document: documents are set apart by an offset
    far = np.cumsum(doc) * (1 << 40)
    reach = np.maximum.accumulate(end + far)
    new = np.ones(len(ids), bool)
    new[1:] = doc[1:] | (start[1:] + far[1:] > reach[:-1])
    low = np.flatnonzero(new)
    high = np.append(low[1:], len(ids)) - 1
    return ids[low], tags[low], start[low], (reach - far)[high]


#: A row with end = 0 is an anchor; otherwise it is the removed range [place, end) and key only spreads it.
ROWS = "key long, span long, id long, tag long, place long, end long"
#: As above; an anchor row asks for the bytes it covers.
FOUND = "key long, id long, tag long, place long, end long"


def _batch(columns: Sequence[np.ndarray], schema: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], names=[c.split()[0] for c in schema.split(", ")])


def _place_range(place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    start = place >> 14
    return start, start + (place & 127) - 1 + LENGTH


def anchor_rows(rows: DataFrame) -> DataFrame:
    """Anchors of every row (id, tag, data) as ROWS.

    Anchors that repeat an earlier one of the same task become ranges here and are merged, so a passage or text in a third
    of all documents gives few rows per task.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        count = 0
        for batch in batches:
            ids, tags = batch.column("id").to_numpy(), batch.column("tag").to_numpy()
            for block in _blocks(batch.column("data").to_pylist()):
                data = np.frombuffer(b"".join(piece for _, _, piece in block), np.uint8)
                sizes = np.array([len(piece) for _, _, piece in block], np.int64)
                ends = np.cumsum(sizes)
                text, low, width, off, key, span = anchors(data, ends - sizes, ends)
                doc = np.array([d for d, _, _ in block], np.int64)[text]
                base = np.array([b for _, b, _ in block], np.int64)[text]
                place = packed(low - (ends - sizes)[text] + base, off, width)
                held.append((key.view(np.int64), span.view(np.int64), ids[doc], tags[doc], place))
                count += len(text)
                if count >= FOLD:
                    yield fold(held)
                    held, count = [], 0
        if held:
            yield fold(held)

    def fold(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        cols = [np.concatenate(c) for c in zip(*held)]
        order = np.lexsort((cols[4], cols[2], cols[1], cols[0]))
        t = np.stack([c[order] for c in cols])
        late = later(t)
        ids, tags, start, end = merged(t[2, late], t[3, late], *_place_range(t[4, late]))
        t = t[:, ~late]
        none = np.zeros(t.shape[1], np.int64)
        spread = mix(ids.view(np.uint64) + _A).view(np.int64)
        ranges = [spread, np.zeros(len(ids), np.int64), ids, tags, start, end]
        return _batch([np.concatenate([x, y]) for x, y in zip([*t, none], ranges)], ROWS)

    return rows.mapInArrow(cut, ROWS)


def resolved(anchored: DataFrame) -> DataFrame:
    """Ranges known to repeat, and one anchor for each distinct span of keys that have several: FOUND."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            t = np.stack([c.to_numpy() for c in batch.columns])
            last = np.flatnonzero(t[0] != t[0, -1])
            cut_ = int(last[-1]) + 1 if len(last) else 0
            if cut_:
                yield from settle(np.concatenate([*held, t[:, :cut_]], axis=1))
                held = []
            held.append(t[:, cut_:])
            if sum(h.shape[1] for h in held) > FOLD:  # one key beyond that: keep what the next rows need
                every = np.concatenate(held, axis=1)
                yield from settle(every, closed=False)
                held = [carried(every)]
        if held:
            yield from settle(np.concatenate(held, axis=1))

    def carried(t: np.ndarray) -> np.ndarray:
        """First anchor of the first and of the last span of the key that goes on; both have been given out."""
        t = t[:, (t[5] <= 0) & (t[0] == t[0, -1])]
        if not t.shape[1]:
            return t
        new = np.flatnonzero(np.concatenate([[True], t[1, 1:] != t[1, :-1]]))
        keep = t[:, np.unique([new[0], new[-1]])].copy()
        keep[5] = -1
        return keep

    def settle(t: np.ndarray, closed: bool = True) -> Iterator[pa.RecordBatch]:
        done = t[:, t[5] > 0]
        a = t[:, t[5] <= 0]
        late = later(a)
        key, span = a[0], a[1]
        several = np.zeros(a.shape[1], bool)
        if a.shape[1]:
            new = np.concatenate([[True], key[1:] != key[:-1]])
            g = np.cumsum(new) - 1
            first = np.concatenate([[True], (key[1:] != key[:-1]) | (span[1:] != span[:-1])])
            several = np.bincount(g[first])[g] > 1
            if not closed:
                several |= g == g[-1]
            several &= first & (a[5] == 0)
        late &= a[5] == 0
        start, end = _place_range(a[4, late])
        zero = np.zeros(int(several.sum()), np.int64)
        yield _batch(
            [
                np.concatenate([done[0], a[0, late], a[0, several]]),
                np.concatenate([done[2], a[2, late], a[2, several]]),
                np.concatenate([done[3], a[3, late], a[3, several]]),
                np.concatenate([done[4], start, a[4, several]]),
                np.concatenate([done[5], end, zero]),
            ],
            FOUND,
        )

    ordered = anchored.repartition("key").sortWithinPartitions("key", "span", "id", "place")
    return ordered.mapInArrow(walk, FOUND)


def narrowed(group: np.ndarray, texts: list[bytes], length: int = LENGTH) -> list[tuple[int, int, int]]:
    """(text, first, end) of the part of each text that can hold a repeated string; texts without one are left out.

    Every string is hashed with its group; strings whose hash is alone can't repeat. This only saves the suffix
    array work; what it lets through is compared there.
    """
    data = np.frombuffer(b"".join(texts) + bytes(16), np.uint8).astype(np.uint64)
    sizes = np.array([len(t) for t in texts], np.int64)
    first = np.cumsum(sizes) - sizes
    n = int(sizes.sum())
    v = data[:-1] | (data[1:] << np.uint64(8))
    v = v[:-2] | (v[2:] << np.uint64(16))
    m = mix(v[:-4] | (v[4:] << np.uint64(32)))[:n]
    power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _POWER)]), dtype=np.uint64)[:n]
    inverse = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _INVERSE)]), dtype=np.uint64)[:n]
    total = np.concatenate([[np.uint64(0)], np.cumsum(m * power, dtype=np.uint64)])
    counts = np.maximum(0, sizes - length + 1)
    owner = np.repeat(np.arange(len(texts)), counts)
    at = first[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    h = mix((total[at + length - 7] - total[at]) * inverse[at] + group[owner].astype(np.uint64) * _B)
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    shared = np.zeros(len(h), bool)
    shared[order[1:][same]] = True
    shared[order[:-1][same]] = True
    where = np.flatnonzero(shared)
    if not len(where):
        return []
    who, low = np.unique(owner[where], return_index=True)
    high = np.append(low[1:], len(where)) - 1
    return [(int(k), int(at[where[i]] - first[k]), int(at[where[j]] - first[k]) + length) for k, i, j in zip(who, low, high)]


def repeated_ranges(key: np.ndarray, ids: np.ndarray, tags: np.ndarray, starts: np.ndarray, texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Byte ranges (id, tag, start, end) of strings in ``texts`` that also start earlier in a text of the same key.

    Equal parts of a key are sorted once; buckets of parts, whole keys together, get one suffix array each.
    """
    parts = narrowed(key.view(np.uint64), texts)
    distinct: dict[tuple[int, bytes], list[tuple[int, int]]] = {}
    for k, lo, hi in parts:
        distinct.setdefault((int(key[k]), texts[k][lo:hi]), []).append((k, lo))
    found: list[tuple[np.ndarray, ...]] = []
    bucket: list[tuple[int, bytes]] = []
    held = 0

    def settle() -> None:
        label, at = {}, 0
        for run in repeats([t for _, t in bucket]):
            for spot in run:
                label[spot] = at
            at += 1
        name, who, where = [], [], []
        for t, own in enumerate(bucket):
            count = len(own[1]) - LENGTH + 1
            names = np.array([label.get((t, i), -1) for i in range(count)], np.int64)
            alone = names < 0
            names[alone] = at + np.arange(int(alone.sum()))
            at += int(alone.sum())
            for k, lo in distinct[own]:
                name.append(names)
                who.append(np.full(count, k))
                where.append(starts[k] + lo + np.arange(count))
        c, k, p = np.concatenate(name), np.concatenate(who), np.concatenate(where)
        order = np.lexsort((p, ids[k], c))
        c, k, p = c[order], k[order], p[order]
        new = np.ones(len(c), bool)
        new[1:] = c[1:] != c[:-1]
        first = np.maximum.accumulate(np.where(new, np.arange(len(c)), 0))
        late = (ids[k] != ids[k[first]]) | (p != p[first])
        found.append(merged(ids[k[late]], tags[k[late]], p[late], p[late] + LENGTH))

    ordered = sorted(distinct)
    for i, own in enumerate(ordered):
        if held > BUCKET and own[0] != ordered[i - 1][0]:
            settle()
            bucket, held = [], 0
        bucket.append(own)
        held += len(own[1])
    if bucket:
        settle()
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none, none
    return tuple(np.concatenate(c) for c in zip(*found))


RANGES = "id long, tag long, start long, end long"
#: Spans of one key sorted in one task at most; keys with more are counted string by string.
LARGE = 100_000


def sorted_ranges(spans: DataFrame) -> DataFrame:
    """RANGES from spans (key, id, tag, place, data) by suffix arrays over whole keys."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column("key").to_numpy()
            edges = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1])
            if held and held[-1].column("key")[-1].as_py() != key[0] and count > 20_000:
                yield settle(held)
                held, count = [], 0
            # once there are enough, rows are taken up to the last change of key
            cut_ = int(edges[-1])
            if cut_ and count + cut_ > 20_000:
                yield settle([*held, batch.slice(0, cut_)])
                held, count, batch = [], 0, batch.slice(cut_)
            held.append(batch)
            count += batch.num_rows
        if held:
            yield settle(held)

    def settle(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        key, ids, tags, place = (t.column(c).to_numpy() for c in ("key", "id", "tag", "place"))
        return _batch(repeated_ranges(key, ids, tags, place >> 14, t.column("data").to_pylist()), RANGES)

    return spans.repartition("key").sortWithinPartitions("key").mapInArrow(walk, RANGES)


def counted_ranges(spans: DataFrame) -> DataFrame:
    """RANGES from spans of keys too large for one task: equal strings meet by their bytes, pre-aggregated."""
    each = F.explode(F.sequence(F.lit(0), F.octet_length("data") - LENGTH)).alias("i")
    strings = spans.select("id", "tag", (F.shiftright("place", 14)).alias("from"), "data", each)
    strings = strings.select("id", "tag", (F.col("from") + F.col("i")).alias("start"), F.sha2(F.substring("data", F.col("i") + 1, F.lit(LENGTH)), 256).alias("h"))
    first = strings.groupBy("h").agg(F.min(F.struct("id", "start")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    late = strings.join(first, "h").filter(F.struct("id", "start") > F.col("first"))
    return late.select("id", "tag", "start", (F.col("start") + LENGTH).alias("end"))


def remove_repeats(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Remove every byte covered by a LENGTH-byte string that also starts earlier in ``docs``.

    Earlier means a smaller id, or the same id and an earlier start; strings are judged on the input. Returns one row per input
    row: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept (remaining bytes). Null and empty texts
    have no bytes. Identical rows are judged alike: none is earlier than the other; rows with equal ids and other
    texts are judged each by its own text. Null ids are smaller than all others. No rows give no rows; other columns are ignored.

    Each string chooses the anchor with the smallest hash among its ANCHOR-byte parts, so equal strings meet under equal anchors.
    Spans of strings with one anchor that are equal as a whole are settled by hash; where spans under one anchor differ, their bytes
    go to a suffix array. Texts are cut where they lie; only anchors, one per 40 bytes or so, are shuffled.
    """
    text = F.coalesce(F.col(text_column), F.lit(""))
    base = docs.select(
        F.coalesce(F.col(id_column).cast("long"), F.lit(NO_ID)).alias("id"),
        F.pmod(F.xxhash64(text), F.lit(1 << 30)).alias("tag"),
        text.cast("binary").alias("data"),
    )
    found = written(resolved(anchor_rows(base)), "repeat-anchors")
    asked = found.filter("end = 0").groupBy("id", "tag").agg(F.collect_list(F.struct("key", "place")).alias("asked"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (data, asks) in enumerate(zip(batch.column("data"), batch.column("asked"))):
                raw, own = data.as_py(), asks.values
                key, place = own.field("key"), own.field("place").to_numpy()
                start, end = _place_range(place)
                pieces = pa.array([raw[s:e] for s, e in zip(start, end)], pa.binary())
                ids = np.full(len(place), batch.column("id")[i].as_py())
                tags = np.full(len(place), batch.column("tag")[i].as_py())
                yield pa.RecordBatch.from_arrays([key, pa.array(ids), pa.array(tags), pa.array(place), pieces], names=["key", "id", "tag", "place", "data"])

    # identical rows would ask twice; once is enough
    spans = base.join(asked, ["id", "tag"]).mapInArrow(cut, "key long, id long, tag long, place long, data binary")
    large = found.filter("end = 0").groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > LARGE).select("key")
    ranges = found.filter("end > 0").select("id", "tag", F.col("place").alias("start"), "end")
    if large.isEmpty():
        ranges = ranges.unionByName(sorted_ranges(spans))
    else:
        spans = written(spans, "repeat-spans")
        ranges = ranges.unionByName(sorted_ranges(spans.join(large, "key", "left_anti"))).unionByName(counted_ranges(spans.join(large, "key", "left_semi")))
    gone = ranges.groupBy("id", "tag").agg(F.collect_list(F.struct("start", "end")).alias("gone"))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, lost, runs, kept = [], [], [], []
            for data, spots in zip(batch.column("data"), batch.column("gone")):
                raw = data.as_py()
                left, at, n, m = [], 0, 0, 0
                if spots.is_valid and len(spots):
                    start, end = spots.values.field("start").to_numpy(), spots.values.field("end").to_numpy()
                    zero = np.zeros(len(start), np.int64)
                    for s, e in zip(*merged(zero, zero, start, end)[2:]):
                        left.append(raw[at:s])
                        at, n, m = e, n + e - s, m + 1
                kept.append(b"".join([*left, raw[at:]]))
                size.append(len(raw))
                lost.append(int(n))
                runs.append(m)
            columns = [batch.column("id"), pa.array(size, pa.int64()), pa.array(lost, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    out = base.join(gone, ["id", "tag"], "left").mapInArrow(keep, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
    return out.withColumn("doc_id", F.nullif(F.col("doc_id"), F.lit(NO_ID)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def _blocks(texts: list[bytes]) -> Iterator[list[tuple[int, int, bytes]]]:
    """(text, offset, piece) in blocks of about BLOCK bytes; pieces of one text overlap by LENGTH - 1."""
    block: list[tuple[int, int, bytes]] = []
    held = 0
    for k, t in enumerate(texts):
        for at in range(0, max(1, len(t) - LENGTH + 1), BLOCK):
            piece = t[at : at + BLOCK + LENGTH - 1]
            if held and held + len(piece) > BLOCK + LENGTH:
                yield block
                block, held = [], 0
            block.append((k, at, piece))
            held += len(piece)
    if block:
        yield block

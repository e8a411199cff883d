"""MinHash near-dedup by an inverted join of signature coordinates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from dairyframe.llm.common import join_counted, table, written
from dairyframe.llm.components import components
from dairyframe.llm.words import blocks, mix, shingle_sets

NAME = "op3_near_dedup"
ORACLE = None
#: Coordinates of a signature, and how many two documents must share to be compared. At similarity 0.8 a pair
#: falls short of 12 in 32 with probability 2e-8.
COORDINATES, MATCHES = 32, 12
#: Bits of the parity map: where two maps differ, the sets differ, so a pair can be ruled out but never lost.
MAP_BITS = 1024
#: Documents of one posting list that one task compares with each other; longer lists are cut into tiles.
TILE = 2048
NO_ID = -(2**63)
_RNG = np.random.default_rng(3)
_FACTOR = _RNG.integers(1, 2**62, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFT = _RNG.integers(1, 2**63, COORDINATES, dtype=np.uint64)
SKETCH = "doc_id long, n long, fp binary, sig array<long>, map binary"


def sketches(texts: list[bytes], size: int) -> tuple[np.ndarray, list[bytes], np.ndarray, list[bytes]]:
    """Per text: set size, 128-bit set fingerprint, signature (COORDINATES) and parity map."""
    h, counts = shingle_sets(texts, size)
    sig = np.zeros((len(texts), COORDINATES), np.uint64)
    finger = np.zeros((len(texts), 2), np.uint64)
    full = np.flatnonzero(counts)
    if len(h):
        at = (np.cumsum(counts) - counts)[full]
        for k in range(COORDINATES):
            sig[full, k] = np.minimum.reduceat((h ^ _SHIFT[k]) * _FACTOR[k], at)
        one = mix(h + np.uint64(1))
        finger[full, 0] = np.add.reduceat(one, at)
        finger[full, 1] = np.add.reduceat(mix(one ^ _SHIFT[0]), at)
    owner = np.repeat(np.arange(len(texts)), counts)
    parity = np.bincount(owner * MAP_BITS + (h & np.uint64(MAP_BITS - 1)).astype(np.int64), minlength=len(texts) * MAP_BITS) & 1
    maps = np.packbits(parity.astype(np.uint8).reshape(len(texts), MAP_BITS), axis=1)
    return counts, [f.tobytes() for f in finger], sig.view(np.int64), [m.tobytes() for m in maps]


def sketched(docs: DataFrame, size: int) -> DataFrame:
    """One row per document (id, data): SKETCH."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("data").to_pylist()
            for lo, hi in blocks(texts):
                counts, fp, sig, maps = sketches(texts[lo:hi], size)
                sigs = pa.ListArray.from_arrays(pa.array(np.arange(hi - lo + 1, dtype=np.int32) * COORDINATES), pa.array(sig.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(lo, hi - lo), pa.array(counts, pa.int64()), pa.array(fp, pa.binary()), sigs, pa.array(maps, pa.binary())],
                    names=["doc_id", "n", "fp", "sig", "map"],
                )

    return docs.mapInArrow(sketch, SKETCH)


def set_rows(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, shingles): the whole set of each document, ascending."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("data").to_pylist()
            for lo, hi in blocks(texts):
                h, counts = shingle_sets(texts[lo:hi], size)
                ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(h.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(lo, hi - lo), lists], names=["doc_id", "shingles"])

    return docs.mapInArrow(make, "doc_id long, shingles array<long>")


class Members:
    """The documents of one tile: arrays of ids, set sizes, signatures, parity maps, prefix masks and labels."""

    def __init__(self, rows: pa.Table | pa.RecordBatch):
        col = {n: rows.column(n) for n in rows.schema.names}
        self.id, self.n = col["rep"].to_numpy(), col["n"].to_numpy()
        flat = np.array(col["sig"].to_pylist(), np.int64)
        self.sig = flat.reshape(len(self.id), COORDINATES)
        self.map = np.frombuffer(b"".join(col["map"].to_pylist()), np.uint64).reshape(len(self.id), -1)
        self.mask, self.label, self.side = col["mask"].to_numpy(), col["label"].to_numpy(), col["side"].to_numpy()

    def like(self, x: int, others: np.ndarray, coordinate: int, similar: int, matches: int) -> np.ndarray:
        """Which of ``others`` may be linked with ``x`` and meet it in this list first."""
        n, m = self.n[x], self.n[others]
        ok = np.flatnonzero(100 * np.minimum(n, m) >= similar * np.maximum(n, m))
        others = others[ok]
        equal = self.sig[others] == self.sig[x]
        # set sizes bound how far the sets may differ: |A xor B| <= (|A| + |B|) (100 - s) / (100 + s)
        apart = np.bitwise_count(self.map[others] ^ self.map[x]).sum(1, dtype=np.int64)
        good = (equal.sum(1) >= matches) & (apart * (100 + similar) <= (n + self.n[others]) * (100 - similar))
        shared = (equal @ (1 << np.arange(COORDINATES, dtype=np.int64))) & self.mask[others] & self.mask[x]
        good &= (shared & -shared) == 1 << coordinate
        return others[good]

    def _hub_first(self) -> np.ndarray:
        """Members by how common their coordinates are in the list, the most typical first."""
        common = np.zeros(len(self.id), np.int64)
        if len(self.id) > 2:
            for k in range(COORDINATES):
                _, back, count = np.unique(self.sig[:, k], return_inverse=True, return_counts=True)
                common += count[back]
        return np.lexsort((self.id, -common))

    def forest(self, coordinate: int, similar: int, matches: int) -> list[tuple[int, int]]:
        """Candidate pairs that span what the candidate pairs of this list connect: fewer than members."""
        rest, found = self._hub_first(), []
        while len(rest) > 1:
            queue, rest = [rest[0]], rest[1:]
            while queue and len(rest):
                x = queue.pop()
                near = self.like(x, rest, coordinate, similar, matches)
                near = near[self._apart(x, near)]
                found += [(x, y) for y in near]
                queue += list(near)
                rest = rest[~np.isin(rest, near)]
        return found

    def _apart(self, x: int, others: np.ndarray) -> np.ndarray:
        """Both sides of a tile meet; one side's own pairs belong to its own tile."""
        return (self.side[x] != self.side[others]) | (self.side[x] < 0)

    def between(self, coordinate: int, similar: int, matches: int) -> list[tuple[int, int]]:
        """All candidate pairs whose labels differ."""
        found = []
        if len(np.unique(self.label)) > 1:
            # the largest component's members are only compared from the other side
            names, count = np.unique(self.label, return_counts=True)
            order = np.argsort(self.label == names[count.argmax()], kind="stable")
            outside = int((self.label != names[count.argmax()]).sum())
            for i in range(outside):
                x, others = order[i], order[i + 1 :]
                others = others[self.label[others] != self.label[x]]
                others = others[self._apart(x, others)] if len(others) else others
                found += [(x, y) for y in self.like(x, others, coordinate, similar, matches)]
        return found


def candidate_pairs(prefix: DataFrame, labels: DataFrame | None, similar: int, matches: int) -> DataFrame:
    """Pairs (a, b), a < b, from the posting lists of ``prefix``; with ``labels`` only those still apart."""
    if labels is None:
        rows, spanning = prefix.withColumn("label", F.col("rep")), True
    else:
        known = labels.select(F.col("node").alias("rep"), F.col("component").alias("label"))
        rows, spanning = prefix.join(known, "rep", "left").withColumn("label", F.coalesce("label", "rep")), False
    rows = rows.select("rep", "n", "sig", "map", "mask", "label", F.explode("posts").alias("post"))
    # a list of df members takes parts; part p meets part q in tile (p, q)
    parts = F.ceil(F.col("post.df") / TILE).cast("int")
    part = F.pmod(F.xxhash64("rep"), parts).cast("int")
    rows = rows.select("*", part.alias("part"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("other"))
    side = F.when(F.col("part") == F.col("other"), F.lit(-1)).otherwise((F.col("part") > F.col("other")).cast("int"))
    tile = F.xxhash64("post.key", F.least("part", "other"), F.greatest("part", "other"))
    rows = rows.select("rep", "n", "sig", "map", "mask", "label", F.col("post.c").alias("c"), side.cast("int").alias("side"), tile.alias("tile"))

    def pairs(members: pa.Table) -> list[tuple[int, int]]:
        here, c = Members(members), members.column("c")[0].as_py()
        found = here.forest(c, similar, matches) if spanning else here.between(c, similar, matches)
        return [(int(here.id[x]), int(here.id[y])) for x, y in found]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows come sorted by tile; a tile may reach over batches
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            tiles = np.stack([batch.column("tile").to_numpy(), batch.column("c").to_numpy()])
            edges = np.concatenate([[0], np.flatnonzero((tiles[:, 1:] != tiles[:, :-1]).any(0)) + 1, [batch.num_rows]])
            found: list[tuple[int, int]] = []
            if held and [held[0].column(k)[0].as_py() for k in ("tile", "c")] != tiles[:, 0].tolist():
                found += done(held)
                held = []
            for lo, hi in zip(edges[:-1], edges[1:]):
                if lo:
                    found += done(held)
                    held = []
                held.append(batch.slice(lo, hi - lo))
            yield out(found)
        if held:
            yield out(done(held))

    def done(held: list[pa.RecordBatch]) -> list[tuple[int, int]]:
        return pairs(pa.Table.from_batches(held).combine_chunks()) if sum(b.num_rows for b in held) > 1 else []

    def out(found: list[tuple[int, int]]) -> pa.RecordBatch:
        both = np.sort(np.array(found, np.int64).reshape(-1, 2), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])

    sorted_rows = rows.repartition("tile").sortWithinPartitions("tile", "c", "rep")
    return sorted_rows.mapInArrow(walk, "a long, b long").filter("a <> b").distinct()


def linked(pairs: DataFrame, sets: DataFrame, similar: int) -> DataFrame:
    """The pairs whose whole sets are similar enough."""
    right = pairs.join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("right")), "b")
    both = right.join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("left")), "a")
    common = F.size(F.array_intersect("left", "right"))
    union = F.size("left") + F.size("right") - common
    return both.filter(100 * common >= similar * union).select("a", "b")


def prefix_lists(reps: DataFrame, matches: int) -> DataFrame:
    """Per set its prefix postings: (rep, n, sig, map, posts, mask).

    Two sets that share ``matches`` of COORDINATES coordinates share one of the COORDINATES - matches + 1 rarest of
    either, in one order of all coordinate values. Values only one set has are the rarest, so most sets have no posting left.
    """
    posts = reps.select("rep", F.posexplode("sig").alias("c", "v")).select("rep", "c", F.xxhash64("c", "v").alias("key"))
    often = written(posts.groupBy("key").agg(F.count(F.lit(1)).alias("df")).filter("df > 1"), "near-often")
    shared = join_counted(posts, often, ["key"], "df", COORDINATES * reps.count())
    own = shared.groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("df", "key", "c"))).alias("posts"))
    keep = F.size("posts") - (matches - 1)
    own = own.filter(keep > 0).withColumn("posts", F.slice("posts", F.lit(1), F.greatest(keep, F.lit(1))))
    mask = F.aggregate("posts", F.lit(0).cast("long"), lambda m, p: m.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), p["c"])))
    own = own.withColumn("mask", mask)
    return reps.select("rep", "n", "sig", "map").join(own, "rep")


def near_groups(
    docs: DataFrame,
    *,
    shingle: int = 5,
    similar: int = 80,
    matches: int = MATCHES,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """Groups of documents linked by shingle sets: doc_id, n_shingles, component_id, kept; one row per input row.

    Words are runs of anything but ASCII white space, A-Z lower-cased; sets hold distinct ``shingle``-word runs, or
    a shorter text's whole sequence. Documents with 100 * intersection >= ``similar`` * union are linked, and component_id is the
    smallest id reachable. Null and empty texts have empty sets and are linked with nothing. Rows that repeat an id are one
    document: it is linked if one of its texts is. Null ids are one document that is smaller than all others. No rows
    give no rows; other columns are ignored.

    Equal sets collapse into classes first, by a 128-bit fingerprint, so exact copies never meet. Signatures meet in posting lists,
    long ones in tiles of bounded size. A list first gives pairs that span its candidates, fewer than its members; whole sets
    confirm them; then only pairs whose components still differ are tested. So no group is spelled out in
    pairs, and every link between different components is found.
    """
    text = F.coalesce(F.col(text_column), F.lit("")).cast("binary")
    rows = docs.select(F.coalesce(F.col(id_column).cast("long"), F.lit(NO_ID)).alias("id"), text.alias("data"))
    sketch = written(sketched(rows, shingle), "near-sketches")
    full = sketch.filter("n > 0")
    reps = full.groupBy("fp").agg(
        F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("map").alias("map")
    )
    reps = written(reps, "near-classes")
    prefix = written(prefix_lists(reps, matches), "near-prefixes")
    wanted = prefix.select(F.col("rep").alias("id")).distinct()
    sets = written(set_rows(rows.join(wanted, "id", "left_semi"), shingle), "near-sets")

    pairs = written(candidate_pairs(prefix, None, similar, matches), "near-pairs")
    links = written(linked(pairs, sets, similar), "near-links")
    labels = written(components(links), "near-labels")
    pairs = written(candidate_pairs(prefix, labels, similar, matches), "near-pairs")
    more = written(linked(pairs, sets, similar), "near-links")
    if not more.isEmpty():
        # join the components found so far
        labels = written(components(links.unionByName(more)), "near-labels")

    found = reps.select("fp", "rep", "copies").join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    found = found.select("fp", "copies", F.coalesce("component", "rep").alias("component_id"))
    members = join_counted(full.select("doc_id", "n", "fp"), written(found, "near-found"), ["fp"], "copies", full.count())
    lone = sketch.filter("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    every = members.select("doc_id", "n", "component_id").unionByName(lone)
    return every.select(
        _id("doc_id"), F.col("n").alias("n_shingles"), _id("component_id"), (F.col("doc_id") == F.col("component_id")).alias("kept")
    )


def _id(name: str) -> Column:
    return F.nullif(F.col(name), F.lit(NO_ID)).alias(name)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"), shingle=4, similar=80)

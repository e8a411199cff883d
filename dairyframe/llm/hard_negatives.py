"""Hard-negative mining by threshold joins over an inverted index bounded by suffix norms."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from dairyframe.llm.common import table, written

NAME = "op11_hard_negatives"
ORACLE = """
    WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                      [floor(256 * CAST(x AS DOUBLE)) for x in embedding] AS q FROM embeddings
               WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND label IS NOT NULL
                 AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
    s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
          FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
    p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score,
                 row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS nth FROM s WHERE same),
    n AS (SELECT p.anchor_id, positive_id, vec_id AS negative_id, positive_score, score AS negative_score,
                 CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS INT) AS rank
          FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 80 * positive_score <= 100 * score AND score <= positive_score
          WHERE nth <= 5)
    SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5"""
#: Rows of a shard, anchors of a block, anchors scored at a time, dimensions per step of the index.
SHARD, BLOCK, CHUNK, STEP = 8192, 2048, 128, 8
LIMIT = 2**63 - 1
#: Stands for a score not known: no window is cut by it.
UNKNOWN = -(2**63)
_FOUND = "anchor long, slot int, rid long, vec_id long, score long"


class Window_(NamedTuple):
    """Scores wanted of one anchor: the ``k`` best from ``low`` to ``high``, among rows of its label or of others."""

    anchor: int
    slot: int
    low: float
    high: float


class SuffixNormIndex:
    """Posting lists of a shard's rows by dimension, dimensions of much weight first.

    A dimension is left out of a row's postings from where the norm of the row's remaining dimensions is below the threshold (for an
    anchor of length one): what is left out cannot reach the threshold by itself, and its norm bounds what it may add. Rows are
    listed by how many dimensions they keep, so every posting list is the head of one list.
    """

    def __init__(self, rows: np.ndarray) -> None:
        self.order = np.argsort(-(rows**2).sum(0), kind="stable")
        self.rows = np.ascontiguousarray(rows[:, self.order])
        self.starts = list(range(0, rows.shape[1], STEP))
        self.rest = self._rests(self.rows)

    def _rests(self, m: np.ndarray) -> np.ndarray:
        """Norms from each step's first dimension on, and 0 after the last."""
        squares = np.stack([(m[:, j : j + STEP] ** 2).sum(1) for j in self.starts] + [np.zeros(len(m))], axis=1)
        return np.sqrt(np.cumsum(squares[:, ::-1], axis=1)[:, ::-1])

    def reaching(self, anchors: np.ndarray, thresholds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of rows that may reach the threshold of an anchor, and the exact scores of all anchors with them."""
        a = anchors[:, self.order]
        rest = self._rests(a)
        slack = 1e-9 * rest[:, :1] * max(1.0, self.rest[:, 0].max(initial=0)) + 1e-6
        t = thresholds[:, None] - slack
        with np.errstate(divide="ignore", invalid="ignore"):
            least = np.where(rest[:, 0] > 0, t[:, 0] / rest[:, 0], np.where(t[:, 0] > 0, np.inf, -np.inf)).min()
        kept = (self.rest[:, :-1] >= least).sum(1) if least > 0 else np.full(len(self.rows), len(self.starts))
        rows = np.argsort(-kept, kind="stable")
        rows = rows[: int((kept > 0).sum())]
        partial = np.zeros((len(a), len(rows)))
        for g, j in enumerate(self.starts):
            n = int((kept[rows] > g).sum())
            if not n:
                break
            partial[:, :n] += a[:, j : j + STEP] @ self.rows[rows[:n], j : j + STEP].T
            alive = ((partial[:, :n] + rest[:, g + 1 : g + 2] * self.rest[rows[:n], g + 1]) >= t).any(0)
            if alive.sum() < 0.7 * n:
                keep = np.concatenate([alive, np.ones(len(rows) - n, bool)])
                rows, partial = rows[keep], partial[:, keep]
        may = partial + rest[:, kept[rows]] * self.rest[rows, kept[rows]]
        rows = np.sort(rows[(may >= t).any(0)])
        return rows, a @ self.rows[rows].T


def _levels(top: float, low: float) -> Iterator[float]:
    """Falling thresholds that end at ``low``."""
    if np.isinf(low):
        yield from (top * f for f in (0.75, 0.5, 0.25, 0.0))
    else:
        yield from (top - (top - low) * f for f in (0.25, 0.5) if top > low)
    yield low


def fill_windows(
    rows: np.ndarray, row_ids: np.ndarray, row_rids: np.ndarray, fits, anchors: np.ndarray, own: np.ndarray, windows: list[Window_], k: int
) -> list[tuple[int, int, int, int, int]]:
    """(anchor rid, slot, rid, vec_id, score) of the ``k`` best rows of a shard in each window, ties to the smaller vec_id.

    ``fits(i)`` tells which rows anchor i may take. Each window starts at a high threshold that falls until ``k`` rows
    of the shard are in it or its lower end is reached; all rows above a threshold are known, so the best are.
    """
    found: list[tuple[int, int, int, int, int]] = []
    if not len(rows) or not windows:
        return found
    big = np.abs(anchors).max(initial=0) * np.abs(rows).max(initial=0) * rows.shape[1] >= 2**53
    index = None if big else SuffixNormIndex(rows)
    highest = 0.0 if big else float(index.rest[:, 0].max(initial=0))
    norms = np.sqrt((anchors**2).sum(1))
    ladders = {w: list(_levels(min(w.high, float(norms[w.anchor]) * highest), w.low)) for w in windows}
    for at in range(0, len(anchors), CHUNK):
        open_ = [w for w in windows if at <= w.anchor < at + CHUNK]
        step = 0
        while open_:
            level = {w: (ladders[w][step] if step < len(ladders[w]) else w.low) for w in open_}
            if big:
                level = {w: w.low for w in open_}
            asked = sorted({w.anchor for w in open_})
            place = {a: i for i, a in enumerate(asked)}
            if big:
                near = np.arange(len(rows))
                scores = np.vectorize(int, otypes=[object])(anchors[asked]).dot(np.vectorize(int, otypes=[object])(rows).T)
                scores = np.vectorize(lambda s: min(LIMIT, max(-LIMIT - 1, s)), otypes=[object])(scores)
            else:
                t = np.full(len(asked), np.inf)
                for w in open_:
                    t[place[w.anchor]] = min(t[place[w.anchor]], level[w])
                near, scores = index.reaching(anchors[asked], t)
            allowed = {a: fits(a)[near] & (row_rids[near] != own[a]) for a in asked}
            still = []
            for w in open_:
                line = scores[place[w.anchor]]
                inside = np.flatnonzero(allowed[w.anchor] & (line <= w.high) & (line >= level[w]))
                if len(inside) < k and level[w] > w.low:
                    still.append(w)
                    continue
                if len(inside) > 4 * k and not big:
                    inside = inside[line[inside] >= np.partition(line[inside], len(inside) - k)[len(inside) - k]]
                ranked = sorted((-int(line[i]), int(row_ids[near[i]]), int(row_rids[near[i]])) for i in inside)[:k]
                found += [(int(own[w.anchor]), w.slot, rid, vec, -minus) for minus, vec, rid in ranked]
            open_, step = still, step + 1
    return found


def _search(rows: DataFrame, asks: DataFrame, shards: range, blocks: int, k: int, scale: int, same: bool, low: int, high: int) -> DataFrame:
    """Tiles of ``asks`` (rid, label, x, dim, tops, hints) with ``shards`` of ``rows``: (anchor, slot, rid, vec_id, score).

    ``tops`` holds the score that each slot's window hangs on (none: one window without ends), ``hints`` scores that are known to be
    reached by ``k`` rows, below which nothing is needed.
    """
    none = F.lit(None).cast("array<long>")
    grid = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
    left = rows.filter(F.col("shard").between(shards[0], shards[-1])).select("shard", grid, "dim", "rid", "vec_id", "label", "x", none.alias("tops"), none.alias("hints"), F.lit(False).alias("asks"))
    every = F.explode(F.sequence(F.lit(shards[0]), F.lit(shards[-1]))).alias("shard")
    lane = F.pmod(F.xxhash64("rid"), F.lit(blocks)).cast("int").alias("block")
    right = asks.select(every, lane, "dim", "rid", "vec_id", "label", "x", "tops", "hints", F.lit(True).alias("asks"))

    def tile(pdf: pd.DataFrame) -> pd.DataFrame:
        asking = pdf["asks"].to_numpy()
        base, ask = pdf[~asking], pdf[asking]
        out: list[tuple] = []
        if len(base) and len(ask):
            labels, own = base["label"].to_numpy(), ask["label"].to_numpy()
            windows = []
            for i, (tops, hints) in enumerate(zip(ask["tops"], ask["hints"])):
                for slot in range(1 if tops is None else len(tops)):
                    ends = (-np.inf, np.inf) if tops is None else (-((-low * int(tops[slot])) // 100), (high * int(tops[slot])) // 100)
                    least = -np.inf if hints is None or hints[slot] == UNKNOWN else int(hints[slot])
                    if ends[0] <= ends[1]:
                        windows.append(Window_(i, slot, max(ends[0], least), ends[1]))
            vectors = [np.floor(np.stack([np.asarray(v, np.float64) for v in side["x"]]) * scale) for side in (base, ask)]
            if not vectors[0].shape[1]:  # empty vectors meet one another with a score of 0
                vectors = [np.zeros((len(v), 1)) for v in vectors]
            fits = (lambda i: labels == own[i]) if same else (lambda i: labels != own[i])
            out = fill_windows(vectors[0], base["vec_id"].to_numpy(), base["rid"].to_numpy(), fits, vectors[1], ask["rid"].to_numpy(), windows, k)
        return pd.DataFrame(out, columns=["anchor", "slot", "rid", "vec_id", "score"]).astype({"slot": "int32"})

    return left.unionByName(right).groupBy("shard", "block", "dim").applyInPandas(tile, _FOUND)


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "vec_id", "rid")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _joined(rows: DataFrame, asks: DataFrame, shards: int, blocks: int, k: int, name: str, **how) -> DataFrame:
    """The ``k`` best of every window over all shards.

    The first shard is joined alone. Where it fills a window, its k-th score is a threshold for the other shards: k rows reach
    it, so no row below it is needed. Windows that it leaves open fall to their lower end in every shard.
    """
    first = written(_search(rows, asks.withColumn("hints", F.lit(None).cast("array<long>")), range(1), blocks, k, **how), f"{name}-first")
    if shards == 1:
        return written(_best(first, k), f"{name}-best")
    reached = _best(first, k).filter(F.col("rank") == k).select("anchor", "slot", "score")
    # one entry per slot: the known score or nothing; an anchor has a few slots only
    held = reached.groupBy(F.col("anchor").alias("rid")).agg(F.map_from_entries(F.collect_list(F.struct("slot", "score"))).alias("known"))
    slots = F.sequence(F.lit(0), F.greatest(F.coalesce(F.size("tops"), F.lit(1)), F.lit(1)) - 1)
    hinted = asks.join(held, "rid", "left").withColumn("hints", F.transform(slots, lambda s: F.coalesce(F.col("known")[s], F.lit(UNKNOWN))))
    rest = _search(rows, hinted, range(1, shards), blocks, k, **how)
    return written(_best(first.unionByName(written(rest, f"{name}-rest")), k), f"{name}-best")


def mine(
    rows: DataFrame,
    is_anchor: Column,
    *,
    positives: int = 5,
    negatives: int = 5,
    low: int = 80,
    high: int = 100,
    scale: int = 256,
    shard: int = SHARD,
    block: int = BLOCK,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    label_column: str = "label",
) -> DataFrame:
    """For every anchor and each of its best rows of the same label, the best rows of other labels at ``low`` to ``high`` percent of its score.

    Returns anchor_id, positive_id, rank, negative_id, positive_score, negative_score. ``is_anchor`` is a condition on ``vec_id``; components
    become floor(scale * x) and scores are exact inner products; ties go to the smaller id. Rows without an id or a
    label, with a null vector or a null or non-finite component take no part. Rows that repeat an id are rows of their own: an
    anchor only leaves out itself. Vectors of other lengths never meet. Negative positives have an empty window, and a positive of 0
    asks for scores of 0. Empty vectors score 0 with one another. Scores beyond a long count as the nearest long. No rows give no result.

    Rows are dealt into shards and anchors into blocks; a task joins one block with one shard, CHUNK anchors at a time,
    by thresholds that fall until windows are full.
    """
    x = F.col(vector_column).cast("array<double>")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    whole = F.col(id_column).isNotNull() & F.col(label_column).isNotNull() & x.isNotNull() & ~bad
    good = rows.filter(whole).select(
        F.monotonically_increasing_id().alias("rid"), F.col(id_column).cast("long").alias("vec_id"), F.col(label_column).cast("long").alias("label"), x.alias("x"), F.size(x).alias("dim")
    )
    good = written(good, "negatives-rows")  # rid is fixed by this write
    n, m = good.count(), good.filter(is_anchor).count()
    shards, blocks = max(1, -(-n // shard)), max(1, -(-m // block))
    dealt = good.withColumn("shard", F.pmod(F.xxhash64("rid"), F.lit(shards)).cast("int"))
    how = {"scale": scale, "low": low, "high": high}
    anchors = good.filter(is_anchor).withColumn("tops", F.lit(None).cast("array<long>"))
    best = _joined(dealt, anchors, shards, blocks, positives, "positives", same=True, **how)
    tops = best.groupBy(F.col("anchor").alias("rid")).agg(F.array_sort(F.collect_list(F.struct("rank", "score"))).alias("tops"))
    asks = anchors.drop("tops").join(tops.select("rid", F.col("tops.score").alias("tops")), "rid")
    hard = _joined(dealt, asks, shards, blocks, negatives, "negatives", same=False, **how)
    pairs = best.select("anchor", (F.col("rank") - 1).alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    names = anchors.select(F.col("rid").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    found = hard.select("anchor", "slot", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return found.join(pairs, ["anchor", "slot"]).join(names, "anchor").select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vec = F.col("vec_id")
    label = F.when(vec % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", label.alias("label"))
    return mine(rows, vec % 100 == 0)

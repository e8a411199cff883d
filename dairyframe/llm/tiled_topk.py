"""Exact top-k inner-product search by tiled matrix products."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from dairyframe.llm.common import table, written

NAME = "op8_exact_topk"
ORACLE = """
    WITH v AS (SELECT vec_id, [floor(256 * CAST(x AS DOUBLE)) for x in embedding] AS q FROM embeddings
               WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
                 AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
    s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
          FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
    r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM s)
    SELECT * FROM r WHERE rank <= 5"""
SHARD = 4096
BLOCK = 1024
FAN_IN = 64
LIMIT = 2**63 - 1


def usable(rows: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(rid, vec_id, x): whole finite vectors with an id; rid tells rows apart that repeat an id."""
    x = F.col(vector_column).cast("array<double>")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    good = rows.filter(F.col(id_column).isNotNull() & x.isNotNull() & ~bad)
    return good.select(F.monotonically_increasing_id().alias("rid"), F.col(id_column).cast("long").alias("vec_id"), x.alias("x"))


def _matrix(vectors, scale: int) -> np.ndarray:
    """Quantised vectors as integers in doubles; the product by a power of two and the floor are exact."""
    return np.floor(np.stack([np.asarray(v, np.float64) for v in vectors]) * scale)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products: doubles while every sum stays below 2**53, otherwise whole numbers of any size."""
    if a.size == 0 or np.abs(a).max() * np.abs(b).max() * a.shape[1] < 2**53:
        return a @ b.T
    whole = np.vectorize(int, otypes=[object])
    return whole(a).dot(whole(b).T)


def best_of_tile(ids: np.ndarray, scores: np.ndarray, own: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(query, row, score) of the ``k`` best per line of ``scores``, rows by their ``ids``; the left one of equal scores comes first."""
    found = []
    if scores.dtype == object:
        for query, line in zip(own, scores):
            order = sorted((-min(LIMIT, max(-LIMIT - 1, s)), at) for at, (s, i) in enumerate(zip(line, ids)) if i != query)[:k]
            found += [(int(query), int(ids[at]), int(-s)) for s, at in order]
        return found
    scores = np.where(own[:, None] == ids[None, :], -np.inf, scores)
    k = min(k, len(ids))
    cut = np.partition(scores, len(ids) - k, axis=1)[:, len(ids) - k][:, None]
    above, equal = scores > cut, scores == cut
    take = above | (equal & (np.cumsum(equal, axis=1, dtype=np.int32) <= k - above.sum(axis=1)[:, None]))
    take &= np.isfinite(scores)
    for r, c in zip(*np.nonzero(take)):
        found.append((int(own[r]), int(ids[c]), int(scores[r, c])))
    return found


def top_k(
    vectors: DataFrame,
    is_query,
    *,
    k: int = 5,
    scale: int = 256,
    shard: int = SHARD,
    block: int = BLOCK,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
) -> DataFrame:
    """The ``k`` best inner products of every query row with all other rows: query_id, rank, vec_id, score.

    ``is_query`` is a condition on vec_id. Components become floor(scale * x), ``scale`` a power of two; scores are exact,
    ties go to the smaller vec_id. Vectors that are null or hold a null or non-finite component, and rows
    without an id, take no part; rows that repeat an id are rows of their own, and a query only leaves out
    itself. Vectors of different lengths never meet: only those as long as the query are its candidates. Scores beyond a long
    count as the nearest long. Fewer candidates give fewer rows; no rows give none.

    Vectors are dealt into shards of about ``shard`` rows and queries into blocks of about ``block``; one
    task multiplies one block by one shard, so it holds block * shard scores and no more. Each tile keeps
    ``k`` per query. The lists meet in a tree: FAN_IN tiles at a time, so no task sees all lists of a query.
    """
    # rid is fixed by this write
    good = written(usable(vectors, id_column, vector_column).withColumn("dim", F.size("x")), "topk-vectors")
    n, m = good.count(), good.filter(is_query).count()
    shards, blocks = max(1, -(-n // shard)), max(1, -(-m // block))
    side = F.pmod(F.xxhash64("rid"), F.lit(shards)).cast("int")
    grid = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
    left = good.select(side.alias("shard"), "dim", "rid", "vec_id", "x", grid, F.lit(False).alias("asks"))
    lane = F.pmod(F.xxhash64(F.col("rid"), F.lit(1)), F.lit(blocks)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard")
    right = good.filter(is_query).select(every, "dim", "rid", "vec_id", "x", lane.alias("block"), F.lit(True).alias("asks"))
    tiles = left.unionByName(right).groupBy("shard", "block", "dim")

    def tile(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["vec_id", "rid"], kind="stable")
        asks = pdf["asks"].to_numpy()
        ids, own = pdf["rid"].to_numpy()[~asks], pdf["rid"].to_numpy()[asks]
        rows: list[tuple[int, int, int]] = []
        if len(ids) and len(own):
            base, ask = _matrix(pdf["x"][~asks], scale), _matrix(pdf["x"][asks], scale)
            for at in range(0, len(own), 256):
                rows += best_of_tile(ids, _products(ask[at : at + 256], base), own[at : at + 256], k)
        out = pd.DataFrame(rows, columns=["query", "rid", "score"]).astype("int64")
        names = dict(zip(pdf["rid"], pdf["vec_id"]))
        out["query_id"], out["vec_id"] = (out[c].map(names).astype("int64") for c in ("query", "rid"))
        out["tile"] = np.int32(key[0])
        return out

    kind = "query long, rid long, score long, query_id long, vec_id long, tile int"
    found = written(tiles.applyInPandas(tile, kind), "topk-tiles")
    while True:
        best = Window.partitionBy("query", "tile").orderBy(F.desc("score"), "vec_id", "rid")
        found = found.withColumn("tile", F.floor(F.col("tile") / FAN_IN).cast("int"))
        found = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
        shards = -(-shards // FAN_IN)
        if shards == 1:
            return found.select("query_id", "rank", "vec_id", "score")
        found = found.drop("rank")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)

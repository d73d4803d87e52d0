"""Nearest neighbours by a block matrix join.

Queries and candidates are dealt into blocks of a bounded number of rows; each cell of the grid
(query block, candidate block) is one task group. Within a cell, vectors of length 1 are quantised to
int8; tile products of these integers give every cosine up to a bound from the quantisation errors
of both vectors. Per query, the k-th best lower bound so far prunes all pairs whose upper bound is
below it; the pairs that survive are recomputed in double precision from the original vectors, and
a heap per query merges what the tiles keep. A query's k best of each cell, k rows, then meet in one
more aggregation. The result is exact.

Equal vectors within a block stand for each other: only the k + 1 smallest ids of a vector can be
among a query's k nearest (one of them may be the query itself), so the rest of them is left out of the
cell, which changes nothing. Vectors that are null, zero, of another length than most, or that hold
null or non-finite components take no part. Ties go to the smaller id. Repeated ids: each row counts;
a query never meets rows of its own id. Empty table: no rows. Other columns are not looked at.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import ship, stored

NEAREST, TILE, QUERY_TILE = 5, 1024, 2048
#: Bytes of vectors in a block at most; rows of a candidate block at least, so that small tables still make several.
BLOCK_BYTES, CANDIDATE_BLOCK = 32 << 20, 8192


def levelled(vectors: np.ndarray) -> np.ndarray:
    """Each vector times the power of two that brings its largest component to [0.5, 1): exact, and squares neither overflow nor vanish."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(1, keepdims=True))[1])


def quantised(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales and error lengths of levelled vectors scaled to length 1."""
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    scale = np.abs(unit).max(1, keepdims=True) / 127
    codes = np.rint(unit / scale).astype(np.int8)
    return codes, scale[:, 0], np.linalg.norm(unit - codes * scale, axis=1)


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of aligned rows in double precision; each row's sum is taken in the same order wherever it stands."""
    return (a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)))


def cell(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int) -> list[tuple[int, int, float]]:
    """(query, candidate, cosine): the k nearest of each query, its own id left out."""
    if not len(query_ids) or not len(ids):
        return []
    order = np.lexsort((ids,))
    ids, vectors, queries = ids[order], levelled(vectors[order]), levelled(queries)
    _, kind = np.unique(vectors, axis=0, return_inverse=True)
    kind = kind.ravel()
    by_kind = np.argsort(kind, kind="stable")
    place = np.arange(len(ids)) - np.searchsorted(kind[by_kind], kind[by_kind])
    kept = np.sort(by_kind[place <= k])
    ids, vectors = ids[kept], vectors[kept]
    codes = quantised(vectors)
    return [x for a in range(0, len(query_ids), QUERY_TILE) for x in _tiles(query_ids[a : a + QUERY_TILE], queries[a : a + QUERY_TILE], ids, vectors, codes, k)]


def _tiles(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, quantities: tuple, k: int) -> list[tuple[int, int, float]]:
    """cell() of a tile of levelled queries against levelled vectors, tile by tile."""
    q_codes, q_scale, q_error = quantised(queries)
    codes, scale, error = quantities
    wide = np.float32 if vectors.shape[1] * 127 * 127 < 1 << 24 else np.float64  # sums of products stay exact integers
    heaps: list[list[tuple[float, int]]] = [[] for _ in query_ids]
    floor = np.full(len(query_ids), -np.inf)
    left = q_codes.astype(wide)
    for a in range(0, len(ids), TILE):
        part = slice(a, a + TILE)
        near = (left @ codes[part].astype(wide).T).astype(np.float64) * q_scale[:, None] * scale[None, part]
        bound = q_error[:, None] + (1 + q_error[:, None]) * error[None, part] + 1e-9
        near[query_ids[:, None] == ids[None, part]] = -np.inf
        if near.shape[1] >= k:
            floor = np.maximum(floor, np.partition(near - bound, -k, axis=1)[:, -k])
        rows, columns = np.nonzero((near + bound >= floor[:, None]) & np.isfinite(near))
        cosines = exact(queries[rows], vectors[a + columns])
        for q, c, cosine in zip(rows.tolist(), (a + columns).tolist(), cosines.tolist(), strict=True):
            item, heap = (cosine, -int(ids[c])), heaps[q]
            if len(heap) < k:
                heapq.heappush(heap, item)
            elif item > heap[0]:
                heapq.heapreplace(heap, item)
        full = [h[0][0] if len(h) == k else -np.inf for h in heaps]
        floor = np.maximum(floor, full)
    return [(int(q), -i, s) for q, heap in zip(query_ids, heaps, strict=True) for s, i in heap]


def nearest(vectors: DataFrame, is_query, id_col: str = "vec_id", vector_col: str = "embedding", k: int = NEAREST, query_block: int | None = None, candidate_block: int | None = None) -> DataFrame:
    """(query, rank, id, score): the k nearest rows of each row for which is_query (a condition on id_col) holds.

    Every candidate goes to each query block and every query to each candidate block. So blocks are as large as BLOCK_BYTES
    allows, but candidate blocks at first no larger than keeps all cores busy.
    """
    ship(vectors.sparkSession)
    v = F.col(vector_col).cast("array<double>")
    fit = F.coalesce((F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0), F.lit(False))
    rows = vectors.select(vectors[id_col].cast("long").alias("id"), v.alias("v"), is_query.alias("q")).where(fit & F.col("id").isNotNull())
    rows = stored(rows, "vectors")
    counts = rows.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("c"), F.sum(F.col("q").cast("long")).alias("qs")).orderBy(F.desc("c"), "n").first()
    if counts is None:
        return rows.select(F.col("id").alias("query"), F.lit(1).alias("rank"), "id", F.lit(0.0).alias("score"))
    rows = rows.where(F.size("v") == counts["n"])
    most = max(1, BLOCK_BYTES // (8 * counts["n"]))
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    query_block = query_block or most
    candidate_block = candidate_block or min(most, max(CANDIDATE_BLOCK, -(-counts["c"] // (4 * cores))))
    n_q, n_c = -(-counts["qs"] // query_block) or 1, -(-counts["c"] // candidate_block)
    deal = F.xxhash64("id", F.lit(7))
    candidates = rows.select("id", "v", F.lit(False).alias("asks"), F.pmod(deal, F.lit(n_c)).cast("int").alias("c"), F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))).alias("b"))
    queries = rows.where("q").select("id", "v", F.lit(True).alias("asks"), F.explode(F.sequence(F.lit(0), F.lit(n_c - 1))).alias("c"), F.pmod(F.xxhash64("id", F.lit(11)), F.lit(n_q)).cast("int").alias("b"))

    def run(pdf):
        import pandas as pd

        asks = pdf["asks"].to_numpy(bool)
        ids, all_vectors = pdf["id"].to_numpy(np.int64), np.stack(pdf["v"].to_numpy()).astype(np.float64)
        return pd.DataFrame(cell(ids[asks], all_vectors[asks], ids[~asks], all_vectors[~asks], k), columns=["query", "id", "score"])

    best = queries.unionByName(candidates).groupBy("b", "c").applyInPandas(run, "query long, id long, score double")
    order = F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "id", "score")))
    merged = best.groupBy("query").agg(F.slice(order, 1, k).alias("top"))  # k rows a candidate block and query
    return merged.select("query", F.posexplode("top").alias("p", "t")).select("query", (F.col("p") + 1).cast("int").alias("rank"), F.col("t.id").alias("id"), F.col("t.score").alias("score"))


def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest rows of every row whose id is divisible by 50."""
    out = nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)
    return out.toDF("query_id", "rank", "vec_id", "score")

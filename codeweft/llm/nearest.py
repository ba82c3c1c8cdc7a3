"""Exact nearest neighbours by inner product as a block matrix join.

Rows are hashed by id and vector, as queries into blocks and as candidates into shards, and each (block, shard) is one group. Inside it, vectors are quantised to
int8 with one scale each; tiles of the integer product give every inner product up to a bound (Cauchy-Schwarz on the
quantisation residuals, whose norms are known). Pairs whose upper bound reaches the k-th best lower bound are recomputed in double
precision from the original vectors and kept in a heap of k different ids per query, each with its best score. Bounds count
different ids too. A last window merges the k rows per query and shard.

Rows of equal id and vector are one row, and the rows of one id are spread over all shards. Equal vectors of a shard are multiplied once and stand for their k + 1 smallest ids, since later ids lose every tie.

Defined results: vectors that are null, zero, or hold null or non-finite components take no part; only vectors of equal length
meet; rows repeating an id are one item with several vectors, near by the best of them; null ids take no part.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bounds of a group: numbers (rows times their length) of a block of queries and of a shard of candidates.
BLOCK_NUMBERS = 1 << 20
SHARD_NUMBERS = 1 << 22
TILE = (512, 4_096)
_OUT = "query_id long, vec_id long, score double"


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` candidates of largest inner product, ties to smaller ids.

    ``is_query`` is a condition on the columns of ``vectors``; every row is a candidate, except for its own id.
    """
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    rows = vectors.select(vectors[id_col].cast("long").alias("id"), vectors[vector_col].cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.filter(F.col("id").isNotNull() & F.coalesce(sound, F.lit(False)))
    size = F.size("v").cast("long")
    n, numbers, asked = rows.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0)), F.coalesce(F.sum(F.when(F.col("asks"), size)), F.lit(0))).first()
    shards = max(1, -(-numbers // SHARD_NUMBERS), min(2 * cores, n // 2_000))
    blocks = max(1, -(-asked // BLOCK_NUMBERS))
    rows = rows.distinct().withColumn("dim", F.size("v"))
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    queries = rows.filter("asks").select(F.pmod(F.hash("id", "v"), F.lit(blocks)).alias("block"), every(shards).alias("shard"), "dim", "id", "v")
    candidates = rows.select(F.pmod(F.xxhash64("id", "v"), F.lit(shards)).cast("int").alias("shard"), every(blocks).alias("block"), "dim", "id", "v")
    by = ["block", "shard", "dim"]
    best = queries.groupBy(by).cogroup(candidates.groupBy(by)).applyInArrow(lambda q, c: _join(q, c, k), _OUT)
    one = best.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return one.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    ids, v = table.column("id").to_numpy(), table.column("v").combine_chunks()
    return ids, v.flatten().to_numpy().reshape(len(ids), -1)


class Quantised:
    """int8 codes (held as float32, in which sums of their products below 2**24 are exact), scales and norms."""

    def __init__(self, v: np.ndarray) -> None:
        # Scaled to a largest component of 1 first, so that neither tiny nor huge components overflow in squares.
        top = np.abs(v).max(axis=1)
        unit = v / top[:, None]
        codes = np.rint(unit * 127)
        self.codes = codes.astype(np.float32 if v.shape[1] * 127 * 127 < 1 << 24 else np.float64)
        self.scale = top / 127
        self.shown = np.sqrt((codes**2).sum(axis=1)) * self.scale
        self.lost = np.sqrt(((unit - codes / 127) ** 2).sum(axis=1)) * top
        self.norm = np.sqrt((unit**2).sum(axis=1)) * top


def _join(queries: pa.Table, candidates: pa.Table, k: int) -> pa.Table:
    if not queries.num_rows or not candidates.num_rows:
        return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
    q_ids, q = _matrix(queries)
    c_ids, c = _matrix(candidates)
    order = np.argsort(c_ids, kind="stable")
    c_ids, c = c_ids[order], c[order]
    c, which = np.unique(c, axis=0, return_inverse=True)
    by = np.argsort(which.ravel(), kind="stable")
    edges = np.searchsorted(which.ravel()[by], np.arange(len(c) + 1))
    members = [np.unique(c_ids[by[a:b]])[: k + 1].tolist() for a, b in zip(edges[:-1], edges[1:], strict=True)]
    # Columns that share their smallest id lie side by side: together they count as one id in the bounds.
    first = np.array([m[0] for m in members])
    order = np.argsort(first, kind="stable")
    c, first, members = c[order], first[order], [members[i] for i in order.tolist()]
    alone = np.array([len(m) == 1 for m in members])
    a, b = Quantised(q), Quantised(c)
    heaps: list[list] = [[] for _ in q_ids]
    more = len(np.unique(c_ids)) < len(c_ids)
    for low in range(0, len(q), TILE[0]):
        rows = slice(low, low + TILE[0])
        floor = np.full(len(q[rows]), -np.inf)
        for left in range(0, len(c), TILE[1]):
            cols = slice(left, left + TILE[1])
            product = (a.codes[rows] @ b.codes[cols].T).astype(np.float64) * a.scale[rows, None] * b.scale[None, cols]
            spread = a.shown[rows, None] * b.lost[None, cols] + a.lost[rows, None] * b.norm[None, cols]
            spread += 1e-12 * a.norm[rows, None] * b.norm[None, cols]
            least, near = product - spread, product + spread
            starts = np.flatnonzero(np.diff(first[cols], prepend=first[left] - 1))
            repeated = len(starts) < least.shape[1]
            if repeated:
                least = np.maximum.reduceat(least, starts, axis=1)
            # A query's own id may hold one of the best places, so the bound is the (k + 1)-th.
            if least.shape[1] > k:
                floor = np.maximum(floor, np.partition(least, -(k + 1), axis=1)[:, -(k + 1)])
            wanted = near >= floor[:, None]
            if repeated:
                # A vector of one id only counts if it can be the best of that id.
                wanted &= ~alone[cols] | (near >= np.repeat(least, np.diff(starts, append=near.shape[1]), axis=1))
            i, j = np.nonzero(wanted)
            exact = np.zeros(len(i))
            for d in range(q.shape[1]):
                exact += q[low + i, d] * c[left + j, d]
            for qi, ci, score in zip((low + i).tolist(), (left + j).tolist(), exact.tolist(), strict=True):
                heap, own = heaps[qi], q_ids[qi]
                for other in members[ci]:
                    if other == own:
                        continue
                    if len(heap) == k and (score, -other) <= heap[0]:
                        break
                    at = next((n for n, kept in enumerate(heap) if kept[1] == -other), None) if more else None
                    if at is not None:
                        if score > heap[at][0]:
                            heap[at] = (score, -other)
                            heapq.heapify(heap)
                    elif len(heap) < k:
                        heapq.heappush(heap, (score, -other))
                    else:
                        heapq.heapreplace(heap, (score, -other))
            for r in range(len(floor)):
                if len(heaps[low + r]) == k:
                    floor[r] = max(floor[r], heaps[low + r][0][0])
    names, others, scores = [], [], []
    for own, heap in zip(q_ids.tolist(), heaps, strict=True):
        for score, other in heap:
            names.append(own)
            others.append(-other)
            scores.append(score)
    return pa.table({"query_id": pa.array(names, pa.int64()), "vec_id": pa.array(others, pa.int64()), "score": pa.array(scores, pa.float64())})

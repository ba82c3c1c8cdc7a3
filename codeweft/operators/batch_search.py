"""Search of a whole query batch over a large table, keeping only the best rows per query and task.

``collector(queries)`` builds an object with ``add(rows)`` and ``result()``, both on Arrow tables. Only rows of the repos asked
are read. A query batch of checked size is broadcast and the searched table stays where it is. A larger batch is hashed into
blocks of its repo, which meet shards of the same repo in a co-grouped shuffle; every (repo, block, shard) is one bounded group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweft.functions.memory import give_back
from codeweft.session import BROADCAST_BYTES, broadcast_if_small, cut, measured_bytes, spread

SHARD_ROWS = 50_000
QUERY_BLOCK_ROWS = 16_384
#: Query-row scores held at once in a task (8 bytes each, a few arrays of them).
TILE_CELLS = 2_000_000
# Scores equal to this many decimals are ties: the order in which partial sums meet is not fixed on a cluster.
TIE_DECIMALS = 9


def batch_search(
    rows: DataFrame, row_key: str, queries: DataFrame, collector: Callable, schema: str, limit: int = BROADCAST_BYTES, shard_rows: int = SHARD_ROWS
) -> DataFrame:
    """Partial best rows per query; the caller ranks them once more. ``shard_rows`` rows meet one block of a large batch."""
    rows = rows.join(broadcast_if_small(queries.select("repo_id").distinct()), "repo_id", "left_semi")
    if measured_bytes(queries) <= limit:
        shared = rows.sparkSession.sparkContext.broadcast(queries.toArrow())

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = collector(shared.value)
            for batch in batches:
                if batch.num_rows:
                    best.add(pa.Table.from_batches([batch]))
            yield from best.result().to_batches()
            give_back()

        return spread(rows, row_key).mapInArrow(scan, schema)

    queries = cut(queries)
    blocks = queries.groupBy("repo_id").agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK_ROWS).cast("int").alias("_blocks"))
    shards = rows.groupBy("repo_id").agg(F.ceil(F.count(F.lit(1)) / shard_rows).cast("int").alias("_shards"))
    parts = cut(blocks.join(shards, "repo_id"))

    def dealt(df: DataFrame, own: str, key: str, other: str) -> DataFrame:
        known = df.join(broadcast_if_small(parts), "repo_id")
        mine = F.pmod(F.xxhash64(key), F.col(f"{own}s")).cast("int").alias(own)
        return known.select(*df.columns, mine, F.explode(F.sequence(F.lit(0), F.col(f"{other}s") - 1)).alias(other))

    left = dealt(rows, "_shard", row_key, "_block")
    right = dealt(queries, "_block", "query_id", "_shard")

    def meet(found: pa.Table, asked: pa.Table) -> pa.Table:
        best = collector(asked)
        if found.num_rows and asked.num_rows:
            best.add(found)
        return best.result()

    by = ["repo_id", "_block", "_shard"]
    return left.groupBy(by).cogroup(right.groupBy(by)).applyInArrow(meet, schema)


class BestRows:
    """Best k ids of every query of one repo over the tiles offered so far; ties go to the smaller id."""

    def __init__(self, query_ids: np.ndarray, k: int) -> None:
        self.query_ids, self.k = query_ids, k
        self.cutoff = np.full(len(query_ids), -np.inf)
        self.query, self.score, self.id = np.zeros(0, np.int64), np.zeros(0), None

    def offer(self, scores: np.ndarray, ids: np.ndarray, wanted: np.ndarray | None = None) -> None:
        """``scores[query, row]`` of the rows ``ids``; ``wanted`` marks the pairs that count."""
        rounded = np.round(scores, TIE_DECIMALS)
        if wanted is not None:
            rounded = np.where(wanted, rounded, -np.inf)
        if rounded.shape[1] > self.k:
            best = -np.partition(-rounded, self.k - 1, axis=1)[:, self.k - 1]
            self.cutoff = np.maximum(self.cutoff, best)
        query, row = np.nonzero((rounded >= self.cutoff[:, None]) & (rounded > -np.inf))
        self.offer_pairs(query, scores[query, row], ids[row])

    def offer_pairs(self, query: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Scores of single (query, row) pairs; rows that are left out must not be among the best."""
        if not len(query):
            return
        self.query = np.concatenate([self.query, query])
        self.score = np.concatenate([self.score, scores])
        self.id = ids if self.id is None else np.concatenate([self.id, ids])
        _, order_of_id = np.unique(self.id, return_inverse=True)
        order = np.lexsort((order_of_id, -np.round(self.score, TIE_DECIMALS), self.query))
        query = self.query[order]
        heads = np.flatnonzero(np.append(True, query[1:] != query[:-1]))
        rank = np.arange(len(query)) - np.repeat(heads, np.diff(np.append(heads, len(query))))
        order = order[rank < self.k]
        self.query, self.score, self.id = self.query[order], self.score[order], self.id[order]
        full = rank == self.k - 1
        self.cutoff[query[full]] = np.maximum(self.cutoff[query[full]], np.round(self.score[rank[rank < self.k] == self.k - 1], TIE_DECIMALS))


def result_table(best: Iterable[tuple[str, BestRows]], query_type: pa.DataType, id_type: pa.DataType) -> pa.Table:
    """(query_id, repo_id, id, score) of every repo's best rows."""
    kept = [(repo, b) for repo, b in best if b.id is not None and len(b.id)]
    ids = [x for _, b in kept for x in b.id.tolist()]
    return pa.table(
        {
            "query_id": pa.array([x for _, b in kept for x in b.query_ids[b.query].tolist()], query_type),
            "repo_id": pa.array([repo for repo, b in kept for _ in range(len(b.id))], pa.string()),
            "id": pa.array(ids, id_type),
            "score": pa.array(np.concatenate([b.score for _, b in kept]) if kept else [], pa.float64()),
        }
    )

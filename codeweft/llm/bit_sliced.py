"""Exact top-k inner products of integer vectors on a bit-sliced index.

The index deals rows into segments. A segment keeps, for every attribute, its ``SLICES`` most significant bits as bitmaps over the
rows (counted from the attribute's least value, so that no bit is wasted), the row ids and the whole values. A query adds the
slices, weighted by its own components, with bitmap arithmetic only: every set bit of a weight adds the attribute's slices shifted
by that bit (complemented for negative weights), and full adders over whole bitmaps reduce all that meet at one binary place to
one, carrying to the next place. What results are the slices of a score that is exact up to the bits left out, whose error has a
known bound. The k-th best value is found by walking those slices from the most significant one down; a second walk selects the
rows that may still reach it. Only these boundary rows are scored exactly, from the whole values.

Query blocks meet batches of segments in a co-grouped shuffle, both bounded by numbers held, not by rows; within a batch the best
scores so far bound the next segment. A last window merges k rows per query and batch.

Defined results: vectors that are null, empty, or hold null, non-finite or (as integers) larger than 55-bit components take no
part, and rows without an id neither; only vectors of equal length meet. Rows repeating id and vector are one; different vectors
of one id are rows of their own, and none of them is found by its own id. Scores beyond a long are given as its nearest value.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeweft.llm.words import pack_arrays, unpack_arrays
from codeweft.session import cut

SLICES = 6
#: Vector components in a segment, and in a block of queries.
SEGMENT_NUMBERS = 1 << 20
BLOCK_NUMBERS = 1 << 20
#: Segments that one group visits one after the other, where there are enough groups for all cores.
BATCH = 8
_LONG = (1 << 63) - 1
#: Magnitude from which a component (as an integer) takes no part, so that sums of 60,000 products fit the two halves below.
LARGEST = 1 << 55
# A score is high * 2**62 + low.
_HALF = 62
_OUT = "query_id long, vec_id long, high long, low long"


def integers(vector: Column, scale: int) -> Column:
    """``floor(scale * x)`` of every component, or null if the vector takes no part."""
    numbers = F.transform(vector.cast("array<double>"), lambda x: x * F.lit(float(scale)))
    sound = F.forall(numbers, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float(LARGEST)))
    return F.when(sound & (F.size(numbers) > 0), F.transform(numbers, lambda x: F.floor(x)))


def build_index(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256, slices: int = SLICES, numbers: int = SEGMENT_NUMBERS) -> DataFrame:
    """``segment, dim, n, blob``: one row per segment of the rows of ``vectors``, kept as a table."""
    rows = _sound(vectors, id_col, vector_col, scale).distinct()
    sizes = rows.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("rows"))
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    parts = F.greatest(F.ceil(F.col("rows") * F.col("dim") / numbers), F.least(F.lit(cores), F.floor(F.col("rows") / 2_000)), F.lit(1))
    # One row per vector length.
    dealt = rows.withColumn("dim", F.size("v")).join(sizes.select("dim", parts.cast("int").alias("parts")), "dim")
    dealt = dealt.select("dim", F.pmod(F.xxhash64("id", "v"), F.col("parts")).cast("int").alias("segment"), "id", "v")
    return cut(dealt.groupBy("dim", "segment").applyInArrow(lambda t: _segment(t, slices), "segment int, dim int, n int, blob binary"))


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256, index: DataFrame | None = None, block_numbers: int = BLOCK_NUMBERS, batch: int = BATCH) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` rows of the highest integer inner products, ties to smaller ids.

    ``is_query`` is a condition on the columns of ``vectors``; candidates are the rows of ``index`` (of ``vectors``, if not given).
    """
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    index = build_index(vectors, id_col, vector_col, scale) if index is None else index
    asked = _sound(vectors.filter(F.coalesce(is_query, F.lit(False))), id_col, vector_col, scale).distinct().withColumn("dim", F.size("v"))
    spans = index.groupBy("dim").agg((F.max("segment") + 1).alias("segments"))
    blocks = F.greatest(F.ceil(F.count("*") * F.col("dim") / block_numbers), F.lit(1)).cast("int")
    each = F.greatest(F.least(F.lit(batch), F.floor(F.col("segments") * F.col("blocks") / (2 * cores))), F.lit(1)).cast("int")
    # One row per vector length again.
    plan = asked.groupBy("dim").agg(blocks.alias("blocks")).join(spans, "dim").withColumn("each", each)
    plan = cut(plan.withColumn("batches", F.ceil(F.col("segments") / F.col("each")).cast("int")))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    queries = asked.join(plan, "dim").select("dim", F.pmod(F.hash("id", "v"), F.col("blocks")).alias("block"), every("batches").alias("batch"), "id", "v")
    segments = index.join(plan, "dim").select("dim", every("blocks").alias("block"), F.floor(F.col("segment") / F.col("each")).cast("int").alias("batch"), "n", "blob")
    by = ["dim", "block", "batch"]
    best = queries.groupBy(by).cogroup(segments.groupBy(by)).applyInArrow(lambda q, s: _search(q, s, k), _OUT)
    order = Window.partitionBy("query_id").orderBy(F.desc("high"), F.desc("low"), "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    whole = F.when(F.col("high") > 1, F.lit(_LONG)).when(F.col("high") < -2, F.lit(-_LONG - 1)).otherwise(F.shiftleft("high", _HALF) + F.col("low"))
    return ranked.select("query_id", "rank", "vec_id", whole.alias("score"))


def _sound(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    rows = vectors.select(vectors[id_col].cast("long").alias("id"), integers(vectors[vector_col], scale).alias("v"))
    return rows.filter(F.col("id").isNotNull() & F.col("v").isNotNull())


def _matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return table["id"].to_numpy(), table["v"].combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1)


def _segment(rows: pa.Table, slices: int) -> pa.Table:
    ids, values = _matrix(rows)
    order = np.argsort(ids, kind="stable")
    ids, values = ids[order], values[order]
    low = values.min(axis=0)
    # Differences of longs may need 64 bits without a sign.
    above = values.astype(np.uint64) - low.astype(np.uint64)
    shift = np.maximum(0, np.array([int(x).bit_length() for x in above.max(axis=0)]) - slices).astype(np.uint64)
    kept = above >> shift
    padded = -(-len(ids) // 64) * 64
    bitmaps = np.zeros((values.shape[1] * slices, padded // 8), np.uint8)
    for d in range(values.shape[1]):
        for b in range(slices):
            bits = ((kept[:, d] >> np.uint64(b)) & np.uint64(1)).astype(np.uint8)
            bitmaps[d * slices + b, : -(-len(ids) // 8)] = np.packbits(bits, bitorder="little")
    kind = next(t for t in (np.int16, np.int32, np.int64) if np.iinfo(t).min <= values.min() and values.max() <= np.iinfo(t).max)
    blob = pack_arrays(ids, low, shift, bitmaps, values.astype(kind), np.dtype(kind).str.encode())
    return pa.table({"segment": rows["segment"][:1], "dim": rows["dim"][:1], "n": pa.array([len(ids)], pa.int32()), "blob": pa.array([blob], pa.binary())})


class Segment:
    """A segment of the index, unpacked."""

    def __init__(self, blob: bytes) -> None:
        ids, low, shift, bitmaps, values, kind = unpack_arrays(blob, np.int64, np.int64, np.uint64, np.uint64, bytes, bytes)
        self.ids, self.low, self.shift = ids, low.tolist(), shift.astype(np.int64)
        self.values = np.frombuffer(values, kind.decode()).reshape(len(ids), -1)
        self.floats = self.values.astype(np.float64)
        self.widest = int(np.abs(self.floats).max())
        dims = self.values.shape[1]
        plain = bitmaps.reshape(dims, len(bitmaps) // dims // (-(-len(ids) // 64)), -1)
        self.slices, self.words = plain.shape[1], plain.shape[2]
        # Complements lie beside the slices, for negative weights.
        self.bitmaps = np.stack([plain, ~plain]).reshape(-1, self.words)
        self.rows = np.zeros(self.words * 64, np.uint8)
        self.rows[: len(ids)] = 1
        self.every = np.packbits(self.rows, bitorder="little").view(np.uint64)

    def sums(self, query: np.ndarray) -> tuple[list[np.ndarray], int, int, int]:
        """Slices of ``sum |weight| * slice``, least significant first, and the constant and errors: the exact score lies in
        ``[sum + constant - below, sum + constant + above]``."""
        weight = np.abs(query)
        d, bit = np.nonzero((weight[:, None] >> np.arange(63)) & 1)
        place = (bit + self.shift[d])[:, None] + np.arange(self.slices)
        row = (((query[d] < 0) * len(query) + d) * self.slices)[:, None] + np.arange(self.slices)
        order = np.argsort(place.ravel(), kind="stable")
        row, place = row.ravel()[order], place.ravel()[order]
        last = int(place[-1]) if len(place) else -1
        starts = np.searchsorted(place, np.arange(last + 2))
        out, carried = [], []
        p = 0
        while p <= last or carried:
            here = self.bitmaps[row[starts[p] : starts[p + 1]]] if p <= last else self.bitmaps[:0]
            here, carried = _add(np.concatenate([here, *carried]) if carried else here)
            out.append(here)
            p += 1
        constant = below = above = 0
        for q, low, shift in zip(query.tolist(), self.low, self.shift.tolist(), strict=True):
            lost = abs(q) * ((1 << shift) - 1)
            if q < 0:
                constant -= -q * (low + (((1 << self.slices) - 1) << shift))
                below += lost
            else:
                constant += q * low
                above += lost
        return out, constant, below, above

    def exact(self, rows: np.ndarray, query: np.ndarray) -> np.ndarray:
        most = self.widest * int(np.abs(query).max()) * len(query)
        if most < 1 << 52:
            return (self.floats[rows] @ query.astype(np.float64)).astype(np.int64)
        kind = np.int64 if most < 1 << 61 else object
        return (self.values[rows].astype(kind) * query.astype(kind)).sum(axis=1)


def _add(bitmaps: np.ndarray) -> tuple[np.ndarray | None, list[np.ndarray]]:
    """Sum of bitmaps of one binary place: the bitmap that stays there and those carried to the next place."""
    carried = []
    while len(bitmaps) > 2:
        third = len(bitmaps) // 3
        a, b, c = bitmaps[:third], bitmaps[third : 2 * third], bitmaps[2 * third : 3 * third]
        either = a ^ b
        carry = either & c
        carry |= a & b
        carried.append(carry)
        either ^= c
        bitmaps = np.concatenate([either, bitmaps[3 * third :]]) if 3 * third < len(bitmaps) else either
    if len(bitmaps) == 2:
        carried.append(bitmaps[:1] & bitmaps[1:])
        return bitmaps[0] ^ bitmaps[1], carried
    return (bitmaps[0] if len(bitmaps) else None), carried


def kth_value(slices: list[np.ndarray | None], rows: np.ndarray, k: int) -> int:
    """The k-th largest value among ``rows`` (a bitmap of at least k), from the most significant slice down."""
    value = 0
    for place in range(len(slices) - 1, -1, -1):
        if slices[place] is None:
            continue
        ones = rows & slices[place]
        n = int(np.bitwise_count(ones).sum())
        if n >= k:
            rows, value = ones, value | (1 << place)
        else:
            k -= n
            rows = rows & ~slices[place]
    return value


def at_least(slices: list[np.ndarray | None], rows: np.ndarray, bound: int) -> np.ndarray:
    """Bitmap of the ``rows`` whose value is ``bound`` or more."""
    if bound <= 0:
        return rows
    if bound.bit_length() > len(slices):
        return np.zeros_like(rows)
    larger, equal = np.zeros_like(rows), rows
    for place in range(len(slices) - 1, -1, -1):
        slice_ = slices[place]
        if bound >> place & 1:
            equal = equal & slice_ if slice_ is not None else np.zeros_like(rows)
        elif slice_ is not None:
            larger |= equal & slice_
            equal = equal & ~slice_
    return larger | equal


def _search(queries: pa.Table, segments: pa.Table, k: int) -> pa.Table:
    names, others, scores = [], [], []
    if queries.num_rows and segments.num_rows:
        ids, vectors = _matrix(queries)
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(ids)
        for blob in segments["blob"]:
            segment = Segment(blob.as_py())
            for i in range(len(ids)):
                best[i] = _best(segment, int(ids[i]), vectors[i], k, *best[i])
        for own, (found, score) in zip(ids.tolist(), best, strict=True):
            names.extend([own] * len(found))
            others.extend(found.tolist())
            scores.extend(score.tolist())
    high, low = [s >> _HALF for s in scores], [s & ((1 << _HALF) - 1) for s in scores]
    return pa.table({"query_id": pa.array(names, pa.int64()), "vec_id": pa.array(others, pa.int64()), "high": pa.array(high, pa.int64()), "low": pa.array(low, pa.int64())})


def _best(segment: Segment, own: int, query: np.ndarray, k: int, found: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The best k of ``found`` with ``score`` and of the segment's rows."""
    rows = segment.every
    first, last = np.searchsorted(segment.ids, [own, own + 1] if own < _LONG else [own, own], side="left")
    last = len(segment.ids) if own == _LONG else last
    if first < last:
        bits = segment.rows.copy()
        bits[first:last] = 0
        rows = np.packbits(bits, bitorder="little").view(np.uint64)
    slices, constant, below, above = segment.sums(query)
    bounds = []
    if len(found) == k:
        bounds.append(int(score[-1]) - constant - above)
    if len(segment.ids) - (last - first) > k:
        bounds.append(kth_value(slices, rows, k) - below - above)
    near = at_least(slices, rows, max(bounds)) if bounds else rows
    at = np.flatnonzero(np.unpackbits(near.view(np.uint8), bitorder="little"))
    if not len(at):
        return found, score
    ids = np.concatenate([found, segment.ids[at]])
    values = np.concatenate([score, segment.exact(at, query)])
    order = np.lexsort((ids, -values))[:k] if values.dtype != object else np.array(sorted(range(len(ids)), key=lambda i: (-values[i], ids[i]))[:k])
    return ids[order], values[order]

from __future__ import annotations

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from codeweft.llm import bit_sliced


def brute(rows, k, every=3):
    sound = set()
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) and abs(256 * x) < 1 << 55 for x in v):
            sound.add((i, tuple(math.floor(256 * x) for x in v)))
    out = {}
    for q, u in sound:
        if q % every == 0:
            out.setdefault(q, []).extend((-sum(a * b for a, b in zip(u, v)), c) for c, v in sound if c != q and len(u) == len(v))
    limit = (1 << 63) - 1
    return {q: [(c, max(-limit - 1, min(limit, -s))) for s, c in sorted(found)[:k]] for q, found in out.items() if found}


def answers(result):
    got = {}
    for row in result.orderBy("query_id", "rank").collect():
        got.setdefault(row.query_id, []).append((row.vec_id, row.score))
        assert row["rank"] == len(got[row.query_id])
    return got


@pytest.mark.parametrize("seed, slices, numbers, block, batch", [(1, 6, 1 << 20, 1 << 20, 8), (2, 3, 8 * 40, 8 * 20, 2), (3, 1, 8 * 25, 8 * 11, 1), (4, 12, 8 * 70, 1 << 20, 3)])
def test_equals_brute_force(spark, seed, slices, numbers, block, batch):
    r = random.Random(seed)
    pool = [[r.choice([0.0, 1.0, -2.5, r.gauss(0, 1)]) for _ in range(8)] for _ in range(50)]
    rows = [(i, r.choice(pool) if i % 4 else [r.gauss(0, 10 ** r.randint(-3, 2)) for _ in range(8)]) for i in range(180)]
    rows += [(i, pool[0]) for i in range(300, 400)]  # copies: more ties than places
    rows += [(500, None), (501, []), (502, [0.0] * 8), (503, [1.0, None] * 4), (504, [float("nan")] * 8), (505, [float("inf")] * 8), (None, pool[1])]
    rows += [(600, [1.0, 2.0]), (603, [3.0, 1.0]), (606, [1.0] * 9), rows[9], (9, pool[3]), (9, pool[4]), (-3, pool[5]), ((1 << 63) - 1, pool[0])]
    rows += [(1000, [r.gauss(0, 1) for _ in range(8)]) for _ in range(60)]  # one id with many vectors
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for clash in ("dim", "id", "v", "segment", "blob", "rank"):
        vectors = vectors.withColumn(clash, F.create_map(F.lit("a"), F.lit(1)))
    index = bit_sliced.build_index(vectors, slices=slices, numbers=numbers)
    got = answers(bit_sliced.top_k(vectors, F.col("vec_id") % 3 == 0, k=7, index=index, block_numbers=block, batch=batch))
    assert got == brute(rows, 7)


def test_large_components_stay_exact(spark):
    r = random.Random(9)
    rows = [(i, [float(r.randint(-(10**e), 10**e)) for e in (2, 9, 12, 14)]) for i in range(60)] + [(70, [1e300] * 4), (71, [2.0**47] * 4)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert answers(bit_sliced.top_k(vectors, F.col("vec_id") % 3 == 0, k=5)) == brute(rows, 5)


def test_few_rows(spark):
    schema = "vec_id long, embedding array<float>"
    assert bit_sliced.top_k(spark.createDataFrame([], schema), F.col("vec_id") >= 0).count() == 0
    assert bit_sliced.top_k(spark.createDataFrame([(50, [1.0])], schema), F.col("vec_id") % 50 == 0).count() == 0
    got = answers(bit_sliced.top_k(spark.createDataFrame([(50, [1.0]), (3, [-1.0]), (2, [-1.0])], schema), F.col("vec_id") % 50 == 0))
    assert got == {50: [(2, -65536), (3, -65536)]}


def test_bitmap_sums_and_walks():
    r = np.random.default_rng(5)
    for _ in range(30):
        bitmaps = r.integers(0, 1 << 63, (r.integers(1, 40), 3), dtype=np.uint64)
        values = np.unpackbits(bitmaps.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        slices, carried = [], [bitmaps]
        while carried:
            one, carried = bit_sliced._add(np.concatenate(carried))
            slices.append(one)
        total = sum(np.unpackbits(s.view(np.uint8), bitorder="little").astype(np.int64) << p for p, s in enumerate(slices))
        assert total.tolist() == values.tolist()
        mask = r.integers(0, 1 << 63, 3, dtype=np.uint64)
        inside = np.unpackbits(mask.view(np.uint8), bitorder="little").astype(bool)
        for k in (1, 5, int(inside.sum())):
            kth = bit_sliced.kth_value(slices, mask, k)
            assert kth == np.sort(values[inside])[::-1][k - 1]
        for bound in (-1, 0, kth, kth + 1, int(values.max()), int(values.max()) + 1, 1 << 30):
            got = np.unpackbits(bit_sliced.at_least(slices, mask, bound).view(np.uint8), bitorder="little").astype(bool)
            assert got.tolist() == (inside & (values >= bound)).tolist()


def test_few_rows_are_scored_exactly():
    """The slices leave a small part of the rows to the exact step."""
    r = np.random.default_rng(6)
    values = np.floor(256 * r.normal(0, 0.125, (4_000, 64))).astype(np.int64)
    ids = np.arange(4_000)
    table = pa.table({"segment": pa.array([0] * 4_000, pa.int32()), "dim": pa.array([64] * 4_000, pa.int32()), "id": ids, "v": pa.array(values.tolist(), pa.list_(pa.int64()))})
    segment, scored = bit_sliced.Segment(bit_sliced._segment(table, 6)["blob"][0].as_py()), []
    exact = segment.exact
    segment.exact = lambda at, query: (scored.append(len(at)), exact(at, query))[1]
    none = np.zeros(0, np.int64)
    for i in range(50):
        found, score = bit_sliced._best(segment, i, values[i], 5, none, none)
        truth = values @ values[i]
        truth[i] = -(1 << 40)
        want = np.lexsort((ids, -truth))[:5]
        assert found.tolist() == want.tolist() and score.tolist() == truth[want].tolist()
    assert sum(scored) / 50 < 200

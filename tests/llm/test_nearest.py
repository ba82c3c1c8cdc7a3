from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from codeweft.llm import nearest


def brute(rows, k):
    sound = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and abs(x) < float("inf") for x in v) and any(v):
            sound.setdefault(i, []).append(v)
    out = {}
    for q in sound:
        if q % 3:
            continue
        scores = []
        for c in sound:
            if c != q:
                both = [(u, v) for u in sound[q] for v in sound[c] if len(u) == len(v)]
                if both:
                    total = []
                    for u, v in both:
                        s = 0.0
                        for a, b in zip(u, v):
                            s += a * b
                        total.append(s)
                    scores.append((-max(total), c))
        out[q] = [(c, -s) for s, c in sorted(scores)[:k]]
    return {q: v for q, v in out.items() if v}


@pytest.mark.parametrize("seed, tile, shard", [(1, (512, 4096), 65536), (2, (7, 11), 40), (3, (3, 2), 25)])
def test_equals_brute_force(spark, monkeypatch, seed, tile, shard):
    monkeypatch.setattr(nearest, "TILE", tile)
    monkeypatch.setattr(nearest, "SHARD_NUMBERS", 8 * shard)
    monkeypatch.setattr(nearest, "BLOCK_NUMBERS", 8 * 30)
    r = random.Random(seed)
    pool = [[r.choice([0.0, 1.0, -2.5, r.gauss(0, 1)]) for _ in range(8)] for _ in range(50)]
    rows = [(i, r.choice(pool) if i % 4 else [r.gauss(0, 10 ** r.randint(-3, 3)) for _ in range(8)]) for i in range(180)]
    rows += [(i, pool[0]) for i in range(300, 400)]  # a group of equal vectors larger than k
    rows += [(500, None), (501, []), (502, [0.0] * 8), (503, [1.0, None] * 4), (504, [float("nan")] * 8), (505, [float("inf")] * 8), (None, pool[1]), (600, [1.0, 2.0]), (603, [3.0, 1.0]), rows[9], (9, pool[3])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("dim", F.lit("d")).withColumn("id", F.lit(1))
    got = {}
    for row in nearest.nearest(vectors, F.col("vec_id") % 3 == 0, k=7).orderBy("query_id", "rank").collect():
        got.setdefault(row.query_id, []).append((row.vec_id, row.score))
        assert row["rank"] == len(got[row.query_id])
    assert got == brute(rows, 7)


@pytest.mark.parametrize("tile, shard", [((512, 4096), 65536), ((7, 11), 65536), ((5, 9), 60)])
def test_an_id_with_many_near_vectors_takes_one_place(spark, monkeypatch, tile, shard):
    monkeypatch.setattr(nearest, "TILE", tile)
    monkeypatch.setattr(nearest, "SHARD_NUMBERS", 6 * shard)
    r = random.Random(4)
    rows = [(i, [1.0 + r.gauss(0, 0.3) for _ in range(6)]) for i in range(90)]
    rows += [(1000, [3.0 + r.gauss(0, 0.1) for _ in range(6)]) for _ in range(60)]  # near every query, a third of all rows
    rows += [(1001, [2.9 + r.gauss(0, 0.1) for _ in range(6)]) for _ in range(30)] + [(3, [2.0 + r.gauss(0, 0.1) for _ in range(6)]) for _ in range(12)]
    rows += rows[:5] + rows[90:95] + [(1002, rows[90][1]), (7, rows[90][1])] + [rows[91]] * 30
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for row in nearest.nearest(vectors, F.col("vec_id") % 3 == 0, k=7).orderBy("query_id", "rank").collect():
        got.setdefault(row.query_id, []).append((row.vec_id, row.score))
    assert got == brute(rows, 7) and all(len(v) == 7 for v in got.values())


def test_rows_of_one_id_are_spread_over_shards(spark, monkeypatch):
    monkeypatch.setattr(nearest, "SHARD_NUMBERS", 4 * 50)
    sizes = spark.sparkContext.accumulator(0)
    join, r = nearest._join, random.Random(5)

    def seen(q, c, k):
        if c.num_rows > 150:
            sizes.add(1)
        return join(q, c, k)

    monkeypatch.setattr(nearest, "_join", seen)
    rows = [(1, [r.gauss(0, 1) for _ in range(4)]) for _ in range(300)] + [(1, [1.0, 2.0, 3.0, 4.0])] * 300 + [(i, [r.gauss(0, 1) for _ in range(4)]) for i in range(2, 20)]
    nearest.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 2, k=5).collect()
    assert sizes.value == 0


def test_empty_table(spark):
    assert nearest.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") >= 0).count() == 0


def test_groups_are_bounded_by_numbers(spark, monkeypatch):
    monkeypatch.setattr(nearest, "SHARD_NUMBERS", 4_000)
    monkeypatch.setattr(nearest, "BLOCK_NUMBERS", 1_000)
    large = spark.sparkContext.accumulator(0)
    join, r = nearest._join, random.Random(6)

    def seen(q, c, k):
        # Hashing deals rows unevenly, but not by a factor of two.
        if c.num_rows * 40 > 8_000 or q.num_rows * 40 > 2_000:
            large.add(1)
        return join(q, c, k)

    monkeypatch.setattr(nearest, "_join", seen)
    rows = [(i, [r.gauss(0, 1) for _ in range(40)]) for i in range(600)]
    nearest.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 5 == 0, k=3).collect()
    assert large.value == 0

from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from codeweft.llm import bag_search

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(UPPER))


def brute(docs, items, k):
    bags = [(i, Counter(terms_of(t))) for i, t in docs]
    n_docs, n_terms = sum(bool(b) for _, b in bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    asked = {}
    for i, text in items:
        if i is not None:
            asked.setdefault(i, Counter()).update(terms_of(text))
    out = {}
    for i, wanted in asked.items():
        scored = []
        for doc, bag in bags:
            m = 25 + 75 * sum(bag.values()) * n_docs // n_terms if n_terms else 25
            score = 0
            for t, times in wanted.items():
                if bag[t]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += times * w * (1_000_000_000 * bag[t] // (1000 * bag[t] + 8 * m))
            if doc is not None and score > 0:
                scored.append((-score, doc))
        out[i] = [(d, -s) for s, d in sorted(scored)[:k]]
    return {i: found for i, found in out.items() if found}


def answers(result):
    got = {}
    for row in result.orderBy("item_id", "rank").collect():
        got.setdefault(row.item_id, []).append((row.doc_id, row.score))
        assert row["rank"] == len(got[row.item_id])
    return got


def tables(seed=1):
    r = random.Random(seed)
    vocabulary = ["the", "of", "Été", "naïve", "日本", "x1", "42", "A", "b-c", "ümlaut"] + [f"w{i}" for i in range(60)]
    text = lambda n: " ".join(r.choices(vocabulary, [20] * 10 + [1] * 60, k=n))
    docs = [(i, text(r.randint(1, 40))) for i in range(150)]
    same = text(25)
    docs += [(i, same) for i in range(1000, 1080)]  # copies, far more than places
    docs += [(i, " ".join(r.sample(same.split(), 25))) for i in range(500, 530)]  # other orders of the same words: one class
    docs += [(700, None), (701, ""), (702, "\x00 \t--"), (703, text(30_000)), (None, same), (5, text(9)), docs[7], (704, "THE the tHe"), (705, "unknown words only"), (-4, same)]
    items = [(i, text(r.randint(1, 15))) for i in range(25)] + [(30, same + " " + same), (31, None), (32, "!!"), (None, "the"), (33, "nowhere"), (3, "the w1"), (34, "w2 W2 w2")]
    return docs, items


@pytest.mark.parametrize("limit, block, shard", [(1 << 26, 500_000, 4_000_000), (1 << 26, 40, 300), (0, 500_000, 1_000)])
def test_equals_brute_force(spark, limit, block, shard):
    docs, items = tables()
    left, right = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for clash in ("n", "m", "h", "terms", "tfs", "members", "code", "w", "term", "item", "score"):
        left, right = left.withColumn(clash, F.create_map(F.lit("a"), F.lit(1))), right.withColumn(clash, F.lit("the"))
    got = answers(bag_search.search(left, right, k=7, limit=limit, block_entries=block, shard_entries=shard))
    assert got == brute(docs, items, 7)


def test_tiles_of_any_width_give_the_same(monkeypatch):
    import pyarrow as pa

    r = random.Random(3)
    items = pa.table({"item": [r.randrange(9) for _ in range(60)], "code": [r.randrange(30) for _ in range(60)], "weight": [r.randrange(4) for _ in range(60)]})
    items = items.group_by(["item", "code"]).aggregate([("weight", "sum")]).rename_columns(["item", "code", "weight"])
    rows = [(r.randrange(20, 40), sorted(r.sample(range(35), 6)), [r.randrange(1, 4) for _ in range(6)], [i]) for i in r.sample(range(500), 120)]
    classes = pa.table({n: list(c) for n, c in zip(("m", "terms", "tfs", "members"), zip(*rows))})
    results = []
    for cells in (1, 40, 1 << 20):
        monkeypatch.setattr(bag_search, "TILE_CELLS", cells)
        found = bag_search._best_classes(items, classes, 4)
        results.append(sorted((x["item"], -x["score"], x["members"]) for x in found.to_pylist()))
    assert results[0] == results[1] == results[2] and len(results[0]) > 20


def test_equal_bags_are_one_class_and_equal_hashes_are_not_enough(spark):
    bags = spark.createDataFrame([(i, 30, [1, 2], [1, 1]) for i in range(50)] + [(60, 31, [1, 2], [1, 1]), (61, 30, [1, 2], [1, 2])], "id long, m long, terms array<long>, tfs array<long>")
    found = {(r.m, tuple(r.tfs)): r.members for r in bag_search.classes_of(bags, 10).collect()}
    assert found == {(30, (1, 1)): list(range(10)), (31, (1, 1)): [60], (30, (1, 2)): [61]}


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "the")], "item_id long, text string")
    assert bag_search.search(docs, items).count() == 0
    assert bag_search.search(spark.createDataFrame([(1, "the")], docs.schema), items.limit(0)).count() == 0
    assert bag_search.search(spark.createDataFrame([(1, None), (2, " ")], docs.schema), items).count() == 0

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from codeweft.llm import jaccard_join
from codeweft.llm.components import components


def shingles(text, width):
    words = [w.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for w in text.replace("\n", " ").split(" ") if w]
    if not words:
        return set()
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))}


def brute(rows, width, percent):
    sets = {i: shingles(t or "", width) for i, t in rows}
    ids, root = sorted(sets), {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x, i in enumerate(ids):
        for j in ids[:x]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in ids}


def documents(seed, families, size):
    r = random.Random(seed)
    rows, passage = [], [f"line{i}" for i in range(12)]
    for f in range(families):
        base = [f"{r.choice('abcdefgh')}{r.randint(0, 30 + 10 * f)}" for _ in range(r.randint(3, 90))]
        for _ in range(r.randint(1, size)):
            words = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 3])):
                words[r.randrange(len(words))] = f"n{r.randint(0, 5)}"
            if r.random() < 0.3:
                words += passage
            text = " ".join(words)
            rows.append((len(rows) * 3 + 1, text.upper() if r.random() < 0.2 else text))
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed, width, percent, block", [(1, 4, 85, 1_000_000), (2, 2, 60, 300), (3, 1, 85, 200)])
def test_equals_brute_force(spark, monkeypatch, seed, width, percent, block):
    monkeypatch.setattr(jaccard_join, "BLOCK_MEMBERS", block)
    rows = documents(seed, 25, 9) + [(900, ""), (901, None), (902, "one"), (903, "ONE"), (904, "one two"), (905, " \n ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("root", F.lit("r")).repartition(4)
    got = jaccard_join.link_components(docs, width=width, percent=percent).withColumn("c", jaccard_join.component_id()).collect()
    assert {r.id: (r.n_shingles, r.c) for r in got} == brute(rows, width, percent)
    assert len(got) == len(rows)


def test_nulls_repeats_and_empty_table(spark):
    text = "a b c d e f g h"
    rows = [(None, text), (4, text), (4, text), (4, "other words stand here now"), (None, None)]
    got = jaccard_join.link_components(spark.createDataFrame(rows, "doc_id long, text string")).withColumn("c", jaccard_join.component_id()).collect()
    assert sorted((r.id is None, r.n_shingles, r.c or -1) for r in got) == [(False, 2, 4), (False, 5, 4), (False, 5, 4), (True, 0, -1), (True, 5, 4)]
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard_join.link_components(empty).count() == 0
    assert jaccard_join.keep_one(empty).count() == 0


def test_keep_one_keeps_the_smallest_and_all_columns(spark):
    rows = [(3, "a b c d e f", "x"), (2, "A b c d e f", "y"), (2, "A b c d e f", "y"), (9, "", "z"), (8, None, None)]
    kept = jaccard_join.keep_one(spark.createDataFrame(rows, "doc_id long, text string, k string"))
    assert kept.columns == ["doc_id", "text", "k"]
    assert sorted(tuple(r) for r in kept.collect())[0] == (2, "A b c d e f", "y")
    assert {r.doc_id for r in kept.collect()} == {2, 8, 9}


def test_tree_finds_every_component_link():
    r = np.random.default_rng(5)
    sets = [np.unique(r.integers(0, 40, r.integers(1, 30)).astype(np.uint64)) for _ in range(120)]
    tree = jaccard_join.PrefixTree(70, list(range(len(sets))))
    plain = list(range(len(sets)))

    def find(i):
        while plain[i] != i:
            i = plain[i]
        return i

    for i, x in enumerate(sets):
        tree.join(i, x, len(x))
        tree.add(i, x, len(x))
        for j in range(i):
            both = len(np.intersect1d(x, sets[j]))
            if 100 * both >= 70 * (len(x) + len(sets[j]) - both):
                plain[find(i)] = find(j)
    groups = {}
    for i in range(len(sets)):
        groups.setdefault(find(i), set()).add(tree.find(i))
    assert all(len(v) == 1 for v in groups.values())
    assert len({tree.find(i) for i in range(len(sets))}) == len(groups)


def test_components_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(30)] + [(100, i) for i in range(101, 140)] + [(120, 200), (7, 7)]
    got = components(spark.createDataFrame(links, "a long, b long"))
    assert {r.node: r.root for r in got.collect()} == {**{i: 0 for i in range(31)}, **{i: 100 for i in [*range(100, 140), 200]}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_keep_one_of_rows_with_maps(spark):
    rows = [(1, "one two three four five", {"a": 2}), (1, "one two three four five", {"a": 1}), (2, "one two three four five", {"a": 0}), (3, None, None)]
    kept = jaccard_join.keep_one(spark.createDataFrame(rows, "doc_id long, text string, more map<string,int>"))
    assert sorted((r.doc_id, r.more) for r in kept.collect()) == [(1, {"a": 1}), (3, None)]

from __future__ import annotations

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from codeweft.llm import substring_dedup


def brute(rows, width):
    """rows: (id, text); ids are distinct or rows equal."""
    docs = sorted({(LAST if i is None else i, i, t or "") for i, t in rows}, key=lambda r: (r[0], r[2]))
    seen, out = {}, {}
    for _, i, text in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        gone = set()
        for s in range(len(words) - width + 1):
            window = tuple(words[s : s + width])
            if seen.setdefault(window, (i, s)) != (i, s):
                gone |= set(range(s, s + width))
        kept = " ".join(w for p, w in enumerate(words) if p not in gone)
        out[i] = (len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


LAST = 1 << 63


def texts(seed, n, vocabulary=40, size=60):
    r = random.Random(seed)
    words = [f"w{i}é" if i % 3 else f"W{i}" for i in range(vocabulary)]
    passages = [[r.choice(words) for _ in range(r.randint(8, 30))] for _ in range(6)]
    rows = []
    for i in range(n):
        parts = []
        while len(parts) < r.randint(0, size):
            parts += r.choice(passages) if r.random() < 0.4 else [r.choice(words)]
        rows.append((i, r.choice([" ", "\n", " \t "]).join(parts)))
    return rows


@pytest.mark.parametrize("width, seed", [(20, 4), (5, 2), (3, 3)])
def test_equals_brute_force(spark, monkeypatch, width, seed):
    monkeypatch.setattr(substring_dedup, "BUCKET_WORDS", 1000)
    rows = texts(width, 150) + [(1000, None), (1001, ""), (1002, "a " * 90), (1003, "b c \x1c d"), (None, "w1é " * 25)]
    rows += [rows[7], rows[7]]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("k", F.lit(1)).withColumn("spans", F.lit("x")).repartition(5)
    got = substring_dedup.with_digest(substring_dedup.remove_repeated_windows(docs, width=width, seed=seed)).collect()
    want = brute(rows, width)
    assert len(got) == len(rows)
    assert {r.id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == want
    assert sum(v[1] for v in want.values()) > 100


def test_hash_collisions_and_hot_seeds_change_nothing(spark, monkeypatch):
    rows = texts(1, 80, vocabulary=12)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute(rows, 6)
    monkeypatch.setattr(substring_dedup, "BUCKET_WORDS", 256)  # every repeated seed run is hot
    got = substring_dedup.with_digest(substring_dedup.remove_repeated_windows(docs, width=6, seed=2)).collect()
    assert {r.id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == want


def test_same_id_with_two_texts_and_empty_table(spark):
    passage = " ".join(f"p{i}" for i in range(25))
    rows = [(1, passage + " x"), (1, passage + " y")]
    got = substring_dedup.remove_repeated_windows(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.n_removed for r in got) == [0, 25]
    assert substring_dedup.remove_repeated_windows(spark.createDataFrame([], "doc_id long, text string")).count() == 0

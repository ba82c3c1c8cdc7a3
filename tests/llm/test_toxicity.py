from __future__ import annotations

import itertools
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from codeweft.llm import toxicity


def test_marginals_equal_enumeration():
    r = np.random.default_rng(1)
    counts, moves = np.array([4, 0, 1, 6]), [0.7, -0.4, 1.1]
    emission = r.normal(size=11)
    p = toxicity._marginals(emission, counts, moves)[0]
    at = 0
    weight = {(0, 0): 0.0, (0, 1): moves[0], (1, 0): moves[1], (1, 1): moves[2]}
    for n in counts:
        total, mass = 0.0, np.zeros(n)
        for labels in itertools.product((0, 1), repeat=int(n)):
            w = np.exp(sum(emission[at + i] * y for i, y in enumerate(labels)) + sum(weight[x] for x in itertools.pairwise(labels)))
            total += w
            mass += w * np.array(labels)
        if n:
            assert np.allclose(p[at : at + n], mass / total)
        at += n


def corpus(n):
    r = random.Random(3)
    plain, bad = [f"word{i}" for i in range(300)], ["vile", "nasty", "horrid"]
    docs, labels = [], []
    for i in range(n):
        words = [r.choice(plain) for _ in range(r.randint(5, 80))]
        toxic = r.random() < 0.25
        if toxic:
            for _ in range(r.randint(1, 4)):
                words[r.randrange(len(words))] = r.choice(bad) + r.choice(["", ",", "!"])
        docs.append((i, " ".join(words), "x"))
        labels.append((i, int(toxic if r.random() > 0.02 else not toxic)))
    return docs, labels


def test_held_out_accuracy_spans_and_edge_cases(spark):
    docs, labels = corpus(600)
    table = spark.createDataFrame([*docs, (None, "vile", "n"), (9000, None, None), (9001, "", "e"), docs[0]], "doc_id long, text string, score string").withColumn("row", F.lit(1))
    marks = spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id long, toxic int").withColumn("text", F.lit("t"))
    model = toxicity.fit(table, marks)
    got = toxicity.score(table, model).collect()
    assert len(got) == len(docs) + 4 and got[0].row == 1
    by_id, truth = {r.doc_id: r for r in got}, dict(labels)
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    right = sum((by_id[i].toxic_score >= 0.5) == bool(truth[i]) for i in held) / len(held)
    assert right > 0.94
    assert by_id[None].toxic_score > 0.5 and by_id[9000].toxic_score == by_id[9001].toxic_score < 0.5
    text = {i: t for i, t, _ in docs}
    for i in held:
        for span in by_id[i].toxic_spans:
            assert any(b in text[i][span.start : span.stop] for b in ("vile", "nasty", "horrid"))
    assert set(by_id[None].toxic_spans[0].asDict()) == {"start", "stop", "p"}


def test_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit(docs, none)
    assert {r.toxic_score for r in toxicity.score(docs, model).collect()} == {0.5}
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_one_id_with_many_texts_is_one_row_of_a_bounded_sample(spark, monkeypatch):
    """A third of all rows share a labelled id; the sample holds one of its texts, both labels and no more than its bounds."""
    monkeypatch.setattr(toxicity, "SAMPLE_ROWS", 60)
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", 20_000)
    monkeypatch.setattr(toxicity, "TEXT_BYTES", 2_000)
    docs, labels = corpus(600)
    hot = next(i for i, y in labels if y and zlib.crc32(str(i).encode()) % 5)
    long = [(i, "word1 " * 1_000) for i in range(700, 720)]
    table = spark.createDataFrame([(i, t) for i, t, _ in docs] + [(hot, f"vile text {n}") for n in range(300)] + long, "doc_id long, text string")
    marks = spark.createDataFrame(labels + [(i, i % 2) for i, _ in long], "doc_id long, toxic int")
    seen = {}

    def keep(t):
        # Runs in a Python worker, so what it saw goes back in the model.
        k, y = t.column("k").to_pylist(), t.column("y").to_pylist()
        return {**toxicity._plain(0, 0), "words": {"rows": len(k), "ids": len(set(k)), "toxic": sum(y), "bytes": sum(len(x.as_py()) for x in t.column("text"))}}

    monkeypatch.setattr(toxicity, "_fit", keep)
    model = toxicity.fit(table, marks)
    seen = model["words"]
    assert seen["rows"] == seen["ids"] <= 60 and 20 <= seen["toxic"] <= 30 and seen["bytes"] <= 20_000
    truth = dict(labels) | {i: i % 2 for i, _ in long}
    chosen = [y for i, y in truth.items() if zlib.crc32(str(i).encode()) % 5]
    shift = np.log(min(1, 30 / chosen.count(0)) / min(1, 30 / chosen.count(1)))
    assert abs(model["doc"][0] - shift) < 1e-9


def test_scores_are_near_the_true_share_when_a_label_is_sampled_less(spark, monkeypatch):
    docs, labels = corpus(900)
    monkeypatch.setattr(toxicity, "SAMPLE_ROWS", 300)
    table, marks = spark.createDataFrame([(i, t) for i, t, _ in docs], "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r.doc_id: r.toxic_score for r in toxicity.score(table, toxicity.fit(table, marks)).collect()}
    held = [i for i in got if zlib.crc32(str(i).encode()) % 5 == 0]
    assert abs(np.mean([got[i] for i in held]) - np.mean([dict(labels)[i] for i in held])) < 0.06
    assert sum((got[i] >= 0.5) == bool(dict(labels)[i]) for i in held) / len(held) > 0.92


def test_columns_named_like_the_result_are_replaced(spark):
    docs = spark.createDataFrame([(1, "a b", "x", 7)], "doc_id long, text string, toxic_score string, Toxic_Spans int")
    got = toxicity.score(docs, toxicity._plain(0, 0))
    assert got.columns == ["doc_id", "text", "toxic_score", "toxic_spans"] and got.select("toxic_score").first()[0] == 0.5

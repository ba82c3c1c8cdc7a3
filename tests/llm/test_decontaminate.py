from __future__ import annotations

import random
import unicodedata
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from codeweft.llm import decontaminate, queries


def distance_in(text, item):
    """Fewest edits of ``item`` against any substring of ``text``."""
    row = np.zeros(len(text) + 1, np.int64)
    ar = np.arange(len(text) + 1)
    for i, c in enumerate(item, 1):
        new = np.empty_like(row)
        new[0] = i
        new[1:] = np.minimum(row[:-1] + (text != c), row[1:] + 1)
        row = np.minimum.accumulate(new - ar) + ar
    return int(row.min())


def damage(r, text, edits):
    chars = list(text)
    for _ in range(edits):
        at = r.randrange(len(chars))
        kind = r.random()
        if kind < 0.4:
            chars[at] = r.choice("abcdefgh")
        elif kind < 0.7:
            del chars[at]
        else:
            chars.insert(at, r.choice("abcdefgh"))
    return "".join(chars)


@pytest.mark.parametrize("seed, part", [(1, 1 << 20), (2, 1 << 20), (3, 150)])
def test_equals_brute_force(spark, monkeypatch, seed, part):
    monkeypatch.setattr(decontaminate, "PART_CHARS", part)
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 500)
    monkeypatch.setattr(decontaminate, "HITS", 50)
    r = random.Random(seed)
    words = ["the", "eror", "Thing", "ñandú", "of", "onre", "x", "anthwh", "sha"]
    line = lambda n: " ".join(r.choice(words) for _ in range(n))
    items = [(i, damage(r, line(r.choice([9, 20, 45])), 12)) for i in range(14)] + [(90, "abcd"), (91, ""), (92, None), (93, "?!"), (None, line(12))]
    rows = []
    for i in range(80):
        body = line(r.choice([0, 3, 30, 120]))
        if i % 2:
            item = r.choice(items[:14])[1]
            body += ("\n" if i % 4 == 1 else " ") + damage(r, item, r.randint(0, len(item) // 7)).upper() + ", " + line(5)
        rows.append((i, body))
    rows += [(500, "so abcd, it"), (501, "abcde"), (502, None), (503, ""), (None, items[0][1]), rows[1]]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("item", F.lit("c"))
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("id", F.lit("c"))
    got = decontaminate.find_leaks(docs, bench).collect()
    want = set()
    for i, text in rows:
        line_of = decontaminate.plain(text or "")[0]
        for item, item_text in items:
            codes = decontaminate.plain(item_text or "")[0]
            if len(codes) > 7:
                edits = min(int(len(codes) * 0.1), (len(codes) - 7) // 7)
                if distance_in(line_of, codes) <= edits:
                    want.add((i, item))
            elif len(codes) and " abcd " in " " + "".join(map(chr, line_of)) + " ":
                want.add((i, item))
    assert {(x.id, x.item) for x in got} == want and len(want) > 15
    texts = dict(rows)
    for x in got:
        codes = decontaminate.plain(dict(items)[x.item])[0]
        # A region may begin or end with a space, which a text of its own does not show.
        assert distance_in(decontaminate.plain(texts[x.id][x.start : x.stop])[0], codes) <= x.edits + 2
    kept = decontaminate.without_leaks(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(str(x.doc_id) for x in kept.collect()) == sorted(str(i) for i, t in rows if not any(w[0] == i for w in want))


def test_query_and_pipeline_find_copies_with_more_than_a_tenth_edited(spark, tmp_path):
    r = random.Random(8)
    line = lambda n: " ".join("".join(r.choice("etaonrish") for _ in range(r.randint(2, 9))) for _ in range(n))
    items = [(i, line(40)) for i in range(6)]
    rows, want = [(100, line(300))], set()
    for i, text in items:
        size = len(decontaminate.plain(text)[0])
        # Substitutions at even distances, so that the distance is their number.
        for n, edits in enumerate((size * 11 // 100, size * 12 // 100, size * 14 // 100)):
            chars = list(text)
            for k in range(edits):
                chars[k * size // edits] = "x"
            rows.append((3 * i + n, line(30) + " " + "".join(chars) + " " + line(30)))
            if n < 2:
                want.add((3 * i + n, i))
    spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'en' lang", "'s' source", "length(text) n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = queries.op2_decontamination(spark, str(tmp_path)).collect()
    assert {(x.doc_id, x.item_id) for x in got} == want
    kept = corpus_pipeline.decontamination(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path))
    assert {x.doc_id for x in kept.collect()} == {i for i, _ in rows} - {i for i, _ in want}


@pytest.mark.parametrize("hits", [20, 1 << 20])
def test_wide_setting_equals_brute_force(monkeypatch, hits):
    monkeypatch.setattr(decontaminate, "HITS", hits)
    r = random.Random(hits)
    words = ["the", "eror", "thing", "of", "onre", "anthwh", "sha", "ing"]
    line = lambda n: " ".join(r.choice(words) for _ in range(n))
    items = [(i, line(r.choice([8, 20, 60]))) for i in range(12)]
    texts = [line(r.choice([0, 5, 60])) + " " + damage(r, item, r.randint(0, len(item) // 6)) + " " + line(9) for _, item in items for _ in range(4)]
    known = decontaminate._Items(items, **decontaminate.WIDE)
    got = {(m[0], known.ids[m[1]]) for m in decontaminate._matches([t.encode() for t in texts], known)}
    want = {(i, j) for i, t in enumerate(texts) for j, item in items if distance_in(decontaminate.plain(t)[0], decontaminate.plain(item)[0]) <= int(len(item) * 0.12)}
    assert got == want and len(want) > 15


@pytest.mark.parametrize("q, budget", [(7, 0.1), (7, 0.2), (6, 0.12), (7, 0.3)])
def test_the_whole_budget_holds_for_every_item(q, budget):
    r = random.Random(3)
    line = lambda n: " ".join("".join(r.choice("etaonrish") for _ in range(r.randint(2, 5))) for _ in range(n))
    items = [(100 + i, line(r.choice([3, 4, 5, 12]))) for i in range(40)]
    items = [(i, t) for i, t in items if len(t) > q]
    texts = [line(5) + " " + damage(r, t, r.randint(0, int(len(t) * budget) + 1)) + " " + line(5) for _, t in items for _ in range(5)]
    known = decontaminate._Items(items, q, budget)
    got = {(m[0], known.ids[m[1]]) for m in decontaminate._matches([t.encode() for t in texts], known)}
    near = lambda t, item: distance_in(decontaminate.plain(t)[0], decontaminate.plain(item)[0]) <= int(len(item) * budget)
    assert got == {(i, j) for i, t in enumerate(texts) for j, item in items if near(t, item)} and len(got) > 60
    with pytest.raises(ValueError):
        decontaminate._Items(items, q, 1.0)


def test_few_hits_are_counted_and_few_bands_aligned(monkeypatch):
    r = random.Random(5)
    words = ["".join(r.choice("etaonrish") for _ in range(r.randint(2, 7))) for _ in range(200)]
    line = lambda n: " ".join(words[int(200 * r.random() ** 2)] for _ in range(n))
    items = [(i, line(40)) for i in range(15)]
    texts = [line(60) + " " + f"{line(1)} " * 80 + damage(r, item, len(item) // 10) + " " + line(60) for _, item in items for _ in range(2)]
    work, tally, align = {"hits": 0, "bands": 0}, decontaminate._tally, decontaminate._align

    def tallied(item, *more):
        work["hits"] += len(item)
        return tally(item, *more)

    def aligned(line, codes, edits, item, begin, width):
        work["bands"] += len(begin)
        return align(line, codes, edits, item, begin, width)

    monkeypatch.setattr(decontaminate, "_tally", tallied)
    monkeypatch.setattr(decontaminate, "_align", aligned)
    known = decontaminate._Items(items, **decontaminate.WIDE)
    got = {(m[0], known.ids[m[1]]) for m in decontaminate._matches([t.encode() for t in texts], known)}
    near = lambda t, item: distance_in(decontaminate.plain(t)[0], decontaminate.plain(item)[0]) <= int(len(item) * 0.12)
    assert got == {(i, j) for i, t in enumerate(texts) for j, item in items if near(t, item)} and len(got) >= len(texts)
    grams = lambda t: Counter(t[i : i + 6] for i in range(len(t) - 5))
    shared = sum(n * of[g] for t in texts for of in [grams(t)] for _, item in items for g, n in grams(item).items())
    assert work["hits"] < shared / 4 and work["bands"] < 4 * len(got)


def test_decomposed_copies_are_found_where_they_stand(spark):
    text = "mañana él dirá qué pasó aquí según dónde está más allá de así también"
    forms = {i: unicodedata.normalize(f, text) for i, f in enumerate(("NFC", "NFD"))}
    hindi = "\u0958\u0932\u092e \u0959\u0930 \u0958\u0926\u092e \u095b\u092e\u0940\u0928 \u095e\u0938\u0932"
    rows = [(0, "ñ: " + forms[0] + ", fin."), (1, "n\u0303: " + forms[1] + ", fin."), (2, "so " + hindi + " so"), (3, "fin")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(10, forms[0]), (11, forms[1]), (12, hindi)], "item_id long, text string")
    got = decontaminate.find_leaks(docs, items).collect()
    assert {(x.id, x.item, x.edits) for x in got} == {(i, j, 0) for i in (0, 1) for j in (10, 11)} | {(2, 12, 0)}
    for x in got:
        assert dict(rows)[x.id][x.start : x.stop].strip() == (hindi if x.id == 2 else forms[x.id])
    assert [x.doc_id for x in decontaminate.without_leaks(docs, items).collect()] == [3]


def test_offsets_of_composed_texts():
    r = random.Random(9)
    some = "ab \u0301\u0323\u0344\u0958\u09c7\u09be\u1100\u1161\u11a8\uac00\u212b\u1e9b\u0f73\U0001d15e\U00011131\U00011127é"
    for _ in range(3000):
        text = "".join(r.choice(some) for _ in range(r.randint(0, 9)))
        codes, begin, end = decontaminate._placed(text)
        assert codes.tolist() == decontaminate.plain(unicodedata.normalize("NFC", text))[0].tolist()
        assert (begin < end).all() and (np.diff(begin) >= 0).all() and (end <= len(text)).all()


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "some text that stands here")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find_leaks(docs, none).count() == 0
    assert decontaminate.without_leaks(docs, none).count() == 1
    assert decontaminate.find_leaks(docs.limit(0), spark.createDataFrame([(1, "some text that")], "item_id long, text string")).count() == 0

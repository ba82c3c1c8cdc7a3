from __future__ import annotations

import random

import corpus_pipeline
import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from codeweft.llm import decontaminate
from tests.llm.test_decontaminate import distance_in
from tests.llm.test_jaccard_join import brute as components
from tests.llm.test_substring_dedup import brute as windows


def tables(spark, folder):
    r = random.Random(6)
    words = [f"{a}{b}" for a in ("th", "er", "on", "ing", "ed") for b in ("an", "st", "ly", "re", "ou", "wh")]
    text = lambda n: " ".join(r.choice(words) + str(r.randint(0, 40)) for _ in range(n))
    passage, items = text(60), [(i, text(25)) for i in range(3)]
    docs, labels = [], []
    for i in range(160):
        body = text(r.randint(10, 90)).split()
        if i % 5 == 0:
            body[3:3] = ["vile", "nasty"]
        if i % 11 == 1:
            body += passage.split()
        if i % 13 == 2:
            body += items[i % 3][1].split()
        docs.append((i, " ".join(body), "en", "s", len(" ".join(body))))
        labels.append((i, 0, int(i % 5 == 0)))
    for i in range(160, 180):  # near and exact copies
        body = docs[i - 150][1].split()
        body[-1] = "odd" if i % 2 else body[-1]
        docs.append((i, " ".join(body), "en", "t", len(" ".join(body))))
    docs += [(900, None, None, None, None), (901, "", "en", "s", 0), docs[7]]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars int").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return items


def test_every_stage_equals_brute_force_on_its_input(spark, tmp_path):
    items = tables(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before = [tuple(r) for r in docs.collect()]
        result = stage(spark, docs, str(tmp_path))
        docs = spark.createDataFrame(result.collect(), result.schema)
        after = [tuple(r) for r in docs.collect()]
        if name != "packing":
            assert docs.columns == corpus_pipeline.COLUMNS
        if name == "toxicity":
            assert sorted(map(repr, after)) == sorted(repr(r) for r in before if "vile" not in (r[1] or ""))
        if name == "near_duplicates":
            roots = components([(r[0], r[1]) for r in before], 5, 80)
            assert sorted(map(repr, after)) == sorted({repr(r) for r in before if roots[r[0]][1] == r[0]})
            assert len(after) < len(before)
        if name == "repeated_passages":
            want = windows([(r[0], r[1]) for r in before], 20)
            got = {r[0]: r[1] for r in after}
            for r in before:
                n, gone, _ = want[r[0]]
                assert (r[0] in got) == (gone < n or not gone)
                if r[0] in got:
                    assert len((got[r[0]] or "").split()) == n - gone
            assert any(v[1] for v in want.values())
        if name == "decontamination":
            plain = {i: decontaminate.plain(t)[0] for i, t in items}
            clean = [r for r in before if all(distance_in(decontaminate.plain(r[1] or "")[0], c) > len(c) // 10 for c in plain.values())]
            assert sorted(map(repr, after)) == sorted(map(repr, clean)) and len(clean) < len(before)
        if name == "packing":
            own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
            total = {r[0]: len(own.encode(r[1] or "", add_special_tokens=False).ids) + 1 for r in before}
            sums = {}
            for r in docs.collect():
                sums[r.doc_id] = sums.get(r.doc_id, 0) + r.length
            assert sums == total


def test_run_gives_the_last_stage(spark, tmp_path):
    tables(spark, str(tmp_path))
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and got.count() > 50
    assert np.all([r.length > 0 for r in got.collect()])

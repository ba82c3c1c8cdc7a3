"""One text of about a megabyte, longer than what operators hold at once, among short ones; results of the others must not change."""

from __future__ import annotations

import public_tokenizers
import pytest

from codeweft.llm import decontaminate, jaccard_join, lattice_lm, license_scan, packing, substring_dedup, toxicity

ITEM = "a certain passage that a benchmark holds and no other text should ever carry along"
LONG = " ".join(f"w{i % 977}x{i % 991}" for i in range(60_000)) + " " + ITEM + " Released under the MIT License. " + " ".join(f"z{i}" for i in range(30_000))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(1, LONG, "en"), (2, "short text", "en"), (3, LONG, "de"), (4, None, None)], "doc_id long, text string, lang string")


def test_substring_dedup(docs):
    got = {r.id: (r.n_words, r.n_removed) for r in substring_dedup.remove_repeated_windows(docs).collect()}
    n = len(LONG.split())
    assert got == {1: (n, 0), 2: (2, 0), 3: (n, n), 4: (0, 0)}


def test_jaccard_join(docs):
    got = {r.id: r.root.k for r in jaccard_join.link_components(docs).collect()}
    assert got == {1: 1, 2: 2, 3: 1, 4: 4}


def test_decontamination_and_licenses_find_the_place(docs, monkeypatch):
    monkeypatch.setattr(decontaminate, "PART_CHARS", 100_000)
    items = docs.sparkSession.createDataFrame([(7, ITEM)], "item_id long, text string")
    got = decontaminate.find_leaks(docs, items).collect()
    assert sorted((r.id, r.item, LONG[r.start : r.stop].strip(), r.edits) for r in got) == [(1, 7, ITEM, 0), (3, 7, ITEM, 0)]
    found = license_scan.scan(docs).collect()
    assert sorted((r.id, r.license, LONG[r.start : r.stop]) for r in found) == [(i, "MIT", "Released under the MIT License.") for i in (1, 3)]


def test_packing(docs):
    got = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json")).collect()
    whole = {r.id: r.doc_tokens for r in got}
    assert whole[1] == whole[3] > 100_000 and whole[4] == 1
    assert all(sum(r.length for r in got if r.id == i) == n for i, n in whole.items())


def test_scores(docs):
    rows = {r.id: r for r in lattice_lm.score_texts(docs, public_tokenizers.path("piece_bpe_32k.model"), group_col="lang").collect()}
    assert rows[1].n_tokens == len(LONG.split()) + 1 and rows[1].score == rows[3].score < rows[2].score < 0
    labels = docs.sparkSession.createDataFrame([(1, 0), (2, 0)], "doc_id long, toxic int")
    scored = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    assert len(scored) == 4 and len({r.toxic_score for r in scored}) == 1

from __future__ import annotations

import zlib
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from codeweft.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def h(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def leaf_of(doc):
    values = [doc[0], doc[3], doc[2], doc[4], doc[1]]
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climb(nodes):
    """Levels of a ternary tree from its leaves to its root."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([h("".join(below[i : i + 3])) for i in range(0, len(below), 3)])
    return levels


def brute(docs):
    groups = {}
    for doc in docs:
        groups.setdefault(doc[3], []).append(doc)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for name in names:
        groups[name].sort(key=lambda d: (d[0] is not None, d[0] or 0, leaf_of(d)))
        trees[name] = climb([leaf_of(d) for d in groups[name]])
    top = climb([trees[name][-1][0] for name in names])
    out = []
    for g, name in enumerate(names):
        for pos, doc in enumerate(groups[name]):
            changed = list(doc)
            if doc[0] is not None and zlib.crc32(str(doc[0]).encode()) % 2 == 0 and doc[1] is not None:
                changed[1] = doc[1].replace("\n", "")
            proof, folded = "", leaf_of(changed)
            for levels, at in ((trees[name], pos), (top, g)):
                for level in levels[:-1]:
                    run = level[at - at % 3 : at - at % 3 + 3]
                    left, right = run[: at % 3], run[at % 3 + 1 :]
                    proof += "".join(left + right)
                    folded = h("".join([*left, folded, *right]))
                    at //= 3
            out.append((doc[0], leaf_of(doc), trees[name][-1][0], top[-1][0], h(proof), folded, folded == top[-1][0]))
    return sorted(out, key=repr)


def run(spark, docs, height):
    table = spark.createDataFrame(docs, SCHEMA)
    for clash in ("tree", "leaf", "block", "slot", "root", "_part", "ordinal"):
        table = table.withColumn(clash, F.create_map(F.lit("a"), F.lit(1)))
    values = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    claimed = F.when(even, merkle.digest([*values[:-1], F.translate("text", "\n", "")]))
    manifest = merkle.build(table, merkle.digest(values), F.col("source"), F.col("doc_id"), claimed, carry=("doc_id",), height=height)
    return manifest, merkle.prove(manifest)


def rows_of(proved):
    return sorted(
        [(r.row.doc_id, r.leaf, r.subroot, r.root, h(bytes(r.siblings).hex()), r.folded, r.verified) for r in proved.collect()], key=repr
    )


def documents():
    docs = [(i, f"line {i}\nend", "en", "hot", 10) for i in range(40)]
    docs += [(100 + i, "x\n\ny" if i % 2 else "no break", "de", f"s{i}", None) for i in range(14)]
    docs += [(200, None, None, None, None), (201, "", "", "", 0), (None, "a\nb", "é", "hot", 3), (202, "ü" * 5000 + "\n", "fr", "größe", 5001)]
    # Repeated rows, one key with different texts, and a source of exactly one full block.
    docs += [docs[3], docs[3], (5, "other", "en", "hot", 5), (300, "\U0001f600\n", "en", "￿", 2), (301, "z", "en", "\U0001f600", 1)]
    return docs + [(400 + i, f"t{i}\n", "en", "nine", 3) for i in range(9)]


@pytest.mark.parametrize("height", [1, 2, 8])
def test_equals_brute_force(spark, height):
    docs = documents()
    assert rows_of(run(spark, docs, height)[1]) == brute(docs)


@pytest.mark.parametrize("n", [1, 3, 4, 28])
def test_one_group(spark, n):
    docs = [(i, f"{i}\n", "en", "one", 2) for i in range(n)]
    manifest, proved = run(spark, docs, 1)
    want = brute(docs)
    assert rows_of(proved) == want
    assert [r.root for r in manifest.root().collect()] == [want[0][3]]
    assert [(r.tree, r.subroot) for r in manifest.subroots().collect()] == [("=one", want[0][2])]
    if n == 1:
        assert want[0][1] == want[0][2] == want[0][3] and want[0][4] == h("")


def test_no_rows(spark):
    manifest, proved = run(spark, [], 2)
    assert proved.count() == 0 and manifest.root().count() == 0 and manifest.subroots().count() == 0


def test_addresses_are_a_layout_by_halves():
    for levels in range(1, 10):
        places = [merkle.addresses(levels, depth, np.arange(3**depth)) for depth in range(levels)]
        assert sorted(np.concatenate(places).tolist()) == list(range(merkle.size(levels)))
        upper = levels // 2
        if upper:
            # The upper half comes first; every subtree below it is one run, laid out like a tree of its own.
            assert max(int(p.max()) for p in places[:upper]) == merkle.size(upper) - 1
            part = merkle.size(levels - upper)
            for subtree in range(min(4, 3**upper)):
                own = [places[upper + d][subtree * 3**d : (subtree + 1) * 3**d] - merkle.size(upper) - subtree * part for d in range(levels - upper)]
                for d, at in enumerate(own):
                    assert at.tolist() == merkle.addresses(levels - upper, d, np.arange(3**d)).tolist()


def test_a_changed_leaf_or_sibling_fails(spark):
    proved = run(spark, documents(), 2)[1].collect()
    row = next(r for r in proved if r.verified and len(r.siblings) >= 64)
    root = bytes.fromhex(row.root)
    leaf, siblings, sides = bytes.fromhex(row.leaf), bytes(row.siblings), bytes(row.sides)
    assert merkle.fold(leaf, siblings, sides) == root
    for at in range(0, len(siblings), 17):
        wrong = siblings[:at] + bytes([siblings[at] ^ 1]) + siblings[at + 1 :]
        assert merkle.fold(leaf, wrong, sides) != root
    assert merkle.fold(bytes(32), siblings, sides) != root

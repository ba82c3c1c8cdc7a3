from __future__ import annotations

import itertools
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from codeweft.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("seed", range(30))
def test_fullest_equals_enumeration(seed):
    r = random.Random(seed)
    capacity = r.randint(1, 60)
    counts = np.zeros(capacity + 5, np.int64)
    for _ in range(r.randint(0, 5)):
        counts[r.randint(1, capacity + 4)] += r.randint(1, 3)
    lengths = [n for n in np.flatnonzero(counts).tolist()]
    best = max((s for pick in itertools.product(*[range(counts[n] + 1) for n in lengths]) if (s := sum(a * b for a, b in zip(pick, lengths))) <= capacity), default=0)
    total, used = packing.fullest(counts, capacity)
    assert total == best == sum(n * c for n, c in used.items())
    assert all(0 < c <= counts[n] for n, c in used.items())


def test_encoder_equals_the_files_own_library():
    r, encode, own = random.Random(1), packing.encoder(PATH), Tokenizer.from_file(PATH)
    letters = "abc éß日本 \n\t.,'1 don't <|endoftext|> \u00a0\u3000😀x"
    for text in ["", " ", "x" * 5000, " " * 3000, "a<|endoftext|>b", *["".join(r.choices(letters, k=r.randint(1, 300))) for _ in range(60)]]:
        assert encode(text).tolist() == own.encode(text, add_special_tokens=False).ids


def test_round_trip_without_padding(spark):
    r = random.Random(2)
    rows = [(i, " ".join(r.choice(["the", "of", "tion", "ß", "x1"]) for _ in range(r.choice([0, 1, 5, 60, 400])))) for i in range(300)]
    rows += [(1000, None), (1001, ""), (None, "null id"), (1002, "word " * 9000), rows[3]]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = packing.pack(docs, PATH, window=256).collect()
    own = Tokenizer.from_file(PATH)
    want = {i: [*own.encode(t or "", add_special_tokens=False).ids, 1] for i, t in rows}
    pieces, sequences = {}, {}
    for p in got:
        ids = np.frombuffer(p.ids, "<u4").tolist()
        assert len(ids) == p.length > 0 and want[p.id][p.start : p.start + p.length] == ids and p.doc_tokens == len(want[p.id])
        pieces.setdefault(p.id, []).append((p.start, p.length))
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for i, own_pieces in pieces.items():
        times = 2 if i == rows[3][0] else 1
        covered = sorted(x for s, n in own_pieces for x in range(s, s + n))
        assert covered == sorted([*range(len(want[i]))] * times)
    assert set(pieces) == set(want)
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 256 and at & (at - 1) == 0
    assert packing.pack(docs.limit(0), PATH).count() == 0

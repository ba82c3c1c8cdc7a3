from __future__ import annotations

import tracemalloc

import numpy as np
import pyarrow as pa

from codeweft.llm import substring_dedup, words


def peak(run):
    """Result, and MB of Python objects and numpy arrays at the peak."""
    words.encode_words([b"a b"])  # what is imported at first use is no part of it
    tracemalloc.start()
    try:
        result = run()
        return result, tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_words_become_arrow_arrays_piece_by_piece():
    texts = [" ".join(f"w{(i * 7 + j) % 5000}" for j in range(1000)).encode() for i in range(600)]
    (codes, counts, vocabulary), most = peak(lambda: words.encode_words(texts))
    assert [vocabulary[c] for c in codes] == [w for t in texts for w in t.split()]
    assert counts.tolist() == [1000] * 600 and len(set(vocabulary)) == len(vocabulary) == 5000
    assert most < 12


def test_a_bucket_sorts_windows_in_bounded_blocks():
    n, width = 1_000_000, 20
    codes = np.arange(n)
    codes[-30:] = codes[:30]
    one, start = np.zeros(1, np.int64), np.zeros(1, np.int64)
    got, most = peak(lambda: substring_dedup._repeats(one, one, start, np.array([n - width + 1]), codes, width))
    assert [c.tolist() for c in got] == [[0], [0], [n - 30], [n]]
    longer, _ = peak(lambda: substring_dedup._repeats(np.zeros(4, np.int64), np.zeros(4, np.int64), np.arange(4) * 250_000, np.full(4, 249_981), codes, width))
    assert [c.tolist() for c in longer] == [[0], [0], [n - 30], [n]]
    assert most < 72


def test_memory_goes_back_after_a_task_and_after_a_large_group(monkeypatch):
    calls = []
    monkeypatch.setattr(words, "give_back", lambda: calls.append(1))
    batches = [pa.record_batch([pa.array([i])], ["n"]) for i in range(3)]
    assert list(words.lean(iter(batches))) == batches and calls == [1]
    run = words.lean_group(lambda table: table)
    small, large = pa.table({"n": [1]}), pa.table({"n": np.zeros(1 << 18)})
    assert run(small) is small and calls == [1]
    assert run(large) is large and calls == [1, 1]

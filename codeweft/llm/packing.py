"""Packing of tokenised documents into sequences by minimum bin slack.

A document's ids are cut into whole windows and a rest. Rests wait in a pool of lengths; a window is opened with the longest
rest, and a subset-sum dynamic programme over the pool's lengths and counts (a bitset of reachable sums) finds the multiset
that fills it closest to the capacity; backtracking gives the count of each length. While a task still reads documents, only
full windows are closed. At its end the fullest window takes the head of a cut rest, and what is left then is cut at powers of
two, which need no padding. So padding is nil and few documents are cut.

Packing happens where the documents are read: nothing is shuffled, and a task holds one chunk of texts and the pool.

Defined results: a null or empty text is the end token alone; every input row is a document of its own, repeated or not;
``sequence_id`` is the partition in the high bits and a counter in the low ones.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweft.llm.words import lean, text_chunks

#: Windows' worth of tokens that the pool may carry from one chunk of texts to the next.
POOL_WINDOWS = 64
#: An unbroken run of more characters goes to the slower encoder, whose time does not grow with the square of the run.
LONG_RUN = 1_000


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", window: int = 2048, end_id: int = 1) -> DataFrame:
    """``id, start, length, doc_tokens, sequence_id, offset, ids``: one row per piece; ``ids`` are little-endian unsigned 32-bit.

    ``tokenizer`` is the path of a byte-level BPE file that every executor can read.
    """
    rows = docs.select(docs[id_col].cast("long").alias("id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    schema = "id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
    return rows.mapInArrow(lambda it: lean(_pack(it, tokenizer, window, end_id)), schema)


def encoder(path: str):  # noqa: ANN201
    """``text -> uint32 array`` with the ids that the tokenizer file's own library gives."""
    import tiktoken
    from public_tokenizers import PATTERN
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as file:
        stored = json.load(file)
    special = {t["content"]: t["id"] for t in stored["added_tokens"]}
    # Byte-level vocabularies write a byte as itself where it is printable, else as the next character from 256 on.
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shown = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(printable))}
    ranks = {bytes(shown[c] for c in token): i for token, i in stored["model"]["vocab"].items() if token not in special}
    fast = tiktoken.Encoding("byte-bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    unusual = re.compile("|".join([rf"\S{{{LONG_RUN},}}", rf"\s{{{LONG_RUN},}}", *map(re.escape, special)]))

    def encode(text: str) -> np.ndarray:
        if unusual.search(text):
            return np.array(own.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.array(fast.encode_ordinary(text), np.uint32)

    return encode


def fullest(counts: np.ndarray, capacity: int) -> tuple[int, dict[int, int]]:
    """The largest sum up to ``capacity`` of lengths used at most ``counts[length]`` times, and how often each is used.

    Lengths are offered from the longest on; the search ends as soon as the capacity itself is reachable.
    """
    reach, mask, steps = 1, (1 << (capacity + 1)) - 1, []
    for length in np.flatnonzero(counts[: capacity + 1])[::-1].tolist():
        if not length:
            break
        left, times = min(int(counts[length]), capacity // length), 1
        while left and not reach >> capacity & 1:
            take = min(times, left)
            steps.append((length, take, reach))
            reach |= reach << (length * take) & mask
            left, times = left - take, times * 2
        if reach >> capacity & 1:
            break
    total = rest = reach.bit_length() - 1
    used: dict[int, int] = {}
    for length, take, before in reversed(steps):
        if not before >> rest & 1:
            used[length] = used.get(length, 0) + take
            rest -= length * take
    return total, used


class Packer:
    def __init__(self, window: int, base: int) -> None:
        self.window, self.next = window, base
        self.pool: dict[int, list] = {}
        self.counts = np.zeros(window + 1, np.int64)
        self.tokens = 0
        self.out: list[tuple] = []

    def add(self, doc, ids: np.ndarray) -> None:  # noqa: ANN001
        whole = len(ids) // self.window * self.window
        for start in range(0, whole, self.window):
            self.close([(doc, start, len(ids), ids[start : start + self.window])])
        if whole < len(ids):
            self.keep((doc, whole, len(ids), ids[whole:]))

    def keep(self, piece: tuple) -> None:
        n = len(piece[3])
        self.pool.setdefault(n, []).append(piece)
        self.counts[n] += 1
        self.tokens += n

    def take(self, n: int) -> tuple:
        self.counts[n] -= 1
        self.tokens -= n
        return self.pool[n].pop()

    def close(self, pieces: list[tuple]) -> None:
        at = 0
        for doc, start, total, ids in pieces:
            self.out.append((doc, start, len(ids), total, self.next, at, ids.astype("<u4").tobytes()))
            at += len(ids)
        self.next += 1

    def fill(self, last: bool) -> None:
        """Close windows: only full ones, unless the pool is over its bound or the task ends."""
        while self.tokens >= self.window:
            longest = int(np.flatnonzero(self.counts)[-1])
            self.counts[longest] -= 1
            total, used = fullest(self.counts, self.window - longest)
            self.counts[longest] += 1
            slack = self.window - longest - total
            if slack and not last and self.tokens < POOL_WINDOWS * self.window:
                return
            pieces = [self.take(longest)] + [self.take(n) for n, times in used.items() for _ in range(times)]
            if slack:
                # No multiset fits better: the head of the longest rest fills the gap, its tail goes back.
                doc, start, whole, ids = self.take(int(np.flatnonzero(self.counts)[-1]))
                pieces.append((doc, start, whole, ids[:slack]))
                self.keep((doc, start + slack, whole, ids[slack:]))
            self.close(pieces)
        if last:
            rest = [self.take(int(n)) for n in np.flatnonzero(self.counts)[::-1] for _ in range(int(self.counts[n]))]
            left = sum(len(p[3]) for p in rest)
            while left:
                size = 1 << (left.bit_length() - 1)
                left, pieces = left - size, []
                while size:
                    doc, start, whole, ids = rest.pop(0)
                    pieces.append((doc, start, whole, ids[:size]))
                    if len(ids) > size:
                        rest.insert(0, (doc, start + size, whole, ids[size:]))
                    size -= len(pieces[-1][3])
                self.close(pieces)

    def drain(self) -> pa.RecordBatch:
        types = [pa.int64()] * 6 + [pa.binary()]
        columns = list(zip(*self.out, strict=True)) or [()] * 7
        self.out = []
        return pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])


def _pack(batches: Iterable[pa.RecordBatch], tokenizer: str, window: int, end_id: int) -> Iterator[pa.RecordBatch]:
    encode, end = None, np.array([end_id], np.uint32)
    packer = Packer(window, TaskContext.get().partitionId() << 32)
    for table in text_chunks(batches):
        encode = encode or encoder(tokenizer)
        for doc, text in zip(table.column("id").to_pylist(), table.column("text").to_pylist(), strict=True):
            packer.add(doc, np.append(encode(text.decode()), end))
        packer.fill(last=False)
        yield packer.drain()
    packer.fill(last=True)
    yield packer.drain()

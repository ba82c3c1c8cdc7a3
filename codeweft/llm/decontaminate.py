"""Benchmark decontamination by the q-gram lemma and banded alignment.

Texts are compared as lower-cased letters and digits of their composed form (NFC) with single spaces. A region within ``e`` edits of an item of ``L``
characters shares at least ``L - q + 1 - q e`` q-grams with it, and at least ``L // q - e`` of those that do not overlap (every q-th), on
diagonals that differ by at most ``e``. Shared q-grams that do not overlap are counted in cells of more than ``e`` diagonals, so two
neighbouring cells, a band, hold them all. In bands that reach that bound all q-grams of the item are counted, and bands that reach the
first bound are verified by alignment of the whole item against the band (item ends fixed, text ends free).

Documents stay where they are read: the items travel, in blocks of bounded size (one pass each), and nothing is shuffled, so a
passage that a third of all documents hold costs no more than any other. A text longer than a chunk is cut into overlapping parts.

Defined results: null and empty texts or items match nothing, as do items without letters or digits; items shorter than
``q`` + 1 characters (in the caller's q; short items with many edits are searched with a smaller one) must occur as they are, between spaces; repeated rows each get their own matches.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweft.llm.words import lean, mix, ranges, rolling, text_chunks

#: Characters of items that one pass over the documents carries (up to some 40 bytes each in a task).
BLOCK_CHARS = 2_000_000
#: Setting of the query and the pipeline: copies with up to 12 % of their characters edited are found.
WIDE = {"q": 6, "budget": 0.12}
PART_CHARS = 1 << 20
HITS = 1 << 20
#: Items that must keep fewer q-grams that do not overlap are searched by all of theirs.
SEEDS = 2
CELL = (1 << 40) - 1
GAP = np.uint32(0x110000)
SPACE = np.uint32(32)


def find_leaks(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", q: int = 7, budget: float = 0.1
) -> DataFrame:
    """``id, item, start, stop, edits``: regions (character offsets) within ``floor(budget * L)`` edits of a whole item; overlapping ones of an item once."""
    rows = docs.select(docs[id_col].cast("long").alias("id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    found = []
    for block in _blocks(items, item_text_col, item_id_col):
        known = _Items(block, q, budget)

        def run(batches: Iterable[pa.RecordBatch], known: _Items = known) -> Iterator[pa.RecordBatch]:
            for table in text_chunks(batches):
                ids, out = table.column("id").to_pylist(), _matches(table.column("text").to_pylist(), known)
                columns = [[ids[m[0]] for m in out], [known.ids[m[1]] for m in out], *[[m[i] for m in out] for i in (2, 3, 4)]]
                yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], ["id", "item", "start", "stop", "edits"])

        found.append(rows.mapInArrow(lambda it, run=run: lean(run(it)), "id long, item long, start long, stop long, edits long"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def without_leaks(docs: DataFrame, items: DataFrame, text_col: str = "text", item_text_col: str = "text", q: int = 7, budget: float = 0.1) -> DataFrame:
    """Rows of ``docs`` (all columns) that hold no region within the budget of an item."""
    columns = docs.columns
    rows = docs.select(F.struct(*[docs[c] for c in columns]).alias("row"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    for block in _blocks(items, item_text_col, None):
        known = _Items(block, q, budget)

        def keep(batches: Iterable[pa.RecordBatch], known: _Items = known) -> Iterator[pa.RecordBatch]:
            for table in text_chunks(batches):
                bad = {m[0] for m in _matches(table.column("text").to_pylist(), known)}
                table = table.set_column(1, "text", table.column("text").cast(pa.string())).filter(pa.array([i not in bad for i in range(table.num_rows)], pa.bool_()))
                yield from table.combine_chunks().to_batches()

        rows = rows.mapInArrow(lambda it, keep=keep: lean(keep(it)), rows.schema)
    return rows.select(*[F.col("row").getField(c).alias(c) for c in columns])


def _blocks(items: DataFrame, text_col: str, id_col: str | None) -> Iterator[list]:
    """The items in lists of about BLOCK_CHARS characters: the stated query set, a block at a time on the driver."""
    key = items[id_col].cast("long") if id_col else F.lit(0).cast("long")
    rows = items.select(key.alias("item"), items[text_col].cast("string").alias("text")).filter("text is not null")
    size = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = max(1, -(-size // BLOCK_CHARS))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("text"), F.lit(parts)))
    for part in range(parts):
        yield [(r.item, r.text) for r in rows.filter(F.col("part") == part).select("item", "text").distinct().collect()]


_LETTER = np.array([chr(i).isalnum() for i in range(0x10000)])
_LOWER = np.array([ord(c) if len(c := chr(i).lower()) == 1 else i for i in range(0x10000)], np.uint32)


def plain(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased letters and digits with one space for anything between, and each character's offset in ``text``."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    low = np.minimum(points, 0xFFFF)
    letter = _LETTER[low]
    points = np.where(points > 0xFFFF, points, _LOWER[low])
    letter |= points > 0xFFFF
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    at = np.flatnonzero(keep)
    out = np.where(letter[at], points[at], SPACE).astype(np.uint32)
    if len(out) and out[-1] == SPACE:
        out, at = out[:-1], at[:-1]
    return out, at


def _placed(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``plain`` of the composed text, with the first offset and the offset after each character in the text as it stands."""
    if unicodedata.is_normalized("NFC", text):
        codes, at = plain(text)
        return codes, at, at + 1
    pieces, spans, done = [], [], 0
    for found in [*_unstable().finditer(text), None]:
        start, stop = found.span() if found else (len(text), len(text))
        pieces.append(text[done:start])
        spans.append((start - done, done, start, 1))
        if found:
            pieces.append(unicodedata.normalize("NFC", found[0]))
            spans.append((len(pieces[-1]), start, stop, 0))
        done = stop
    n, first, past, same = np.array(spans, np.int64).T
    inner = ranges(np.zeros(len(n)), n)
    begin = np.repeat(first, n) + inner * np.repeat(same, n)
    end = np.where(np.repeat(same, n) == 1, begin + 1, np.repeat(past, n))
    codes, at = plain("".join(pieces))
    return codes, begin[at], end[at]


@functools.cache
def _unstable() -> re.Pattern:
    """Runs that NFC may change: characters that can join or be moved before the one in front, with that one, and characters that it replaces."""
    every = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000 and not 0xAC00 <= i < 0xD7A4]
    parts = {c: unicodedata.normalize("NFD", c) for c in every}
    joins = {c for c in every if unicodedata.combining(c)} | {chr(i) for i in [*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)]}
    joins |= {x for p in parts.values() for x in p[1:]}
    joins |= {c for c, p in parts.items() if p[0] in joins}
    replaced = {c for c in every if unicodedata.normalize("NFC", c) != c}
    one = lambda chars: "[" + "".join(f"\\U{ord(c):08x}" for c in sorted(chars)) + "]"
    return re.compile(f"(?s:.?{one(joins)}+|{one(replaced)})")


class _Items:
    """Items of one block with their q-gram index.

    Items whose edits may leave no q-gram whole have indexes of a smaller q of their own, ``narrow``, whose ids are places in ``ids``.
    """

    def __init__(self, block: list, q: int, budget: float) -> None:
        if not 0 <= budget < 1:
            raise ValueError("budget is a share of an item's length, below 1")
        narrow: dict[int, list] = {}
        self.q, self.ids, self.codes, self.exact = q, [], [], []
        for item, text in sorted(block, key=lambda r: (r[0] is None, r[0] or 0, r[1])):
            codes = plain(unicodedata.normalize("NFC", text))[0]
            fits = len(codes) // (int(len(codes) * budget) + 1)
            if len(codes) > q > fits:
                narrow.setdefault(fits, []).append((item, text))
            elif len(codes) > q:
                self.codes.append(codes)
                self.ids.append(item)
            elif len(codes):
                self.exact.append((codes, item))
        self.first_exact = len(self.codes)
        for codes, item in self.exact:
            self.codes.append(codes)
            self.ids.append(item)
        long = self.codes[: self.first_exact]
        sizes = np.array([len(c) for c in long], np.int64)
        self.edits = (sizes * budget).astype(np.int64)
        self.shared = sizes - q + 1 - q * self.edits
        # An edit meets up to q places, but only one of those that are q apart: these are a q-th of the hits and lose no region.
        apart = sizes // q - self.edits
        step = np.where(apart >= SEEDS, q, 1)
        self.least = np.where(apart >= SEEDS, apart, self.shared)
        grams = [rolling(c.astype(np.uint64), q) for c in long]
        kept = [np.arange(0, len(g), n) for g, n in zip(grams, step.tolist(), strict=True)]
        flat = np.concatenate([g[at] for g, at in zip(grams, kept, strict=True)]) if grams else np.zeros(0, np.uint64)
        order = np.argsort(flat, kind="stable")
        self.item = np.repeat(np.arange(len(long)), [len(at) for at in kept])[order]
        self.place = (np.concatenate(kept) if grams else np.zeros(0, np.int64))[order]
        self.grams, self.begin, self.count = np.unique(flat[order], return_index=True, return_counts=True)
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(self.grams >> np.uint64(44)).astype(np.int64)] = True
        self.overlap = int(max([*sizes + 2 * self.edits, q], default=q)) + 2
        self.narrow, self.reach = [], self.overlap
        for size, own in sorted(narrow.items()):
            self.narrow.append(_Items([(len(self.ids) + n, text) for n, (_, text) in enumerate(own)], size, budget))
            self.ids.extend(item for item, _ in own)
            self.reach = max(self.reach, self.narrow[-1].overlap)


def _matches(texts: list[bytes], known: _Items) -> list[tuple]:
    """``(text, item, start, stop, edits)`` with offsets in characters."""
    parts, owners, shifts, size, found = [], [], [], 0, []
    for i, text in enumerate(texts):
        codes, begin, end = _placed(text.decode())
        for low in range(0, max(1, len(codes)), PART_CHARS):
            part = slice(low, low + PART_CHARS + known.reach)
            if len(codes[part]):
                parts.append((i, codes[part], begin[part], end[part]))
                size += len(codes[part])
        if size >= PART_CHARS or i + 1 == len(texts):
            found.extend(_in_parts(parts, known))
            parts, size = [], 0
    return _once(found)


def _once(found: list[tuple]) -> list[tuple]:
    """Of overlapping regions of one text and item the one with fewest edits (then the first, then the shortest)."""
    out: list[tuple] = []
    for m in sorted(set(found)):
        last = out[-1] if out else None
        if last and m[:2] == last[:2] and m[2] < last[3]:
            if (m[4], m[2], m[3]) < (last[4], last[2], last[3]):
                out[-1] = m
        else:
            out.append(m)
    return out


def _in_parts(parts: list[tuple], known: _Items) -> Iterator[tuple]:
    if not parts:
        return
    gap = np.array([GAP])
    line = np.concatenate([x for _, codes, _, _ in parts for x in (codes, gap)])
    starts = np.cumsum([0] + [len(codes) + 1 for _, codes, _, _ in parts])
    few = [(own.ids[m[0]], *m[1:]) for own in known.narrow for m in _candidates(line, own)]
    for item, begin, stop, edits in [*_candidates(line, known), *_as_they_are(line, known), *few]:
        at = int(np.searchsorted(starts, begin, side="right")) - 1
        who, codes, first, past = parts[at]
        a, b = begin - int(starts[at]), stop - int(starts[at])
        if b <= len(codes):
            yield who, item, int(first[a]), int(past[b - 1]), edits


def _as_they_are(line: np.ndarray, known: _Items) -> Iterator[tuple]:
    for i in range(known.first_exact, len(known.codes)):
        codes = known.codes[i]
        hit = np.flatnonzero(line[: len(line) - len(codes) + 1] == codes[0])
        for j in range(1, len(codes)):
            hit = hit[line[hit + j] == codes[j]]
        edge = lambda at: (at < 0) | (at >= len(line)) | (line[np.clip(at, 0, len(line) - 1)] == SPACE) | (line[np.clip(at, 0, len(line) - 1)] == GAP)
        for at in hit[edge(hit - 1) & edge(hit + len(codes))].tolist():
            yield i, at, at + len(codes), 0


def _candidates(line: np.ndarray, known: _Items) -> Iterator[tuple]:
    if not known.first_exact:
        return
    grams = rolling(line.astype(np.uint64), known.q)
    hits = np.flatnonzero(known.seen[(grams >> np.uint64(44)).astype(np.int64)])
    where = np.minimum(np.searchsorted(known.grams, grams[hits]), len(known.grams) - 1)
    true = known.grams[where] == grams[hits]
    hits, where = hits[true], where[true]
    width = np.maximum(16, known.edits + 1)
    keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    sums = np.cumsum(known.count[where])
    low = 0
    while low < len(hits):
        high = max(low + 1, int(np.searchsorted(sums, (sums[low - 1] if low else 0) + HITS, side="right")))
        n = known.count[where[low:high]]
        index = ranges(known.begin[where[low:high]], n)
        item = known.item[index]
        # Cell c of an item holds diagonals c * width .. c * width + width - 1, shifted to be positive; cells c and c + 1 are band c.
        diagonal = np.repeat(hits[low:high], n) - known.place[index] + known.overlap
        new, c = _tally(item, diagonal // width[item], known.first_exact)
        # Bands that lie within these hits alone are full; only those at the edges can have more.
        kept = _in_full_bands(new, c, known) | (((new & CELL) - 1) * width[new >> 40] - known.overlap < hits[low])
        if high < len(hits):
            kept |= _open(new, width, hits[high] - known.overlap)
        keys, back = np.unique(np.concatenate([keys, new[kept]]), return_inverse=True)
        counts = np.bincount(back, np.concatenate([counts, c[kept]]), len(keys)).astype(np.int64)
        if high < len(hits):
            # Bands that end before the next hit can fill no further.
            keep = _open(keys, width, hits[high] - known.overlap) | _in_full_bands(keys, counts, known)
            keys, counts = keys[keep], counts[keep]
        low = high
    good = _bands(keys, counts) >= known.least[keys >> 40]
    item, band = keys[good] >> 40, keys[good] & CELL
    for i in np.unique(item):
        begin = band[item == i] * width[i] - known.overlap
        begin = begin[_held(grams, rolling(known.codes[i].astype(np.uint64), known.q), begin, int(2 * width[i])) >= known.shared[i]]
        yield from _align(line, known.codes[i], int(known.edits[i]), int(i), begin, int(2 * width[i] - known.edits[i]))


def _held(grams: np.ndarray, own: np.ndarray, begin: np.ndarray, width: int) -> np.ndarray:
    """How many of the q-grams ``own`` of an item each band of ``width`` diagonals holds, each place of the item counted once."""
    known, gram = np.unique(own, return_inverse=True)
    reach = width + len(own) - 1
    out = np.zeros(len(begin), np.int64)
    step = max(1, HITS // reach)
    for low in range(0, len(begin), step):
        at = begin[low : low + step, None] + np.arange(reach)
        some = grams[np.clip(at, 0, len(grams) - 1)]
        where = np.minimum(np.searchsorted(known, some), len(known) - 1)
        band, shift = np.nonzero((known[where] == some) & (at >= 0) & (at < len(grams)))
        # Band, q-gram and offset travel in one number; the q-gram of place p is due at the offsets p .. p + width - 1.
        stand = np.sort((band * len(known) + where[band, shift]) * reach + shift)
        due = (np.arange(len(at))[:, None] * len(known) + gram) * reach + np.arange(len(own))
        after = np.append(stand, np.iinfo(np.int64).max)[np.searchsorted(stand, due)]
        out[low : low + step] = (after < due + width).sum(axis=1)
    return out


def _bands(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """What every cell holds together with the next one."""
    both = counts.copy()
    both[:-1] += np.where(keys[1:] == keys[:-1] + 1, counts[1:], 0)
    return both


def _in_full_bands(keys: np.ndarray, counts: np.ndarray, known: _Items) -> np.ndarray:
    full = _bands(keys, counts) >= known.least[keys >> 40]
    out = full.copy()
    out[1:] |= full[:-1] & (keys[1:] == keys[:-1] + 1)
    return out


def _open(keys: np.ndarray, width: np.ndarray, to: int) -> np.ndarray:
    return ((keys & CELL) + 2) * width[keys >> 40] >= to


def _tally(item: np.ndarray, cell: np.ndarray, items: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ``item << 40 | cell`` and how often each occurs: by one counter for each, unless most would stay 0."""
    first = np.full(items, np.iinfo(np.int64).max)
    np.minimum.at(first, item, cell)
    at = cell - first[item]
    span = int(at.max(initial=0)) + 1
    if items * span > 12 * len(item):
        return np.unique(item << 40 | cell, return_counts=True)
    counts = np.bincount(item * span + at, minlength=items * span)
    found = np.flatnonzero(counts)
    item = found // span
    return item << 40 | (first[item] + found % span), counts[found]


def _align(line: np.ndarray, codes: np.ndarray, edits: int, item: int, begin: np.ndarray, width: int) -> Iterator[tuple]:
    """Best alignment of the whole item in each band; cost and start offset travel in one number (cost high)."""
    one, span, size = 1 << 20, width + 3 * edits + 1, len(codes)
    for low in range(0, len(begin), 256):
        first = begin[low : low + 256] - edits
        at = first[:, None] + np.arange(span + size)[None, :]
        text = np.where((at >= 0) & (at < len(line)), line[np.clip(at, 0, len(line) - 1)], GAP)
        steps = np.arange(span, dtype=np.int64) * one
        cost = np.tile(np.arange(span, dtype=np.int64), (len(first), 1))
        for i in range(size):
            here = text[:, i : i + span]
            # A gap between texts cannot be part of a match.
            new = cost + np.where(here == codes[i], 0, np.where(here == GAP, one << 12, one))
            new[:, :-1] = np.minimum(new[:, :-1], cost[:, 1:] + one)
            cost = np.minimum.accumulate(new - steps, axis=1) + steps
            if i % 8 == 7:
                # Costs never fall again, so bands beyond the budget are done.
                alive = cost.min(axis=1) < (edits + 1) * one
                if not alive.all():
                    first, text, cost = first[alive], text[alive], cost[alive]
                    if not len(first):
                        break
        best = cost.argmin(axis=1) if len(first) else np.zeros(0, np.int64)
        for r, d in enumerate(best.tolist()):
            value = int(cost[r, d])
            if value // one <= edits:
                start, stop = int(first[r]) + value % one, int(first[r]) + d + size
                if start >= 0 and stop > start and not (line[start:stop] == GAP).any():
                    yield item, start, stop, value // one

"""Substring deduplication by super-k-mer partitioning.

A window is ``width`` consecutive words of one document. Consecutive windows that share their minimiser (the smallest hash of
the ``seed``-word runs inside) travel as one packed run of words, a super-k-mer, to the bucket of that minimiser. Equal windows
have equal minimisers, so they meet in one bucket, where sorting finds each window's first occurrence.

Hot passages: runs that are equal inside a chunk are settled there, since all but the first repeat something earlier, so a
bucket gets one run per chunk and text. Seed runs that are frequent over the corpus are no minimisers (a bucket would gather
all their contexts); a window made of nothing else is dealt by its own hash.

Defined results: null and empty texts have no words; rows with the same id and text are one document, each getting its result;
rows with the same id and different texts are documents ordered by a hash of the text; null ids come last.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweft.llm.keys import maybe_in
from codeweft.llm.words import encode_words, gathered, keyed, lean, lean_group, mix, pack_arrays, ranges, rolling, text_bytes, text_chunks, unpack_arrays, within, word_hashes
from codeweft.session import cut

#: Text dealt at once in a task; larger blobs repeat fewer words of their vocabulary.
DEAL_BYTES = 4 << 20
#: Words of runs (neighbouring runs overlap) that are compared at once.
BLOCK_WORDS = 1 << 18
#: Text whose seed runs are hashed at once.
LISTED_BYTES = 1 << 20
#: Words that a bucket is planned to receive, and the most seed runs that are ever called hot (8 bytes each in a broadcast).
BUCKET_WORDS = 3_000_000
MOST_HOT = 1 << 22
HOT_BIT = np.uint64(1 << 63)
SALT = np.uint64(0x51ED2701)


def remove_repeated_windows(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 20, seed: int = 4, carry: Sequence[str] = ()
) -> DataFrame:
    """Every input row with the words covered by a window that starts earlier elsewhere taken out.

    Returns ``id, text, n_words, n_removed, kept`` and the columns named in ``carry``; ``kept`` holds the remaining words
    joined by one space (the words of ``text`` when none goes).
    """
    carried = F.struct(*[docs[c] for c in carry]) if carry else F.lit(0)
    rows = keyed(docs, id_col, text_col, carried)
    spans = cut(repeated_spans(rows, width, seed))
    marks = spans.groupBy("k", "tie").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    # Most documents repeat nothing: they are finished where they are read, only the others travel to their spans.
    split = maybe_in(rows, spans)
    none = F.lit(None).cast("array<struct<start:bigint,stop:bigint>>").alias("spans")
    joined = split.filter("maybe").join(marks, ["k", "tie"], "left").select("id", "text", "row", "spans")
    joined = joined.unionByName(split.filter("not maybe").select("id", "text", "row", none))
    joined = gathered(joined, text_bytes(rows))
    schema = joined.select("id", "text", "row").schema
    for name in ("n_words", "n_removed"):
        schema = schema.add(name, "long")
    cut_out = joined.mapInArrow(lambda it: lean(_cut(it)), schema.add("kept", "string"))
    return cut_out.select("id", "text", "n_words", "n_removed", "kept", *[F.col("row").getField(c).alias(c) for c in carry])


def with_digest(kept: DataFrame) -> DataFrame:
    return kept.withColumn("kept_sha256", F.sha2(F.col("kept").cast("binary"), 256))


def repeated_spans(rows: DataFrame, width: int, seed: int) -> DataFrame:
    """``k, tie, start, stop``: word spans made of windows that occur earlier (spans of a document may touch or overlap)."""
    spark = rows.sparkSession
    texts = rows.select("k", "tie", "text")
    total, hot = _hot_seeds(texts, width, seed)
    buckets = max(1, -(-total * 3 // BUCKET_WORDS))
    shared = spark.sparkContext.broadcast(hot)
    dealt = texts.mapInArrow(lambda it: lean(_deal(it, width, seed, buckets, shared.value)), "bucket long, blob binary")
    # One group is one bucket, so its size follows BUCKET_WORDS, not the number of shuffle partitions.
    return dealt.groupBy("bucket").applyInArrow(lean_group(lambda table: _settle(table, width)), "k long, tie long, start long, stop long")


def _hot_seeds(texts: DataFrame, width: int, seed: int) -> tuple[int, np.ndarray]:
    """Number of words, and the seed runs with too many occurrences to be minimisers.

    Tasks report runs with four or more occurrences, so rarer ones are not seen; the choice changes where windows meet, not
    the result.
    """
    counted = texts.mapInArrow(lambda it: lean(_count_seeds(it, width, seed)), "seed long, n long")
    sums = counted.groupBy("seed").agg(F.sum("n").alias("n"))
    sums = cut(sums.filter(F.col("seed").isNull() | (F.col("n") >= BUCKET_WORDS // 256)))
    total = sums.filter("seed is null").agg(F.sum("n")).first()[0] or 0
    least = max(BUCKET_WORDS // 256, total // MOST_HOT)
    found = sums.filter(F.col("seed").isNotNull() & (F.col("n") >= least)).select("seed").toArrow()
    return total, np.sort(found.column(0).combine_chunks().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))


def _count_seeds(batches: Iterable[pa.RecordBatch], width: int, seed: int) -> Iterator[pa.RecordBatch]:
    keys, counts, words = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0
    for table in text_chunks(batches):
        found, n, own = _chunk_seeds(table, width, seed)
        words += own
        keys, where = np.unique(np.concatenate([keys, found]), return_inverse=True)
        counts = np.bincount(where, np.concatenate([counts, n]), len(keys)).astype(np.int64)
    often = counts >= 4
    seeds = pa.array(keys[often].view(np.int64))
    yield pa.record_batch([pa.concat_arrays([seeds, pa.nulls(1, pa.int64())]), pa.array(np.append(counts[often], words))], ["seed", "n"])


def _chunk_seeds(table: pa.Table, width: int, seed: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The seed runs that occur more than once in texts with a window, how often, and the number of words of all texts."""
    hashes, words = [], 0
    for part in text_chunks(table.select(["text"]).to_batches(), limit=LISTED_BYTES):
        codes, lengths, vocabulary = encode_words(part.column("text").to_pylist())
        words += len(codes)
        keep = np.repeat(lengths >= width, lengths)
        if keep.any():
            rolled = rolling(word_hashes(vocabulary)[codes[keep]], seed)
            hashes.append(rolled[within(np.where(lengths >= width, lengths, 0), seed)])
    hashes = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    hashes.sort()
    heads = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1])) if len(hashes) else np.zeros(0, np.int64)
    n = np.diff(np.append(heads, len(hashes)))
    return hashes[heads[n >= 2]], n[n >= 2], words


def _minimisers(values: np.ndarray, width: int, seed: int, hot: np.ndarray) -> np.ndarray:
    """The dealing key of the window at every position (positions across texts are meaningless and not used)."""
    seeds = rolling(values, seed)
    if len(hot):
        at = np.minimum(np.searchsorted(hot, seeds), len(hot) - 1)
        keys = np.where(hot[at] == seeds, HOT_BIT, np.uint64(0)) | (seeds >> np.uint64(1))
    else:
        keys = seeds >> np.uint64(1)
    need, have = width - seed + 1, 1
    while have < need:
        step = min(have, need - have)
        keys = np.minimum(keys[: len(keys) - step], keys[step:])
        have += step
    return np.where(keys >= HOT_BIT, rolling(values, width) | HOT_BIT, keys)


def _deal(batches: Iterable[pa.RecordBatch], width: int, seed: int, buckets: int, hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    for table in text_chunks(batches, limit=DEAL_BYTES):
        yield from _dealt(table, width, seed, buckets, hot)


def _dealt(table: pa.Table, width: int, seed: int, buckets: int, hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    k, tie = table.column("k").to_numpy(), table.column("tie").to_numpy()
    order = np.lexsort((tie, k))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (k[order][1:] != k[order][:-1]) | (tie[order][1:] != tie[order][:-1])
    order = order[fresh]
    texts = table.column("text").to_pylist()
    codes, counts, vocabulary = encode_words(texts[i] for i in order)
    del texts
    by_word = np.array(sorted(range(len(vocabulary)), key=vocabulary.__getitem__), np.int64)
    vocabulary = [vocabulary[i] for i in by_word]
    codes = np.argsort(by_word).astype(np.int32)[codes] if len(by_word) else codes
    starts = within(counts, width)
    if not len(starts):
        return
    k, tie, docs = k[order], tie[order], np.repeat(np.arange(len(order)), np.maximum(counts - width + 1, 0))
    values = word_hashes(vocabulary)[codes]
    keys = np.zeros(len(values) - width + 1, np.uint64)
    for low in range(0, len(keys), BLOCK_WORDS):
        high = min(low + BLOCK_WORDS, len(keys))
        keys[low:high] = _minimisers(values[low : high + width - 1], width, seed, hot)
    keys = keys[starts]
    ends = np.ones(len(starts), bool)
    ends[1:] = (docs[1:] != docs[:-1]) | (keys[1:] != keys[:-1])
    runs = np.flatnonzero(ends)
    lengths = np.diff(np.append(runs, len(starts)))
    at, doc, key = starts[runs], docs[runs], keys[runs]
    local = at - (np.cumsum(counts) - counts)[doc]
    del starts, docs, keys, ends
    first = _first_equal(codes, at, lengths + width - 1, values)
    again = first != np.arange(len(runs))
    words = np.array(vocabulary, object)
    # A repeat inside the chunk needs no words: it is known to be one. Neighbouring runs of a document merge.
    spans = _merge(doc[again], local[again], local[again] + lengths[again] + width - 1)
    out = [(int(mix(np.uint64([k[d] & ((1 << 63) - 1)]))[0] % np.uint64(buckets)), d, s, e) for d, s, e in zip(*spans, strict=True)]
    settled: dict[int, list] = {}
    for bucket, d, s, e in out:
        settled.setdefault(bucket, []).append((k[d], tie[d], s, e))
    kept = np.flatnonzero(~again)
    bucket = (mix(key[kept]) % np.uint64(buckets)).astype(np.int64)
    by = np.argsort(bucket, kind="stable")
    kept, bucket = kept[by], bucket[by]
    edges = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.zeros(0, np.int64)
    groups = {int(bucket[a]): kept[a:b] for a, b in zip(edges, np.append(edges[1:], len(bucket)), strict=True)}
    names, blobs, size = [], [], 0
    for b in sorted(groups.keys() | settled.keys()):
        own = groups.get(b, np.zeros(0, np.int64))
        stream = codes[ranges(at[own], lengths[own] + width - 1)]
        used, stream, often = np.unique(stream, return_inverse=True, return_counts=True)
        # The 256 most frequent words first, the rest in alphabetical order: both compress well, byte by byte.
        top = np.argsort(-often, kind="stable")[:256]
        rest = np.ones(len(used), bool)
        rest[top] = False
        listed = np.concatenate([top, np.flatnonzero(rest)])
        stream, used = np.argsort(listed)[stream], used[listed]
        small = np.dtype(np.uint16 if len(used) <= 1 << 16 else np.uint32)
        planes = stream.astype(small).view(np.uint8).reshape(-1, small.itemsize).T
        known = np.array(settled.get(b, []), np.int64).reshape(-1, 4)
        who, which = np.unique(doc[own], return_inverse=True)
        names.append(b)
        blobs.append(
            pack_arrays(
                k[who], tie[who], which.astype(np.uint32), local[own].astype(np.uint32), lengths[own].astype(np.uint32),
                np.array([small.itemsize]), planes, b" ".join(words[used]), known,
            )
        )
        size += len(blobs[-1])
        if size > 8 << 20:
            yield pa.record_batch([pa.array(names, pa.int64()), pa.array(blobs, pa.binary())], ["bucket", "blob"])
            names, blobs, size = [], [], 0
    if names:
        yield pa.record_batch([pa.array(names, pa.int64()), pa.array(blobs, pa.binary())], ["bucket", "blob"])


def _first_equal(codes: np.ndarray, at: np.ndarray, lengths: np.ndarray, values: np.ndarray) -> np.ndarray:
    """For each run of words, the first run with the same words (words are compared; the hash only proposes)."""
    powers = mix(np.uint64(0x9E3779B97F4A7C15) * (np.arange(int(lengths.max()), dtype=np.uint64) * np.uint64(2) + np.uint64(1)))
    names = np.zeros(len(at), np.uint64)
    for own in _blocks(lengths):
        n = lengths[own]
        placed = mix(values[ranges(at[own], n)] + powers[ranges(np.zeros(len(n), np.int64), n)])
        names[own] = mix(np.add.reduceat(placed, np.cumsum(n) - n) + n.astype(np.uint64))
    _, first, which = np.unique(names, return_index=True, return_inverse=True)
    first = first[which]
    again = np.flatnonzero((first != np.arange(len(at))))
    again = again[lengths[again] == lengths[first[again]]]
    result = np.arange(len(at))
    for own in _blocks(lengths[again]):
        mine = again[own]
        n = lengths[mine]
        same = codes[ranges(at[mine], n)] == codes[ranges(at[first[mine]], n)]
        alike = np.logical_and.reduceat(same, np.cumsum(n) - n)
        result[mine[alike]] = first[mine[alike]]
    return result


def _blocks(lengths: np.ndarray) -> Iterator[slice]:
    """Slices of runs that hold some BLOCK_WORDS words together; a longer run is a slice of its own."""
    sums, low = np.cumsum(lengths), 0
    while low < len(lengths):
        high = max(low + 1, int(np.searchsorted(sums, (int(sums[low - 1]) if low else 0) + BLOCK_WORDS, side="right")))
        yield slice(low, high)
        low = high


def _merge(group: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unite touching spans; input ordered by group and start, spans of equal excess over their windows."""
    if not len(group):
        return group, start, stop
    # Spans come from consecutive windows: both bounds rise, so a span joins the one before it if it starts within it.
    fresh = np.ones(len(group), bool)
    fresh[1:] = (group[1:] != group[:-1]) | (start[1:] > stop[:-1])
    heads = np.flatnonzero(fresh)
    return group[heads], start[heads], np.maximum.reduceat(stop, heads)


def _settle(table: pa.Table, width: int) -> pa.Table:
    """Sort the windows of a bucket and report every occurrence after the first."""
    ks, ties, starts, lengths, vocabularies, streams, known, parts = [], [], [], [], [], [], [], []
    base = 0
    for blob in (b.as_py() for b in table.column("blob")):
        k, tie, which, local, runs, size, stream, text, settled = unpack_arrays(
            blob, np.int64, np.int64, np.uint32, np.uint32, np.uint32, np.int64, np.uint8, bytes, np.int64
        )
        known.append(settled.reshape(-1, 4))
        if not len(runs):
            continue
        vocabulary = text.split(b" ")
        ks.append(k[which])
        ties.append(tie[which])
        starts.append(local.astype(np.int64))
        lengths.append(runs.astype(np.int64))
        stream = np.ascontiguousarray(stream.reshape(size[0], -1).T).view(np.uint16 if size[0] == 2 else np.uint32).ravel()
        streams.append(stream.astype(np.uint32) + np.uint32(base))
        base += len(vocabulary)
        vocabularies.append(pa.array(vocabulary, pa.binary()))
        parts.append(len(vocabulary))
    spans = [tuple(np.concatenate(known).T)] if known else []
    if ks:
        same = pa.chunked_array(vocabularies).combine_chunks().dictionary_encode().indices.to_numpy()
        streams = np.concatenate(streams)
        codes = same[streams]
        del streams, vocabularies, same
        spans.append(_repeats(np.concatenate(ks), np.concatenate(ties), np.concatenate(starts), np.concatenate(lengths), codes, width))
    if not spans:
        return pa.table({n: pa.array([], pa.int64()) for n in ("k", "tie", "start", "stop")})
    return pa.table({n: pa.array(np.concatenate([np.asarray(s[i], np.int64) for s in spans])) for i, n in enumerate(("k", "tie", "start", "stop"))})


def _repeats(k, tie, start, runs, codes, width):  # noqa: ANN001, ANN202
    edges = np.cumsum(runs + width - 1) - (runs + width - 1)
    by = np.lexsort((start, tie, k))
    k, tie, start, runs, edges = k[by], tie[by], start[by], runs[by], edges[by]
    fresh = np.ones(len(k), bool)
    fresh[1:] = (k[1:] != k[:-1]) | (tie[1:] != tie[:-1])
    docs = np.cumsum(fresh) - 1
    # Windows in the order of (document, start).
    where = ranges(edges, runs)
    doc, local = np.repeat(docs, runs), ranges(start, runs)
    hashes, at = np.zeros(len(where), np.uint64), 0
    for own in _blocks(runs + width - 1):
        n = runs[own] + width - 1
        new = rolling(mix(codes[ranges(edges[own], n)].astype(np.uint64) + SALT), width)[within(n, width)]
        hashes[at : at + len(new)] = new
        at += len(new)
    order = np.argsort(hashes, kind="stable")
    ordered = hashes[order]
    # Windows whose hash stands alone repeat nothing; what follows holds the others only.
    alike = np.zeros(len(order), bool)
    alike[1:] = ordered[1:] == ordered[:-1]
    alike[:-1] |= alike[1:]
    order, ordered = order[alike], ordered[alike]
    heads = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if len(ordered) else np.zeros(0, np.int64)
    head = order[np.repeat(heads, np.diff(np.append(heads, len(order))))]
    later = (doc[order] != doc[head]) | (local[order] != local[head])
    mine, first = order[later], head[later]
    exact = np.ones(len(mine), bool)
    for j in range(width):
        exact &= codes[where[mine] + j] == codes[where[first] + j]
    if not exact.all():
        # Different windows with one hash: settle those hashes by the words themselves.
        odd = np.isin(hashes, hashes[mine[~exact]])
        mine = mine[~np.isin(hashes[mine], hashes[mine[~exact]])]
        seen, extra = {}, []
        for i in np.flatnonzero(odd):
            name, place = codes[where[i] : where[i] + width].tobytes(), (doc[i], local[i])
            if seen.setdefault(name, place) != place:
                extra.append(i)
        mine = np.concatenate([mine, np.array(extra, np.int64)])
    mine = np.sort(mine)
    group, begin, stop = _merge(doc[mine], local[mine], local[mine] + width)
    lead = np.flatnonzero(fresh)
    return k[lead][group], tie[lead][group], begin, stop


def _cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in text_chunks(batches):
        texts, spans = table.column("text"), table.column("spans").to_pylist()
        n_words, n_removed, kept = [], [], []
        for text, own in zip(texts.to_pylist(), spans, strict=True):
            words = text.split()
            n_words.append(len(words))
            if own:
                stays = np.ones(len(words), bool)
                for span in own:
                    stays[span["start"] : span["stop"]] = False
                words = list(compress(words, stays.tolist()))
            n_removed.append(n_words[-1] - len(words))
            kept.append(b" ".join(words).decode())
        yield pa.record_batch(
            [table.column("id").combine_chunks(), texts.combine_chunks().cast(pa.string()), table.column("row").combine_chunks(), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())],
            ["id", "text", "row", "n_words", "n_removed", "kept"],
        )

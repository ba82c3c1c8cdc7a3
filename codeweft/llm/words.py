"""Words of whole texts as integer codes, and the array helpers that the text operators share.

A word is a run of bytes other than ASCII white space (``[^\\x20\\x09-\\x0D]+``), which is what ``bytes.split`` yields.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeweft.functions.memory import give_back

#: Text handled at once inside a task; a longer single text is its own chunk.
CHUNK_BYTES = 6 << 20
PART_BYTES = 32 << 20
#: Words that are Python objects at once; as Arrow arrays they take a fifth of that.
LISTED_WORDS = 1 << 17
LAST_ID = (1 << 63) - 1
ODD = np.uint64(0x9E3779B97F4A7C15)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: For bytes.translate: A-Z become a-z, all else stays.
LOWER_BYTES = bytes.maketrans(UPPER.encode(), LOWER.encode())


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def training(key: Column, parts: int) -> Column:
    """Whether a row belongs to the training part: crc32 of its id as text, modulo ``parts``, is not 0. Null ids count as ''."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % parts != 0


def keyed(docs: DataFrame, id_col: str, text_col: str, row: Column | None = None) -> DataFrame:
    """``(id, k, tie, text)`` and ``row``, if given: ``(k, tie)`` orders documents by id (null last), then by a hash of the text.

    Rows that share id and text share the key and are one document; a null text is empty.
    """
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    key = docs[id_col].cast("long")
    return docs.select(key.alias("id"), F.coalesce(key, F.lit(LAST_ID)).alias("k"), F.xxhash64(text).alias("tie"), text.alias("text"), *([] if row is None else [row.alias("row")]))


def kept_names(docs: DataFrame, *added: str) -> list[str]:
    """The columns of ``docs`` but for those whose name a result adds: these are replaced."""
    return [c for c in docs.columns if c.lower() not in added]


def text_bytes(rows: DataFrame) -> int:
    return rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def gathered(df: DataFrame, size: int) -> DataFrame:
    """``df``, which holds about ``size`` bytes of text, in partitions of some PART_BYTES, but four per core at least.

    A result then has files of that size; with many tiny ones, most work would be opening them. To be called before a step
    in Python, not after one: merged tasks would keep the buffers of every one of its inputs.
    """
    return df.coalesce(max(4 * df.sparkSession.sparkContext.defaultParallelism, -(-size // PART_BYTES)))


def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``batches`` of a task; at their end ``give_back``."""
    yield from batches
    give_back()


def lean_group(run: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """``run`` on a group; ``give_back`` after each one of some size."""

    def own(table: pa.Table) -> pa.Table:
        result, large = run(table), table.nbytes >= 1 << 20
        if large:
            give_back()
        return result

    return own


def text_chunks(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.Table]:
    """Regroup Arrow batches into tables of about ``limit`` bytes of ``column`` (binary afterwards)."""
    kept, size = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        at = batch.schema.get_field_index(column)
        sizes = np.cumsum(pa.compute.binary_length(batch.column(at)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            before = int(sizes[start - 1]) if start else 0
            stop = max(start + 1, int(np.searchsorted(sizes, before + limit - size, side="right")))
            kept.append(batch.slice(start, stop - start))
            size += int(sizes[stop - 1]) - before
            start = stop
            if size >= limit or start < batch.num_rows:
                yield _binary(kept, column)
                kept, size = [], 0
    if kept:
        yield _binary(kept, column)


def _binary(kept: list[pa.RecordBatch], column: str) -> pa.Table:
    table = pa.Table.from_batches(kept)
    at = table.schema.get_field_index(column)
    return table.set_column(at, column, table.column(at).cast(pa.binary()))


def encode_words(texts: Iterable[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Codes of all words in order, the number of words of each text, and the distinct words by code."""
    pieces, words, counts = [], [], []
    for text in texts:
        own = text.split()
        counts.append(len(own))
        words.extend(own)
        if len(words) >= LISTED_WORDS:
            pieces.append(pa.array(words, pa.binary()))
            words = []
    pieces.append(pa.array(words, pa.binary()))
    coded = pa.chunked_array(pieces).combine_chunks().dictionary_encode()
    return coded.indices.to_numpy(), np.array(counts, np.int64), coded.dictionary.to_pylist()


def word_hashes(vocabulary: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, vocabulary), np.uint64, len(vocabulary))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rolling(values: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` consecutive values."""
    n = max(0, len(values) - width + 1)
    out = np.zeros(n, np.uint64)
    for j in range(width):
        out *= ODD
        out += values[j : j + n]
    return mix(out)


def within(counts: np.ndarray, width: int) -> np.ndarray:
    """Start positions, in the concatenated texts, of the runs of ``width`` words that lie in one text."""
    fits = np.maximum(counts - width + 1, 0)
    first = np.cumsum(counts) - counts
    return np.repeat(first - (np.cumsum(fits) - fits), fits) + np.arange(int(fits.sum()))


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """``start .. start + length - 1`` of every pair, one after the other."""
    lengths = lengths.astype(np.int64)
    return np.repeat(starts.astype(np.int64) - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))


def pack_arrays(*arrays: np.ndarray | bytes) -> bytes:
    """Arrays and byte strings as one compressed blob."""
    parts = [a if isinstance(a, bytes) else np.ascontiguousarray(a).tobytes() for a in arrays]
    head = struct.pack(f"<{len(parts) + 1}q", len(parts), *map(len, parts))
    return zstandard.ZstdCompressor(level=3).compress(head + b"".join(parts))


def unpack_arrays(blob: bytes, *dtypes) -> list:
    """What ``pack_arrays`` packed; dtype ``bytes`` gives a byte string."""
    data = zstandard.ZstdDecompressor().decompress(blob)
    count = struct.unpack_from("<q", data)[0]
    sizes, at, out = struct.unpack_from(f"<{count}q", data, 8), 8 * (count + 1), []
    for size, dtype in zip(sizes, dtypes, strict=True):
        part = data[at : at + size]
        out.append(part if dtype is bytes else np.frombuffer(part, dtype))
        at += size
    return out

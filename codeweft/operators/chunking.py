"""Splitting texts into overlapping chunks, and numbering chunks across a repository."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeweft.functions.text import strip
from codeweft.session import cut

CHUNK_SIZE = 700
CHUNK_OVERLAP = 80

WORD = r"\S+"
# A sentence with the blanks that follow it, or the unfinished rest of the text.
SENTENCE = r"[^.!?。！？\n]*[.!?。！？\n]+\s*|[^.!?。！？\n]+"


def _count_words(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)))


def token_windows(documents: DataFrame, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """Fixed windows over whitespace tokens: window i starts at token i * (size - overlap). Adds position and text."""
    step = size - overlap
    tokens = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(WORD), F.lit(0))
    with_tokens = documents.withColumn("tokens", tokens).where(F.size("tokens") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("tokens") - F.lit(overlap + 1), F.lit(0)), F.lit(step))
    windows = F.transform(starts, lambda start: F.array_join(F.slice(F.col("tokens"), start + 1, F.lit(size)), " "))
    rest = [c for c in documents.columns if c != "text"]
    return with_tokens.select(*rest, F.posexplode(windows).alias("position", "text"))


def _pack(sizes: list[int], size: int, overlap: int) -> list[tuple[int, int]]:
    """Greedy packing of consecutive units into ranges [start, end); a new range re-reads up to ``overlap`` tokens."""
    ranges, start, total = [], 0, 0
    for i, tokens in enumerate(sizes):
        if total and total + tokens > size:
            ranges.append((start, i))
            start, total = i, 0
            while start > ranges[-1][0] + 1 and total + sizes[start - 1] <= overlap and total + sizes[start - 1] + tokens <= size:
                start -= 1
                total += sizes[start]
        total += tokens
    if sizes:
        ranges.append((start, len(sizes)))
    return ranges


def _packer(size: int, overlap: int):
    range_type = T.StructType([T.StructField("first", T.IntegerType()), T.StructField("count", T.IntegerType())])

    @F.pandas_udf(T.ArrayType(range_type))
    def pack(sizes: pd.Series) -> pd.Series:
        return sizes.map(lambda row: [{"first": a + 1, "count": b - a} for a, b in _pack(list(row), size, overlap)])

    return pack


def sentence_chunks(documents: DataFrame, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """Whole sentences packed into chunks of at most ``size`` words, each repeating up to ``overlap`` words of the last.

    Sentences longer than a chunk are packed word by word. Only unit sizes visit Python; the text stays in the JVM.
    """
    sentences = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(SENTENCE), F.lit(0))
    words = F.lit(r"\s*\S+\s*")
    units = F.flatten(
        F.transform(sentences, lambda s: F.when(_count_words(s) > size, F.regexp_extract_all(s, words, F.lit(0))).otherwise(F.array(s)))
    )
    rest = [c for c in documents.columns if c != "text"]
    measured = documents.withColumn("units", units).withColumn("sizes", F.transform("units", _count_words))
    packed = measured.withColumn("ranges", _packer(size, overlap)("sizes"))
    texts = F.transform("ranges", lambda r: strip(F.array_join(F.slice(F.col("units"), r["first"], r["count"]), "")))
    kept = F.filter(texts, lambda chunk: chunk != "")
    return packed.select(*rest, F.posexplode(kept).alias("position", "text"))


def number_rows(rows: DataFrame, order: list[str], group: str = "repo_id", count: str | None = None) -> DataFrame:
    """Dense ordinals from 0 within ``group`` along ``order`` without a task that owns a whole group.

    Rows are range-partitioned by (group, order) and materialised, so a large group spans many partitions. Per-partition
    totals, one row per (group, partition), give each partition its offset. With ``count``, a row stands for that many
    items and receives the ordinal of its first.
    """
    weight = F.lit(1) if count is None else F.col(count)
    placed = cut(rows.repartitionByRange(group, *order).withColumn("_part", F.spark_partition_id()))
    totals = placed.groupBy(group, "_part").agg(F.sum(weight).alias("_total"))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(group, "_part", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(group, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    numbered = placed.withColumn("_inside", F.coalesce(F.sum(weight).over(inside), F.lit(0)))
    # At most one offset row per (group, partition): partitions plus groups in all.
    return numbered.join(offsets, [group, "_part"]).withColumn("ordinal", F.col("_offset") + F.col("_inside")).drop(
        "_part", "_inside", "_offset"
    )


def number_chunks(chunks: DataFrame) -> DataFrame:
    """chunk_idx counts a repo's chunks in document order from 0; chunk_id is ``<repo>-chunk-<idx>``.

    ``chunks(repo_id, file_path, position, ...)``. Only per-file counts are ordered globally.
    """
    files = chunks.groupBy("repo_id", "file_path").agg(F.count(F.lit(1)).alias("n"))
    starts = number_rows(files, ["file_path"], count="n").select("repo_id", "file_path", F.col("ordinal").alias("start"))
    idx = F.col("start") + F.col("position")
    return (
        chunks.join(starts, ["repo_id", "file_path"])
        .withColumn("chunk_idx", idx)
        .withColumn("chunk_id", F.concat(F.col("repo_id"), F.lit("-chunk-"), idx.cast("string")))
        .drop("start")
    )


def chunks_by_file(chunks: DataFrame) -> DataFrame:
    """Chunk texts of each file in order, as one array."""
    ordered = F.sort_array(F.collect_list(F.struct("position", "text")))
    return chunks.groupBy("repo_id", "file_path").agg(F.transform(ordered, lambda c: c["text"]).alias("texts"))


def first_chunks(chunks: DataFrame, n: int = 2) -> DataFrame:
    """First ``n`` chunk texts of each file; later chunks are dropped before the shuffle, they cannot be among them."""
    return chunks_by_file(chunks.where(F.col("position") < n))

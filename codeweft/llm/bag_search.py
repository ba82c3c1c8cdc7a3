"""Ranked lexical search for a table of items, scoring every distinct bag of words once.

A document is restricted to the items' vocabulary as it is read: what is left is a vector of term frequencies and the length
factor ``m``, which is all that a score depends on. Documents are hashed by both, and rows of equal hash, vector and ``m`` are one
class: a window trims its members to the ``k`` smallest ids inside each task, as a ranking of ``k`` documents with ties by
ascending id can hold no others. Classes, dealt to shards, meet blocks of items in a co-grouped shuffle, both bounded by the
number of entries they hold; scores are 64-bit integers, summed term by term over tiles of items and classes, and each group
keeps ``k`` classes per item. The members of these are then expanded and ranked.

The vocabulary travels by broadcast if it measures small; otherwise terms and vocabulary are joined, hot terms salted.

Defined results: terms are maximal runs of digits, letters and non-ASCII characters, A-Z lower-cased; a null text has none.
Documents without an id count in the statistics, but are no result. Rows repeating a document id are documents of their own; rows
repeating an item id are one item with the terms of them all; items without an id or without a known term have no result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeweft.llm.words import LOWER, UPPER, ascii_lower, text_chunks
from codeweft.operators.joins import HOT_ROWS, hot_keys, spread_join
from codeweft.session import BROADCAST_BYTES, cut, measured_bytes

# Fixed value: a term.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Items' terms in a block, terms of classes in a shard, and item-class scores held at once.
BLOCK_ENTRIES = 500_000
SHARD_ENTRIES = 4_000_000
TILE_CELLS = 1 << 20
#: Turns bytes that belong to no term into spaces and A-Z into a-z.
_PLAIN = bytes(
    b if chr(b).isdigit() or chr(b) in LOWER or b > 127 else ord(LOWER[UPPER.index(chr(b))]) if chr(b) in UPPER else 32 for b in range(256)
)


def search(docs: DataFrame, items: DataFrame, k: int = 10, doc_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text",
           limit: int = BROADCAST_BYTES, block_entries: int = BLOCK_ENTRIES, shard_entries: int = SHARD_ENTRIES) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best documents of each item with a score above 0, ties by ascending id."""
    asked = cut(item_terms(items, item_col, text_col))
    words = cut(asked.select("term").distinct()).withColumn("code", F.monotonically_increasing_id())
    bags = cut(restricted(docs, cut(words), doc_col, text_col, limit))
    n_docs, n_terms = bags.agg(F.count(F.when(F.col("n") > 0, 1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    found = bags.select(F.explode("terms").alias("code")).groupBy("code").agg(F.count("*").alias("df"))
    weight = F.floor(1000 * F.log((2.0 * n_docs + 2) / (2 * F.col("df") + 1)))
    weighed = words.join(found, "code").select("term", "code", weight.alias("w"))
    terms = cut(asked.join(weighed, "term").select("item", "code", (F.col("times") * F.col("w")).alias("weight")))
    m = F.expr(f"25 + (75 * n * {n_docs}L) div {max(1, n_terms)}L")
    classes = cut(classes_of(bags.filter("id IS NOT NULL AND size(terms) > 0").select("id", m.alias("m"), "terms", "tfs"), k))

    cores = docs.sparkSession.sparkContext.defaultParallelism
    entries, rows = classes.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0)), F.count("*")).first()
    shards = max(1, -(-entries // shard_entries), min(2 * cores, rows // 1_000))
    blocks = max(1, -(-terms.count() // block_entries))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = terms.select(F.pmod(F.hash("item"), F.lit(blocks)).alias("block"), every(shards).alias("shard"), "item", "code", "weight")
    right = classes.select(every(blocks).alias("block"), F.pmod(F.col("h"), F.lit(shards)).cast("int").alias("shard"), "m", "terms", "tfs", "members")
    by = ["block", "shard"]
    best = left.groupBy(by).cogroup(right.groupBy(by)).applyInArrow(lambda i, c: _best_classes(i, c, k), f"item {terms.schema['item'].dataType.simpleString()}, score long, members array<long>")
    order = Window.partitionBy("item").orderBy(F.desc("score"), "doc")
    ranked = best.select("item", "score", F.explode("members").alias("doc")).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select(F.col("item").alias("item_id"), "rank", F.col("doc").alias("doc_id"), "score")


def item_terms(items: DataFrame, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``item, term, times`` of every item."""
    terms = F.regexp_extract_all(ascii_lower(items[text_col].cast("string")), F.lit(TERM), F.lit(0))
    each = items.select(items[item_col].alias("item"), F.explode(terms).alias("term"))
    return each.filter("item IS NOT NULL").groupBy("item", "term").agg(F.count("*").alias("times"))


def restricted(docs: DataFrame, words: DataFrame, doc_col: str, text_col: str, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``id, n, terms, tfs``: a document's id, number of terms, and the codes of those in ``words(term, code)``, ascending, with
    their frequencies."""
    texts = docs.select(docs[doc_col].cast("long").alias("id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    kinds = "terms array<{}>, tfs array<long>"
    if measured_bytes(words) <= limit:
        shared = docs.sparkSession.sparkContext.broadcast(words.select(F.encode("term", "utf-8").alias("term"), "code").orderBy("code").toArrow())

        def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            return _bags(batches, shared.value)

        return texts.mapInArrow(known, "id long, n long, " + kinds.format("long"))
    # A number per row, since ids may repeat; the terms of all documents become a table of rows that meet the vocabulary.
    spelled = cut(texts.mapInArrow(_bags, "id long, n long, " + kinds.format("binary")).withColumn("nth", F.monotonically_increasing_id()))
    each = spelled.select("nth", F.explode(F.arrays_zip("terms", "tfs")).alias("t")).select("nth", F.decode("t.terms", "utf-8").alias("term"), F.col("t.tfs").alias("tf"))
    met = spread_join(each, words, ["term"], hot_keys(each, ["term"], HOT_ROWS), ["nth"])
    pairs = met.groupBy("nth").agg(F.sort_array(F.collect_list(F.struct("code", "tf"))).alias("bag"))
    empty = F.array().cast("array<struct<code:bigint,tf:bigint>>")
    whole = spelled.select("nth", "id", "n").join(pairs, "nth", "left").withColumn("bag", F.coalesce("bag", empty))
    return whole.select("id", "n", F.col("bag.code").alias("terms"), F.col("bag.tf").alias("tfs"))


def classes_of(bags: DataFrame, k: int) -> DataFrame:
    """``h, m, terms, tfs, members`` of ``bags(id, m, terms, tfs)``: one row per distinct bag, with its ``k`` smallest ids.

    Rows meet by their hash, and by all they hold, so that a collision of hashes separates.
    """
    same = ["h", "m", "terms", "tfs"]
    hashed = bags.withColumn("h", F.xxhash64("m", "terms", "tfs"))
    first: Column = F.row_number().over(Window.partitionBy(same).orderBy("id"))
    return hashed.withColumn("nth", first).filter(F.col("nth") <= k).groupBy(same).agg(F.sort_array(F.collect_list("id")).alias("members"))


def _bags(batches: Iterator[pa.RecordBatch], words: pa.Table | None = None) -> Iterator[pa.RecordBatch]:
    """Bags of whole texts. ``words(term, code)`` restricts and codes the terms, else they are given as they are spelled."""
    codes = None if words is None else words["code"].to_numpy()
    for rows in text_chunks(batches):
        spelled, counts = [], []
        for text in rows["text"].to_pylist():
            own = text.translate(_PLAIN).split()
            counts.append(len(own))
            spelled.extend(own)
        coded = pa.array(spelled, pa.binary()).dictionary_encode()
        term, doc = coded.indices.to_numpy(), np.repeat(np.arange(len(counts)), counts)
        if words is not None:
            at = pc.index_in(coded.dictionary, value_set=words["term"]).fill_null(-1).to_numpy()[term]
            term, doc = at[at >= 0], doc[at >= 0]
        width = max(1, len(coded.dictionary) if words is None else len(words))
        pairs, tfs = np.unique(doc * width + term, return_counts=True)
        offsets = pa.array(np.searchsorted(pairs // width, np.arange(len(counts) + 1)).astype(np.int32))
        terms = coded.dictionary.take(pa.array(pairs % width)) if words is None else pa.array(codes[pairs % width], pa.int64())
        lists = pa.ListArray.from_arrays(offsets, terms), pa.ListArray.from_arrays(offsets, pa.array(tfs, pa.int64()))
        yield pa.record_batch([rows["id"].combine_chunks(), pa.array(counts, pa.int64()), *lists], ["id", "n", "terms", "tfs"])


def _best_classes(items: pa.Table, classes: pa.Table, k: int) -> pa.Table:
    """The ``k`` best classes of every item, ties by the smallest member."""
    kind = items.schema.field("item").type
    if not items.num_rows or not classes.num_rows:
        return pa.table({"item": pa.array([], kind), "score": pa.array([], pa.int64()), "members": pa.array([], pa.list_(pa.int64()))})
    names = items["item"].combine_chunks().dictionary_encode()
    order = np.argsort(items["code"].to_numpy(), kind="stable")
    item, weight = names.indices.to_numpy()[order], items["weight"].to_numpy()[order]
    codes, starts = np.unique(items["code"].to_numpy()[order], return_index=True)
    starts = np.append(starts, len(order))
    # In the order of their smallest members, so that of equal scores the column further left is the better one.
    lowest = pc.list_element(classes["members"], 0).to_numpy()
    classes = classes.take(pa.array(np.argsort(lowest, kind="stable")))
    wide = max(1, TILE_CELLS // len(names.dictionary))
    kept_item, kept_class, kept_score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    floor = np.zeros(len(names.dictionary), np.int64)
    for low in range(0, classes.num_rows, wide):
        part = classes.slice(low, wide).combine_chunks()
        scores = _tile(part, len(names.dictionary), codes, starts, item, weight)
        bound = floor + 1
        if scores.shape[1] > k:
            bound = np.maximum(bound, np.partition(scores, -k, axis=1)[:, -k])
        i, c = np.nonzero(scores >= bound[:, None])
        kept_item, kept_class = np.concatenate([kept_item, i]), np.concatenate([kept_class, low + c])
        kept_score = np.concatenate([kept_score, scores[i, c]])
        order = np.lexsort((kept_class, -kept_score, kept_item))
        heads = np.searchsorted(kept_item[order], kept_item[order])
        order = order[np.arange(len(order)) - heads < k]
        kept_item, kept_class, kept_score = kept_item[order], kept_class[order], kept_score[order]
        # An item with k classes wants a higher score of later ones: of equal ones, those are on the right.
        full = np.flatnonzero(np.bincount(kept_item, minlength=len(floor)) == k)
        floor[full] = kept_score[np.searchsorted(kept_item, full, side="right") - 1]
    members = classes["members"].combine_chunks().take(pa.array(kept_class))
    return pa.table({"item": names.dictionary.take(pa.array(kept_item)), "score": pa.array(kept_score, pa.int64()), "members": members})


def _tile(classes: pa.Table, n_items: int, codes: np.ndarray, starts: np.ndarray, item: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """``scores[item, class]``, term by term."""
    lists = classes["terms"].combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy())
    term = lists.flatten().to_numpy()
    at = np.minimum(np.searchsorted(codes, term), len(codes) - 1)
    hit = codes[at] == term
    at, column = at[hit], np.repeat(np.arange(len(sizes)), sizes)[hit]
    tf = classes["tfs"].combine_chunks().flatten().to_numpy()[hit]
    gain = 1_000_000_000 * tf // (1000 * tf + 8 * classes["m"].to_numpy()[column])
    order = np.argsort(at, kind="stable")
    at, column, gain = at[order], column[order], gain[order]
    scores = np.zeros((n_items, len(sizes)), np.int64)
    edges = np.flatnonzero(np.diff(at, prepend=-1, append=len(codes))).tolist()
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        own = slice(starts[at[a]], starts[at[a] + 1])
        scores[item[own][:, None], column[a:b]] += weight[own][:, None] * gain[a:b]
    return scores

"""BM25 keyword search over block-max inverted lists held as plain tables.

``postings(repo_id, id, n_tokens, terms, tfs)`` has one row per document; ``term_stats(repo_id, term, df, idf, avg_len)`` one per
term. ``lists`` has one row per segment, some documents of a repo ordered by length: every term's documents with their gains,
cut at blocks of BLOCK_DOCS neighbours, and the highest gain of each block, of each term (``tops``) and nothing else of the texts.

A search is driven by bounds. Of every asked term the highest gains per segment are read first (two columns of ``lists``): the
k-th of them bounds a query's k-th score from below, their sum a segment from above, and segments that no query can use are not
read. Inside a segment the sum of block maxima bounds the blocks; blocks are scored from the highest bound down until the bound
falls below the k-th score found so far. Results are those of scoring everything.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeweft.functions.memory import give_back
from codeweft.functions.text import search_tokens
from codeweft.operators.batch_search import TIE_DECIMALS, batch_search
from codeweft.session import BROADCAST_BYTES, LONG_ROWS_BYTES, broadcast_if_small, cut, spread

# Fixed values of the ranking function.
K1 = 1.5
B = 0.75
EPSILON = 0.25
#: Documents whose highest gain of a term is kept as one number.
BLOCK_DOCS = 64
#: Tokens whose numbers a task counts at once.
COUNTED_TOKENS = 250_000
#: Postings (12 bytes each) of a segment, and segments that meet one block of a large query batch.
SEGMENT_POSTINGS = 200_000
SHARD_SEGMENTS = 16
#: Up to so many segments the whole table is searched without looking at their bounds first.
FEW_SEGMENTS = 64
#: Blocks scored before the first look at the k-th score; each further step takes twice as many.
FIRST_BLOCKS = 4
# Bounds are sums in another order than scores, and equal scores are compared at nine decimals.
_SLACK = 1e-6


@dataclass
class KeywordIndex:
    postings: DataFrame
    term_stats: DataFrame
    lists: DataFrame


def postings(documents: DataFrame) -> DataFrame:
    """(repo_id, id, text) to one row per document with tokens: (repo_id, id, n_tokens, terms, tfs). A map; nothing shuffles."""
    tokens = spread(documents, "id").select("repo_id", "id", search_tokens(F.col("text")).alias("tokens"))
    kind = dict(documents.dtypes)["id"]
    return tokens.mapInArrow(_count_terms, f"repo_id string, id {kind}, n_tokens int, terms array<string>, tfs array<int>")


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        # Filtered here: as a condition of the plan, texts would be cut into tokens twice.
        batch = batch.filter(pc.greater(pc.list_value_length(batch.column(2)), 0))
        for piece in _pieces(batch, COUNTED_TOKENS):
            lists = piece.column(2)
            sizes = np.diff(lists.offsets.to_numpy())
            coded = lists.flatten().dictionary_encode()
            width = max(1, len(coded.dictionary))
            pairs, tf = np.unique(np.repeat(np.arange(len(sizes)), sizes) * width + coded.indices.to_numpy(), return_counts=True)
            offsets = np.searchsorted(pairs // width, np.arange(len(sizes) + 1)).astype(np.int32)
            terms = pa.ListArray.from_arrays(offsets, coded.dictionary.take(pa.array(pairs % width)))
            tfs = pa.ListArray.from_arrays(offsets, pa.array(tf.astype(np.int32)))
            yield pa.record_batch([piece.column(0), piece.column(1), pa.array(sizes.astype(np.int32)), terms, tfs], ["repo_id", "id", "n_tokens", "terms", "tfs"])
    give_back()


def _pieces(batch: pa.RecordBatch, tokens: int) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with at most so many tokens (a longer text is a run of its own), so arrays per token stay small."""
    ends = batch.column(2).offsets.to_numpy()[1:].astype(np.int64)
    low = 0
    while low < batch.num_rows:
        before = ends[low - 1] if low else batch.column(2).offsets[0].as_py()
        high = max(low + 1, int(np.searchsorted(ends, before + tokens, side="right")))
        yield batch.slice(low, high - low)
        low = high


def corpus_sizes(documents: DataFrame, index_postings: DataFrame) -> DataFrame:
    """(repo_id, n_docs, avg_len, held): documents without any token count for the size and the mean length."""
    counts = documents.groupBy("repo_id").agg(F.count(F.lit(1)).alias("n_docs"))
    sums = index_postings.groupBy("repo_id").agg(F.sum("n_tokens").alias("n_tokens"), F.sum(F.size("terms")).alias("held"))
    return counts.join(sums, "repo_id").select("repo_id", "n_docs", (F.col("n_tokens") / F.col("n_docs")).alias("avg_len"), "held")


def term_stats(lists: DataFrame, corpus: DataFrame) -> DataFrame:
    """Document frequency and idf per term; a negative idf becomes a quarter of the vocabulary's mean idf.

    Frequencies are sums of those of the segments, one row per term and segment.
    """
    each = lists.select("repo_id", "dfs", F.posexplode("terms").alias("at", "term")).select("repo_id", "term", F.get("dfs", "at").alias("df"))
    vocabulary = cut(each.groupBy("repo_id", "term").agg(F.sum("df").alias("df")))
    raw_idf = F.log(F.col("n_docs") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    # One row per repo on the right of both joins.
    raw = vocabulary.join(corpus, "repo_id").withColumn("raw_idf", raw_idf)
    mean = raw.groupBy("repo_id").agg(F.avg("raw_idf").alias("mean_idf"))
    floor = F.when(F.col("raw_idf") < 0, F.col("mean_idf") * EPSILON).otherwise(F.col("raw_idf"))
    return raw.join(mean, "repo_id").select("repo_id", "term", "df", floor.alias("idf"), "avg_len")


def inverted_lists(index_postings: DataFrame, corpus: DataFrame, segment_postings: int = SEGMENT_POSTINGS) -> DataFrame:
    """Block-max lists of the postings: one row per (repo_id, segment); a large repo is many segments, a small one is one."""
    cores = index_postings.sparkSession.sparkContext.defaultParallelism
    few = F.least(F.lit(cores), F.floor(F.col("n_docs") / 500))
    parts = F.greatest(F.ceil(F.col("held") / segment_postings), few, F.lit(1)).cast("int").alias("parts")
    # One row per repo.
    dealt = index_postings.join(broadcast_if_small(corpus.select("repo_id", "avg_len", parts)), "repo_id")
    dealt = dealt.withColumn("segment", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).drop("parts")
    kind = dict(index_postings.dtypes)["id"]
    schema = (
        f"repo_id string, segment int, ids array<{kind}>, terms array<string>, dfs array<int>, tops array<double>, starts array<int>, "
        "blocks array<int>, block_tops array<double>, spans array<int>, slots array<int>, gains array<double>"
    )
    return dealt.groupBy("repo_id", "segment").applyInArrow(_invert, schema)


def _invert(rows: pa.Table) -> pa.Table:
    """``starts`` cuts the blocks by term, ``spans`` the slots and gains by block; slots number the documents by length."""
    rows = rows.sort_by([("n_tokens", "ascending"), ("id", "ascending")])
    lists = rows["terms"].combine_chunks()
    coded = lists.flatten().dictionary_encode()
    term, slot = coded.indices.to_numpy(), np.repeat(np.arange(rows.num_rows), np.diff(lists.offsets.to_numpy()))
    tf, length = rows["tfs"].combine_chunks().flatten().to_numpy().astype(float), rows["n_tokens"].to_numpy()[slot]
    gain = tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / rows["avg_len"][0].as_py()))
    order = np.lexsort((slot, term))
    term, slot, gain = term[order], slot[order], gain[order]
    block = slot // BLOCK_DOCS
    spans = np.flatnonzero((np.diff(term, prepend=-1) != 0) | (np.diff(block, prepend=-1) != 0))
    block_tops = np.maximum.reduceat(gain, spans)
    starts = np.searchsorted(term[spans], np.arange(len(coded.dictionary) + 1))
    tops = np.maximum.reduceat(block_tops, starts[:-1])
    one = lambda values, kind: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, kind) if isinstance(values, np.ndarray) else values)
    ints, floats = pa.int32(), pa.float64()
    spans = np.append(spans, len(slot))
    dfs = np.bincount(term, minlength=len(coded.dictionary))
    columns = [rows["repo_id"][:1].combine_chunks(), rows["segment"][:1].combine_chunks(), one(rows["id"].combine_chunks(), None), one(coded.dictionary, None), one(dfs, ints), one(tops, floats), one(starts, ints)]
    columns += [one(block[spans[:-1]], ints), one(block_tops, floats), one(spans, ints), one(slot, ints), one(gain, floats)]
    return pa.table(columns, ["repo_id", "segment", "ids", "terms", "dfs", "tops", "starts", "blocks", "block_tops", "spans", "slots", "gains"])


def build_keyword_index(documents: DataFrame) -> KeywordIndex:
    """Index tables of (repo_id, id, text), kept in the checkpoint folder: statistics and searches read them."""
    return index_of(documents, cut(postings(documents), LONG_ROWS_BYTES))


def index_of(documents: DataFrame, table: DataFrame) -> KeywordIndex:
    """Index of documents (of which only ``repo_id`` is read) whose postings are the stored ``table``."""
    corpus = cut(corpus_sizes(documents, table))
    lists = cut(inverted_lists(table, corpus), LONG_ROWS_BYTES)
    return KeywordIndex(postings=table, term_stats=term_stats(lists, corpus), lists=lists)


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, repo_id, query) to one row per distinct query token with its repetition count."""
    return (
        queries.select("query_id", "repo_id", F.explode(search_tokens(F.col("query"))).alias("term"))
        .groupBy("query_id", "repo_id", "term")
        .agg(F.count(F.lit(1)).alias("qtf"))
    )


def query_weights(index: KeywordIndex, queries: DataFrame) -> DataFrame:
    """(query_id, repo_id, term, weight, avg_len) of every query term that the index knows."""
    terms = query_terms(queries)
    asked = broadcast_if_small(terms)
    return index.term_stats.join(asked, ["repo_id", "term"]).select("query_id", "repo_id", "term", (F.col("qtf") * F.col("idf")).alias("weight"), "avg_len")


def same_searches(weights: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The weights of the smallest query of every set of equal searches, and (first, repo_id, query_id) of all queries."""
    terms = F.sort_array(F.collect_list(F.struct("term", "weight")))
    bags = weights.groupBy("query_id", "repo_id").agg(F.sha2(F.to_json(terms), 256).alias("bag"))
    firsts = bags.groupBy("repo_id", "bag").agg(F.min("query_id").alias("first"))
    alike = cut(bags.join(firsts, ["repo_id", "bag"]).select("first", "repo_id", "query_id"))
    chosen = alike.where(F.col("first") == F.col("query_id")).select("query_id", "repo_id")
    return cut(weights.join(chosen, ["query_id", "repo_id"], "left_semi")), alike


class _BestDocuments:
    """Best k documents per query, found block by block from the highest bound down."""

    def __init__(self, asked: pa.Table, k: int) -> None:
        self.k, self.query_type, self.id_type, self.repos = k, asked.schema.field("query_id").type, pa.null(), {}
        #: (query, document) pairs that were scored.
        self.scored = 0
        names = np.asarray(asked["repo_id"].to_pylist(), dtype=object)
        for repo in set(names):
            own = asked.filter(pa.array(names == repo)).sort_by("query_id")
            queries = own["query_id"].combine_chunks().dictionary_encode()
            terms = own["term"].combine_chunks().dictionary_encode()
            weights, which = own["weight"].to_numpy(), terms.indices.to_numpy()
            cuts = np.searchsorted(queries.indices.to_numpy(), np.arange(len(queries.dictionary) + 1))
            floors = own["floor"].to_numpy()[cuts[:-1]]
            searches = [
                {"query": q, "term": which[a:b], "weight": weights[a:b], "floor": f, "best": []}
                for q, a, b, f in zip(queries.dictionary.to_pylist(), cuts[:-1], cuts[1:], floors, strict=True)
            ]
            self.repos[repo] = (terms.dictionary, searches)

    def add(self, rows: pa.Table) -> None:
        self.id_type = rows.schema.field("ids").type.value_type
        for i in range(rows.num_rows):
            repo = rows["repo_id"][i].as_py()
            if repo in self.repos:
                vocabulary, searches = self.repos[repo]
                segment = _Segment(rows, i)
                at = pc.index_in(vocabulary, value_set=segment.terms).fill_null(-1).to_numpy()
                for search in searches:
                    self._search(segment, at[search["term"]], search)

    def _search(self, segment: _Segment, at: np.ndarray, search: dict) -> None:
        weight, at = search["weight"][at >= 0], at[at >= 0]
        if not len(at) or np.maximum(weight, 0) @ segment.tops[at] < search["floor"] - _SLACK:
            return
        counts = segment.starts[at + 1] - segment.starts[at]
        entry = _runs(segment.starts[at], counts)
        weight = np.repeat(weight, counts)
        bounds = np.bincount(segment.blocks[entry], np.maximum(weight, 0) * segment.block_tops[entry], minlength=segment.n_blocks)
        order, done, step = np.argsort(-bounds, kind="stable"), 0, FIRST_BLOCKS
        chosen = np.zeros(segment.n_blocks, bool)
        while done < len(order) and bounds[order[done]] > 0 and bounds[order[done]] >= search["floor"] - _SLACK:
            blocks = order[done : done + step]
            blocks = blocks[bounds[blocks] >= max(search["floor"] - _SLACK, np.finfo(float).tiny)]
            chosen[:] = False
            chosen[blocks] = True
            self._score(segment, entry, weight, chosen, search)
            done, step = done + step, 2 * step

    def _score(self, segment: _Segment, entry: np.ndarray, weight: np.ndarray, chosen: np.ndarray, search: dict) -> None:
        own = chosen[segment.blocks[entry]]
        entry, weight = entry[own], weight[own]
        sizes = segment.spans[entry + 1] - segment.spans[entry]
        posting = _runs(segment.spans[entry], sizes)
        slots = segment.slots[posting]
        found, place = np.unique(slots, return_inverse=True)
        scores = np.bincount(place, np.repeat(weight, sizes) * segment.gains[posting])
        self.scored += len(found)
        rounded = np.round(scores, TIE_DECIMALS)
        keep = np.flatnonzero((scores > 0) & (rounded >= search["floor"] - _SLACK))
        if len(keep) > self.k:
            least = -np.partition(-rounded[keep], self.k - 1)[self.k - 1]
            keep = keep[rounded[keep] >= least]
            keep = keep[np.lexsort((segment.order()[found[keep]], -rounded[keep]))[: self.k]]
        new = [(-rounded[i], segment.ids[found[i]].as_py(), scores[i]) for i in keep]
        search["best"] = sorted(search["best"] + new)[: self.k]
        if len(search["best"]) == self.k:
            search["floor"] = max(search["floor"], -search["best"][-1][0])

    def result(self) -> pa.Table:
        rows = [(s["query"], repo, id_, score) for repo, (_, searches) in self.repos.items() for s in searches for _, id_, score in s["best"]]
        kinds = [self.query_type, pa.string(), self.id_type, pa.float64()]
        columns = list(zip(*rows, strict=True)) or [[]] * 4
        return pa.table([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], ["query_id", "repo_id", "id", "score"])


class _Segment:
    """One row of the lists as arrays."""

    def __init__(self, rows: pa.Table, i: int) -> None:
        array = lambda name: rows[name][i].values.to_numpy()
        self.ids, self.terms = rows["ids"][i].values, rows["terms"][i].values
        self.tops, self.starts, self.blocks, self.block_tops = array("tops"), array("starts"), array("blocks"), array("block_tops")
        self.spans, self.slots, self.gains = array("spans"), array("slots"), array("gains")
        self.n_blocks = -(-len(self.ids) // BLOCK_DOCS)
        self._order = None

    def order(self) -> np.ndarray:
        """Place of every slot's id among the sorted ids."""
        if self._order is None:
            self._order = np.empty(len(self.ids), np.int64)
            self._order[pc.sort_indices(self.ids).to_numpy()] = np.arange(len(self.ids))
        return self._order


def _runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The positions of all runs ``starts[i] .. starts[i] + sizes[i] - 1``."""
    sizes = sizes.astype(np.int64)
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


def search_bounds(index: KeywordIndex, weights: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """``weights`` with ``floor``, what a query's k-th score is at least, and the (repo_id, segment) that some query can use.

    k segments hold k documents with their highest gains of a term; with no negative weight, the k-th of these gains times
    the weight is a score that k documents reach.
    """
    asked = broadcast_if_small(weights.select("repo_id", "term").distinct())
    tops = index.lists.select("repo_id", "segment", F.inline(F.arrays_zip("terms", "tops"))).withColumnRenamed("terms", "term")
    met = cut(tops.join(asked, ["repo_id", "term"]))
    nth = F.row_number().over(Window.partitionBy("repo_id", "term").orderBy(F.desc("tops")))
    kth = met.withColumn("nth", nth).where(F.col("nth") <= k).groupBy("repo_id", "term").agg(F.min("tops").alias("top"), F.max("nth").alias("n"))
    kth = kth.where(F.col("n") == k).select("repo_id", "term", "top")
    reached = weights.join(broadcast_if_small(kth), ["repo_id", "term"], "left").groupBy("query_id", "repo_id")
    floors = cut(reached.agg(F.when(F.min("weight") >= 0, F.max(F.col("weight") * F.col("top"))).alias("floor")).select("query_id", "repo_id", F.coalesce("floor", F.lit(0.0)).alias("floor")))
    with_floor = weights.join(broadcast_if_small(floors), ["query_id", "repo_id"])
    above = met.join(broadcast_if_small(with_floor), ["repo_id", "term"]).groupBy("query_id", "repo_id", "segment")
    usable = above.agg(F.sum(F.greatest(F.col("weight"), F.lit(0.0)) * F.col("tops")).alias("bound"), F.first("floor").alias("floor"))
    return with_floor, usable.where(F.col("bound") >= F.col("floor") - _SLACK).select("repo_id", "segment").distinct()


def top_k(scored: DataFrame, k: int, score: str = "score") -> DataFrame:
    """Best k rows per query with ranks from 1. Spark trims to k per task before the shuffle (window group limit)."""
    order = Window.partitionBy("query_id", "repo_id").orderBy(F.round(score, TIE_DECIMALS).desc(), F.col("id"))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def bm25_search(index: KeywordIndex, queries: DataFrame, k: int = 8, limit: int = BROADCAST_BYTES, few_segments: int = FEW_SEGMENTS) -> DataFrame:
    """Top k documents per query: (query_id, repo_id, id, score, rank). Scores of zero or less are dropped.

    Every task searches its segments for all queries and hands on k rows per query; no table of pairs is made. Queries that
    weigh the same known terms alike are searched once: texts that differ in words no document has are one search.
    """
    lists = index.lists
    weights, alike = same_searches(cut(query_weights(index, queries)))
    if lists.select("segment").count() <= few_segments:
        weights = weights.withColumn("floor", F.lit(0.0))
    else:
        weights, usable = search_bounds(index, weights, k)
        lists = lists.join(broadcast_if_small(usable), ["repo_id", "segment"], "left_semi")
    kinds = {**dict(weights.dtypes), **dict(lists.dtypes)}
    schema = f"query_id {kinds['query_id']}, repo_id string, id {kinds['ids'][6:-1]}, score double"
    found = batch_search(lists, "segment", weights, lambda asked: _BestDocuments(asked, k), schema, limit, SHARD_SEGMENTS)
    # Run here, as k rows per query and task, since a batch may hold few segments only: each has some megabytes.
    best = top_k(cut(found, LONG_ROWS_BYTES), k)
    return best.withColumnRenamed("query_id", "first").join(alike, ["first", "repo_id"]).select("query_id", "repo_id", "id", "score", "rank")

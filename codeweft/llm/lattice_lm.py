"""Language-model scores from subword lattices.

A word not covered by counts is spelled from the pieces of an existing subword vocabulary: all its segmentations are weighted by
unigram piece probabilities and summed by a forward recursion in log space. The vocabulary's own scores (ranks) are the prior
of these probabilities; expectation-maximisation over all distinct training words fits them. Words have discounted
counts whose freed mass backs off to the lattice. Both are kept for each group of training documents (by language, say), and the
probability of a text is the sum over groups: its group is as hidden as its segmentations.

The corpus is met three times: distinct words with counts per group are aggregated (a chunk's words once); every distinct word gets
its log probabilities once; then texts sum them. For the last step the ``FREQUENT`` most frequent words travel to the texts
(a bounded table); all other words of a chunk of texts travel to the hash bucket of the word with their places, and sums
come back, one packed row per chunk and bucket.

Defined results: null and empty texts are the end token alone; repeated rows each count and score; null ids are held out or not by
the checksum of the empty text; without training rows the piece prior alone spells all words.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweft.llm.words import LAST_ID, LOWER_BYTES, encode_words, mix, pack_arrays, text_chunks, training, unpack_arrays
from codeweft.session import cut

FREQUENT = 50_000
MOST_GROUPS = 8
ROUNDS = 3
#: Rare distinct words of one bucket; longest piece looked for; prior weight in pieces; mass of bytes for unknown characters.
BUCKET_WORDS = 300_000
LONGEST = 16
#: Words of a group that a task spells together; few at a time would spend most time between array operations.
WORDS_AT_ONCE = 50_000
PRIOR = 1_000.0
BYTES_MASS = 0.01
SLICE = 4_096
START = 0x2581
BASE = np.uint64(0x9E3779B97F4A7C15)


def score_texts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", group_col: str | None = None, parts: int = 10) -> DataFrame:
    """``id, held_out, n_tokens, n_known, train_tokens, base_score, score`` per row; scores are log10 probabilities.

    ``vocabulary`` is a sentencepiece model that every executor can read; ``group_col`` names the groups of training documents.
    """
    group = F.coalesce(docs[group_col].cast("string"), F.lit("")) if group_col else F.lit("")
    rows = docs.select(F.coalesce(docs[id_col].cast("long"), F.lit(LAST_ID)).alias("k"), training(docs[id_col].cast("long"), parts).alias("train"), group.alias("g"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    counted = rows.filter("train").groupBy("g").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "g").limit(MOST_GROUPS).collect()
    names = [r.g for r in counted] or [""]
    place = F.lit(len(names) - 1)
    for i, name in enumerate(names):
        place = F.when(F.col("g") == name, i).otherwise(place)
    rows = rows.select("k", "train", place.cast("int").alias("g"), "text")
    ends = {r.g: r.n for r in rows.filter("train").groupBy("g").agg(F.count("*").alias("n")).collect()}
    size = len(names)
    columns = [f"c{i}" for i in range(size)]
    found = rows.mapInArrow(lambda it: _count(it, size), "word binary, " + ", ".join(f"{c} long" for c in columns))
    words = cut(found.groupBy("word").agg(*[F.sum(c).alias(c) for c in columns]))
    model = _statistics(words, columns, [ends.get(i, 0) for i in range(size)])
    model["pieces"] = _fit_pieces(words, columns, vocabulary)
    return _scored(rows, words, columns, vocabulary, model)


def _count(batches: Iterable[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Distinct words of a chunk with their training counts per group (0 for words of held-out texts alone)."""
    for table in text_chunks(batches):
        codes, counts, vocabulary = encode_words(t.translate(LOWER_BYTES) for t in table.column("text").to_pylist())
        group = np.where(table.column("train").to_numpy(), table.column("g").to_numpy(), size)
        sums = np.bincount(codes.astype(np.int64) * (size + 1) + np.repeat(group, counts), minlength=len(vocabulary) * (size + 1)).reshape(-1, size + 1)
        yield pa.record_batch([pa.array(vocabulary, pa.binary()), *[pa.array(sums[:, i]) for i in range(size)]], ["word", *[f"c{i}" for i in range(size)]])


def _statistics(words: DataFrame, columns: list[str], ends: list[int]) -> dict:
    total = sum((F.col(c) for c in columns), F.lit(0))
    sums = [F.sum(F.when(total > 0, 1)).alias("types"), F.sum(total).alias("tokens"), F.count("*").alias("words")]
    for c in columns:
        sums += [F.sum(c).alias(f"{c}n"), F.sum((F.col(c) > 0).cast("long")).alias(f"{c}v"), F.sum((F.col(c) == 1).cast("long")).alias(f"{c}o"), F.sum((F.col(c) == 2).cast("long")).alias(f"{c}t")]
    row = words.agg(*sums).first().asDict()
    row = {k: int(v or 0) for k, v in row.items()}
    out = {"tokens": row["tokens"] + sum(ends), "types": row["types"] + (sum(ends) > 0), "ends": ends, "words": row["words"], "groups": []}
    for c, end in zip(columns, ends, strict=True):
        n, once, twice = row[f"{c}n"] + end, row[f"{c}o"], row[f"{c}t"]
        discount = min(0.95, once / (once + 2 * twice)) if once else 0.5
        out["groups"].append({"n": n, "discount": discount, "spare": discount * (row[f"{c}v"] + (end > 0)) / n if n else 1.0, "end": end})
    return out


class Pieces:
    """The vocabulary's pieces by hash, with prior probabilities from its scores."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = [i for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)) and model.get_score(i) > -1e8]
        texts = [model.id_to_piece(i) for i in ids]
        # Scores of merged pieces are negative ranks; a rank's probability falls with its inverse.
        prior = np.array([1.0 / (10.0 - model.get_score(i)) for i in ids])
        self.prior = (1 - BYTES_MASS) * prior / prior.sum()
        self.count = len(ids)
        hashes = np.array([self._hash(t) for t in texts], np.uint64)
        self.bits = 20
        self.slots, self.keys = np.full(1 << self.bits, -1, np.int32), hashes
        for i, at in enumerate(self._slot(hashes).tolist()):
            while self.slots[at] >= 0:
                at = (at + 1) % len(self.slots)
            self.slots[at] = i

    @staticmethod
    def _hash(text: str) -> int:
        h = 0
        for c in text:
            h = (h * int(BASE) + ord(c) + 1) % (1 << 64)
        return h

    def _slot(self, hashes: np.ndarray) -> np.ndarray:
        return (mix(hashes) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Piece numbers of substring hashes; ``count`` where there is none."""
        at = self._slot(hashes)
        out = np.full(hashes.shape, self.count, np.int32)
        flat, where, wanted = out.reshape(-1), np.arange(hashes.size), hashes.reshape(-1)
        at = at.reshape(-1)
        while len(where):
            slot = self.slots[at]
            true = slot >= 0
            where, at, slot = where[true], at[true], slot[true]
            hit = self.keys[slot] == wanted[where]
            flat[where[hit]] = slot[hit]
            where, at = where[~hit], (at[~hit] + 1) % len(self.slots)
        return out


class Lattice:
    """All segmentations of words of one length, for several piece distributions at once."""

    def __init__(self, pieces: Pieces, words: list[str]) -> None:
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), -1)
        codes = np.hstack([np.full((len(words), 1), START, np.uint32), codes])
        self.m, self.n = codes.shape
        prefix = np.zeros((self.m, self.n + 1), np.uint64)
        for j in range(self.n):
            prefix[:, j + 1] = prefix[:, j] * BASE + codes[:, j] + np.uint64(1)
        self.found, power = [], 1
        for length in range(1, min(LONGEST, self.n) + 1):
            power = power * int(BASE) % (1 << 64)
            self.found.append(pieces.find(prefix[:, length:] - prefix[:, :-length] * np.uint64(power)))
        width = np.ones(codes.shape, np.int64) + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000)
        self.spelled = width * np.log(BYTES_MASS / 256)
        self.none = pieces.count

    def _term(self, logs: np.ndarray, i: int, length: int) -> np.ndarray | None:
        own = self.found[length - 1][:, i]
        if length == 1:
            return np.where(own == self.none, self.spelled[:, i], logs[:, own])
        return logs[:, own] if (own != self.none).any() else None

    def forward(self, logs: np.ndarray, going: np.ndarray) -> np.ndarray:
        """``logs``: per distribution the log probability of each piece (and -inf last); ``going``: of not stopping."""
        out = np.full((len(logs), self.n + 1, self.m), -np.inf)
        out[:, 0] = 0
        for j in range(1, self.n + 1):
            terms = [out[:, j - k] + t + going for k in range(1, min(LONGEST, j) + 1) if (t := self._term(logs, j - k, k)) is not None]
            out[:, j] = _sum_logs(terms)
        return out

    def expected(self, logs: np.ndarray, going: np.ndarray, ending: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Expected uses of each piece over all segmentations, by distribution, with ``weight[distribution, word]``."""
        ahead = self.forward(logs, going)
        back = np.full(ahead.shape, -np.inf)
        back[:, self.n] = ending
        for i in range(self.n - 1, -1, -1):
            terms = [back[:, i + k] + t + going for k in range(1, min(LONGEST, self.n - i) + 1) if (t := self._term(logs, i, k)) is not None]
            back[:, i] = _sum_logs(terms)
        total = back[:, 0]
        counts = np.zeros((len(logs), self.none + 1))
        for i in range(self.n):
            for k in range(1, min(LONGEST, self.n - i) + 1):
                own = self.found[k - 1][:, i]
                if (own == self.none).all():
                    continue
                share = np.exp(ahead[:, i] + logs[:, own] + going + back[:, i + k] - total) * weight
                for d in range(len(logs)):
                    counts[d] += np.bincount(own, share[d], self.none + 1)
        return counts


def _sum_logs(terms: list[np.ndarray]) -> np.ndarray:
    if len(terms) == 1:
        return terms[0]
    stack = np.stack(terms)
    top = stack.max(axis=0)
    return top + np.log(np.exp(stack - top).sum(axis=0))


def by_length(words: list[bytes]) -> Iterator[tuple[np.ndarray, list[str]]]:
    """Positions and texts of words of one length, at most 2,048 (fewer if long) together."""
    texts = [w.decode() for w in words]
    sizes = np.array([len(t) for t in texts], np.int64)
    order = np.argsort(sizes, kind="stable")
    low = 0
    while low < len(order):
        size = int(sizes[order[low]])
        high = min(int(np.searchsorted(sizes[order], size, side="right")), low + max(1, min(2_048, 200_000 // (size + 1))))
        yield order[low:high], [texts[i] for i in order[low:high]]
        low = high


def _logs(probabilities: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.log(np.hstack([probabilities, np.zeros((len(probabilities), 1))]))


def _fit_pieces(words: DataFrame, columns: list[str], path: str) -> dict:
    """Expectation-maximisation over all training words of each group, once each: the lattice spells words not counted."""
    prior = Pieces(path).prior
    groups = len(columns)
    p, stop = np.tile(prior, (groups, 1)), np.full(groups, 0.2)
    known = words.filter(" or ".join(f"{c} > 0" for c in columns))
    for _ in range(ROUNDS):
        state = known.sparkSession.sparkContext.broadcast((p, stop))
        sums = known.mapInArrow(lambda it, state=state: _expect(it, columns, path, state), "d int, s int, sums binary")
        p, stop = prior * PRIOR + np.zeros((groups, 1)), np.zeros(groups)
        types = np.zeros(groups)
        for row in sums.groupBy("d", "s").applyInArrow(_add, "d int, s int, sums binary").collect():  # groups x pieces numbers
            part = np.frombuffer(row.sums)
            if row.s < 0:
                types[row.d] = part[0]
            else:
                p[row.d, row.s * SLICE : row.s * SLICE + len(part)] += part
        used = p.sum(axis=1)
        p *= (1 - BYTES_MASS) / used[:, None]
        stop = (types + 0.2 * PRIOR) / (types + used)
        state.unpersist()
    return {"p": p, "stop": stop}


def _add(table: pa.Table) -> pa.Table:
    total = np.sum([np.frombuffer(b) for b in table.column("sums").to_pylist()], axis=0)
    return pa.table({"d": table.column("d")[:1], "s": table.column("s")[:1], "sums": pa.array([total.tobytes()], pa.binary())})


def _expect(batches: Iterable[pa.RecordBatch], columns: list[str], path: str, state) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
    pieces, (p, stop) = Pieces(path), state.value
    counts, types = np.zeros((len(columns), pieces.count + 1)), np.zeros(len(columns))
    waiting: list[list[bytes]] = [[] for _ in columns]

    def fit(d: int) -> None:
        logs, going, ending = _logs(p[d : d + 1]), np.log1p(-stop[d]), np.log(stop[d])
        for _, texts in by_length(waiting[d]):
            counts[d] += Lattice(pieces, texts).expected(logs, going, ending, np.ones((1, len(texts))))[0]
        types[d] += len(waiting[d])
        waiting[d] = []

    for batch in batches:
        words = batch.column(batch.schema.get_field_index("word"))
        for d, column in enumerate(columns):
            seen = pa.array(batch.column(batch.schema.get_field_index(column)).to_numpy() > 0)
            waiting[d] += words.filter(seen).to_pylist()
            if len(waiting[d]) >= WORDS_AT_ONCE:
                fit(d)
    for d in range(len(columns)):
        fit(d)
    rows = [(d, s // SLICE, counts[d, s : min(s + SLICE, pieces.count)].tobytes()) for d in range(len(columns)) for s in range(0, pieces.count, SLICE)]
    rows += [(d, -1, types[d : d + 1].tobytes()) for d in range(len(columns))]
    yield pa.record_batch([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], ["d", "s", "sums"])


def spell(pieces: Pieces, words: list[bytes], p: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Natural log of each word's lattice probability, a row per distribution."""
    out = np.zeros((len(p), len(words)))
    logs, going, ending = _logs(p), np.log1p(-stop)[:, None], np.log(stop)[:, None]
    for at, texts in by_length(words):
        out[:, at] = Lattice(pieces, texts).forward(logs, going)[:, -1] + ending
    return out


def _word_scores(pieces: Pieces, words: list[bytes], counts: np.ndarray, model: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per word: the base's log10 probability, whether it was seen, and log10 probabilities by group."""
    total = counts.sum(axis=0)
    base = np.log10((total + 0.1) / (model["tokens"] + 0.1 * (model["types"] + 1)))
    spelled = spell(pieces, words, model["pieces"]["p"], model["pieces"]["stop"]) / np.log(10)
    logs = np.zeros(spelled.shape)
    for d, group in enumerate(model["groups"]):
        with np.errstate(divide="ignore"):
            seen = np.log10(np.maximum(counts[d] - group["discount"], 0) / group["n"]) if group["n"] else np.full(len(words), -np.inf)
            logs[d] = np.logaddexp(seen * np.log(10), (np.log10(group["spare"]) + spelled[d]) * np.log(10)) / np.log(10)
    return base, total > 0, logs


def _scored(rows: DataFrame, words: DataFrame, columns: list[str], path: str, model: dict) -> DataFrame:
    spark, size = rows.sparkSession, len(columns)
    buckets = max(1, -(-model["words"] // BUCKET_WORDS))
    shared = spark.sparkContext.broadcast(model)

    def table_of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(path)
        for batch in batches:
            own = batch.column(batch.schema.get_field_index("word")).to_pylist()
            counts = np.stack([batch.column(batch.schema.get_field_index(c)).to_numpy() for c in columns]).astype(float)
            base, known, logs = _word_scores(pieces, own, counts, shared.value)
            packed = np.vstack([base, known, logs]).T.copy()
            bucket = [xxhash.xxh64_intdigest(w) % buckets for w in own]
            total = counts.sum(axis=0).astype(np.int64)
            yield pa.record_batch([pa.array(own, pa.binary()), pa.array(bucket, pa.int64()), pa.array(total), pa.array([r.tobytes() for r in packed], pa.binary())], ["word", "bucket", "n", "packed"])

    table = cut(words.mapInArrow(table_of, "word binary, bucket long, n long, packed binary"))
    # FREQUENT rows at most reach the driver and the tasks.
    top = table.filter("n > 0").orderBy(F.desc("n"), "word").limit(FREQUENT).select("word", "packed").toArrow()
    frequent = spark.sparkContext.broadcast((top.column("word").to_pylist(), b"".join(top.column("packed").to_pylist())))
    dealt = cut(rows.mapInArrow(lambda it: _deal(it, size, buckets, frequent), "chunk long, bucket long, blob binary"))
    wanted = dealt.filter("bucket >= 0").groupBy("bucket")
    sums = wanted.cogroup(table.select("word", "bucket", "packed").groupBy("bucket")).applyInArrow(lambda b, t: _add_words(b, t, size), "chunk long, bucket long, blob binary")
    all_parts = dealt.filter("bucket < 0").unionByName(sums)
    schema = "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return all_parts.groupBy("chunk").applyInArrow(lambda t: _finish(t, size, shared), schema)


def _deal(batches: Iterable[pa.RecordBatch], size: int, buckets: int, frequent) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
    words, packed = frequent.value
    values = np.frombuffer(packed).reshape(-1, size + 2)
    place = {w: i for i, w in enumerate(words)}
    chunk = TaskContext.get().partitionId() << 32
    for table in text_chunks(batches):
        codes, counts, vocabulary = encode_words(t.translate(LOWER_BYTES) for t in table.column("text").to_pylist())
        docs = np.repeat(np.arange(len(counts)), counts)
        where = np.array([place.get(w, -1) for w in vocabulary], np.int64)
        token = where[codes] if len(codes) else np.zeros(0, np.int64)
        near = token >= 0
        sums = np.stack([np.bincount(docs[near], values[token[near], i], len(counts)) for i in range(size + 2)], axis=1)
        out = [(-1, pack_arrays(table.column("k").to_numpy(), (~table.column("train").to_numpy(zero_copy_only=False)).astype(np.int8), counts, sums))]
        far_codes, far_docs = codes[~near].astype(np.int64), docs[~near]
        if len(far_codes):
            pairs, times = np.unique(far_codes << 32 | far_docs, return_counts=True)
            far_codes, far_docs = pairs >> 32, (pairs & 0xFFFFFFFF).astype(np.uint32)
            own = np.unique(far_codes)
            bucket_of = np.zeros(len(vocabulary), np.int64)
            bucket_of[own] = [xxhash.xxh64_intdigest(vocabulary[c]) % buckets for c in own.tolist()]
            order = np.argsort(bucket_of[far_codes], kind="stable")
            far_codes, far_docs, times = far_codes[order], far_docs[order], times[order]
            kinds = bucket_of[far_codes]
            edges = np.flatnonzero(np.append(True, kinds[1:] != kinds[:-1]))
            for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(kinds)], strict=True):
                mine, index = np.unique(far_codes[a:b], return_inverse=True)
                sizes = np.bincount(index, minlength=len(mine))
                out.append((int(kinds[a]), pack_arrays(b" ".join(vocabulary[c] for c in mine.tolist()), sizes.astype(np.uint32), far_docs[a:b], times[a:b].astype(np.uint32))))
        yield pa.record_batch([pa.array([chunk] * len(out), pa.int64()), pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.binary())], ["chunk", "bucket", "blob"])
        chunk += 1


def _add_words(blobs: pa.Table, table: pa.Table, size: int) -> pa.Table:
    place = {w: i for i, w in enumerate(table.column("word").to_pylist())} if blobs.num_rows else {}
    values = np.frombuffer(b"".join(table.column("packed").to_pylist())).reshape(-1, size + 2)
    out = []
    for blob in blobs.column("blob").to_pylist():
        text, sizes, docs, times = unpack_arrays(blob, bytes, np.uint32, np.uint32, np.uint32)
        rows = np.repeat(np.array([place[w] for w in text.split(b" ")], np.int64), sizes)
        own, index = np.unique(docs, return_inverse=True)
        sums = np.stack([np.bincount(index, values[rows, i] * times, len(own)) for i in range(size + 2)], axis=1)
        out.append(pack_arrays(own, sums))
    return pa.table({"chunk": blobs.column("chunk"), "bucket": blobs.column("bucket"), "blob": pa.array(out, pa.binary())})


def _finish(table: pa.Table, size: int, shared) -> pa.Table:  # noqa: ANN001
    model, parts = shared.value, []
    for bucket, blob in zip(table.column("bucket").to_pylist(), table.column("blob").to_pylist(), strict=True):
        if bucket < 0:
            k, held, counts, sums = unpack_arrays(blob, np.int64, np.int8, np.int64, np.float64)
            sums = sums.reshape(-1, size + 2).copy()
        else:
            parts.append((bucket, blob))
    for _, blob in sorted(parts):
        own, more = unpack_arrays(blob, np.uint32, np.float64)
        sums[own] += more.reshape(-1, size + 2)
    end_known = model["types"] > 0 and sum(model["ends"]) > 0
    base = sums[:, 0] + np.log10((sum(model["ends"]) + 0.1) / (model["tokens"] + 0.1 * (model["types"] + 1)))
    texts = max(1, sum(model["ends"]))
    logs = np.zeros((len(k), size))
    for d, group in enumerate(model["groups"]):
        # The lattice spells words only, so the end keeps a share of the freed mass for itself where it was not seen.
        end = max(group["end"] - group["discount"], 0) / group["n"] if group["n"] else 0.0
        prior = group["end"] / texts if sum(model["ends"]) else 1.0 / size
        logs[:, d] = sums[:, 2 + d] + np.log10(max(end, 1e-12)) + np.log10(max(prior, 1e-300))
    top = logs.max(axis=1)
    score = top + np.log10((10 ** (logs - top[:, None])).sum(axis=1))
    return pa.table(
        {
            "id": pa.array(k, mask=k == LAST_ID), "held_out": pa.array(held > 0), "n_tokens": pa.array(counts + 1), "n_known": pa.array(np.rint(sums[:, 1]).astype(np.int64) + int(end_known)),
            "train_tokens": pa.array(np.full(len(k), model["tokens"], np.int64)), "base_score": pa.array(base), "score": pa.array(score),
        }
    )

"""Toxic spans by a two-label linear-chain conditional random field, and document scores from its marginals.

Labels are given per document. Words that are frequent in toxic and rare in clean labelled documents (log odds of document
frequencies, near copies counted once) label the tokens of the toxic ones; the field is fitted to these tokens by gradient
ascent on its exact likelihood. Every token of a text then gets the forward-backward marginal of the toxic label; the
marginals are summed into three document features and a logistic function of them is the score.

Only words enter: no id, language, source or label. The fit sees at most ``SAMPLE_ROWS`` labelled documents, half of them of
either label (those with the smallest id hashes; the scores are corrected for the labels' true shares), whole texts of at most
``SAMPLE_BYTES`` together and ``TEXT_BYTES`` each, in one task. An id with several texts is sampled by one of them, that of the
smallest hash. Scoring is a map over all documents and shuffles nothing.

Defined results: null and empty texts get the score of a text without toxic tokens; ids labelled twice count as toxic if any
label is 1; null labels are skipped; without labelled rows of both kinds every score is the (smoothed) share of toxic rows; columns named ``toxic_score`` or
``toxic_spans`` are replaced.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from codeweft.llm.words import LOWER_BYTES, encode_words, kept_names, keyed, lean, lean_group, mix, rolling, text_chunks, training, word_hashes

#: Bounds of the fit: labelled documents looked at, those the field is fitted to, and words that may carry a weight.
SAMPLE_ROWS = 6_000
SAMPLE_BYTES = 64 << 20
TEXT_BYTES = 1 << 20
FIELD_ROWS = 1_200
MOST_WORDS = 5_000
STEPS = 60
#: Punctuation and decoration around a word.
EDGES = bytes(c for c in range(33, 127) if not chr(c).isalnum())
SPAN = "array<struct<start:long,stop:long,p:double>>"


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", parts: int = 5) -> dict:
    """The fitted model, a small dictionary: weights of at most ``MOST_WORDS`` words and a dozen numbers."""
    rows = keyed(docs, id_col, text_col)
    marked = labels.select(labels[id_col].cast("long").alias("k"), (labels[label_col].cast("int") > 0).cast("int").alias("y")).filter("k is not null and y is not null")
    chosen = marked.filter(training(F.col("k"), parts)).groupBy("k").agg(F.max("y").alias("y"))
    half, turn = SAMPLE_ROWS // 2, F.xxhash64("k")
    totals = dict(chosen.groupBy("y").count().collect())
    ranked = chosen.withColumn("rank", F.row_number().over(Window.partitionBy("y").orderBy(turn, "k")))
    # SAMPLE_ROWS bounds every broadcast side here and the rows of the window over sizes.
    chosen = ranked.filter(F.col("rank") <= half).select("k", "y", "rank")
    sized = rows.select("k", "tie", F.octet_length("text").cast("long").alias("size")).join(F.broadcast(chosen), "k")
    one = sized.groupBy("k", "y", "rank").agg(F.min(F.struct("tie", "size")).alias("one")).select("k", "y", "rank", "one.*")
    taken = F.sum("size").over(Window.orderBy("rank", "y", "k").rowsBetween(Window.unboundedPreceding, 0))
    listed = one.filter(F.col("size") <= TEXT_BYTES).withColumn("taken", taken).filter(F.col("taken") <= SAMPLE_BYTES).select("k", "tie", "y")
    sample = rows.select("k", "tie", "text").join(F.broadcast(listed), ["k", "tie"]).groupBy("k", "tie").agg(F.first("text").alias("text"), F.first("y").alias("y"))
    found = sample.groupBy(F.lit(0).alias("all")).applyInArrow(lean_group(lambda t: pa.table({"model": [json.dumps(_fit(t))]})), "model string").collect()
    model = json.loads(found[0].model) if found else _plain(0, 0)
    if len(totals) == 2:
        # Odds in the sample are those of all labelled rows times the ratio of the sampled shares.
        model["doc"][0] += float(np.log(min(1, half / totals[0]) / min(1, half / totals[1])))
    return model


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row with ``toxic_score`` (0 to 1) and ``toxic_spans`` (character offsets of runs of toxic tokens, with their largest marginal)."""
    columns = kept_names(docs, "toxic_score", "toxic_spans")
    source = docs.select(docs[text_col]).schema[0]
    # A text that is a string already travels once, not beside its row.
    own = source.name if isinstance(source.dataType, StringType) else None
    carried = [c for c in columns if c != own]
    row = F.struct(*[docs[c] for c in carried]) if carried else F.lit(0)
    packed = docs.select(row.alias("row"), docs[text_col].cast("string").alias("text"))
    schema = packed.select("row", "text").schema.add("score", "double").add("spans", packed.select(F.lit(None).cast(SPAN)).schema[0].dataType)
    scored = packed.mapInArrow(lambda it: lean(_score(it, model)), schema)
    kept = [(F.col("text") if c == own else F.col("row").getField(c)).alias(c) for c in columns]
    return scored.select(*kept, F.col("score").alias("toxic_score"), F.col("spans").alias("toxic_spans"))


def _plain(toxic: int, rows: int) -> dict:
    share = (toxic + 0.5) / (rows + 1)
    return {"words": {}, "bias": -30.0, "moves": [0.0, 0.0, 0.0], "doc": [float(np.log(share / (1 - share))), 0.0, 0.0, 0.0]}


def bare(vocabulary: list[bytes]) -> list[bytes]:
    return [w.translate(LOWER_BYTES).strip(EDGES) for w in vocabulary]


def _fit(table: pa.Table) -> dict:
    y = table.column("y").to_numpy().astype(int) > 0
    order = np.lexsort((table.column("tie").to_numpy(), table.column("k").to_numpy()))
    texts, y = [table.column("text")[int(i)].as_py().encode() for i in order], y[order]
    codes, counts, vocabulary = encode_words(texts)
    names = bare(vocabulary)
    first = np.cumsum(counts) - counts
    # One of each group of near copies: those with the same smallest run of five words.
    values = word_hashes(names)[codes] if names else np.zeros(0, np.uint64)
    seen, single = set(), []
    for i, (at, n) in enumerate(zip(first, counts, strict=True)):
        runs = rolling(values[at : at + n], min(5, int(n)))
        name = int(mix(runs).min()) if n else None
        if name is not None and name not in seen:
            seen.add(name)
            single.append(i)
    if not y.any() or y.all():
        return _plain(int(y.sum()), len(y))
    in_toxic, in_clean = Counter(), Counter()
    for i in single:
        (in_toxic if y[i] else in_clean).update({names[c] for c in np.unique(codes[first[i] : first[i] + counts[i]]).tolist()})
    n_toxic, n_clean = sum(bool(y[i]) for i in single), sum(not y[i] for i in single)
    odds = {w: float(np.log((c + 0.5) / (n_toxic + 1)) - np.log((in_clean[w] + 0.5) / (n_clean + 1))) for w, c in in_toxic.items() if w}
    # A word counts if chance gives its toxic share to no more than a tenth of a word among all words tried (Chernoff bound).
    sure, share = np.log(10 * len(in_toxic.keys() | in_clean.keys())), n_toxic / (n_toxic + n_clean)
    known = [w for w in odds if odds[w] >= 1.5 and _surprise(in_toxic[w], in_clean[w], share) >= sure]
    known = sorted(known, key=lambda w: (-odds[w] * in_toxic[w], w))[:MOST_WORDS]
    if not known:
        return _plain(int(y.sum()), len(y))
    place = {w: i for i, w in enumerate(known)}
    feature = np.array([place.get(w, -1) for w in names], np.int64)
    rows = _some_of_both(y, np.array(single), FIELD_ROWS)
    params = _fit_field([feature[codes[first[i] : first[i] + counts[i]]] for i in rows], [bool(y[i]) for i in rows], np.array([odds[w] for w in known]))
    model = {"words": {w.decode(errors="replace"): float(v) for w, v in zip(known, params[4:], strict=True)}, "bias": float(params[0]), "moves": params[1:4].tolist(), "doc": [0.0] * 4}
    weights = np.append(params[4:], 0.0)[feature[codes]] + params[0] if len(codes) else np.zeros(0)
    features = _document_features(_marginals(weights, counts, params[1:4])[0], counts)
    model["doc"] = _logistic(features, y.astype(float)).tolist()
    return model


def _surprise(toxic: int, clean: int, share: float) -> float:
    """Negative logarithm of the bound on seeing at least so many toxic documents among those with the word."""
    rate = toxic / (toxic + clean)
    return toxic * np.log(rate / share) + (clean * np.log((1 - rate) / (1 - share)) if clean else 0.0)


def _some_of_both(y: np.ndarray, single: np.ndarray, most: int) -> list[int]:
    toxic, clean = single[y[single]], single[~y[single]]
    return sorted([*toxic[: most // 2].tolist(), *clean[: most - most // 2].tolist()])


def _fit_field(features: list[np.ndarray], toxic: list[bool], odds: np.ndarray) -> np.ndarray:
    """Bias, three transition weights (to, from and within the toxic label) and word weights by exact likelihood (Adam)."""
    counts = np.array([len(f) for f in features], np.int64)
    flat = np.concatenate(features)
    label = (flat >= 0) & np.repeat(np.array(toxic), counts)
    last = np.cumsum(counts) - 1
    pair = np.ones(len(flat), bool)
    pair[last[counts > 0]] = False
    left = np.flatnonzero(pair)
    params = np.concatenate([[-4.0, 0.0, 0.0, 0.0], odds])
    seen = np.concatenate([[label.sum()], _pair_counts(label[left], label[left + 1]), np.bincount(flat[label], minlength=len(odds))])
    m, v = np.zeros_like(params), np.zeros_like(params)
    for step in range(1, STEPS + 1):
        emission = np.append(params[4:], 0.0)[flat] + params[0]
        p, forward, backward = _marginals(emission, counts, params[1:4])
        # Joint marginals of neighbours, in logarithms up to a constant per pair.
        a, e, b = forward[left], emission[left + 1], backward[left + 1]
        logs = np.stack([np.zeros_like(a), params[1] + e + b, a + params[2], a + params[3] + e + b])
        joint = np.exp(logs - logs.max(axis=0))
        joint /= joint.sum(axis=0)
        expected = np.concatenate([[p.sum()], joint[1:].sum(axis=1), np.bincount(flat[flat >= 0], p[flat >= 0], len(odds))])
        gradient = (seen - expected) / max(1, len(features)) - 0.002 * params
        m, v = 0.9 * m + 0.1 * gradient, 0.99 * v + 0.01 * gradient**2
        params = params + 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return params


def _pair_counts(a: np.ndarray, b: np.ndarray) -> list[int]:
    return [int((~a & b).sum()), int((a & ~b).sum()), int((a & b).sum())]


def _marginals(emission: np.ndarray, counts: np.ndarray, moves: Iterable[float]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginal of label 1 per token, and the log ratios of forward and backward weights.

    All texts advance together, a position at a time, the longest first; with two labels a step is one ratio per text.
    """
    to, back, stay = moves
    first = np.cumsum(counts) - counts
    order = np.argsort(-counts, kind="stable")
    first, sizes = first[order], counts[order]
    alive = len(sizes) - np.searchsorted(sizes[::-1], np.arange(int(sizes[0]) if len(sizes) else 0), side="right")
    forward, backward = np.array(emission, float), np.zeros(len(emission))
    for t in range(1, len(alive)):
        at = first[: alive[t]] + t
        r = forward[at - 1]
        forward[at] += np.logaddexp(to, r + stay) - np.logaddexp(0.0, r + back)
    last = first + sizes - 1
    for t in range(1, len(alive)):
        at = last[: alive[t]] - t
        r = backward[at + 1] + emission[at + 1]
        backward[at] = np.logaddexp(back, stay + r) - np.logaddexp(0.0, to + r)
    return 1 / (1 + np.exp(-np.clip(forward + backward, -60, 60))), forward, backward


def _document_features(p: np.ndarray, counts: np.ndarray) -> np.ndarray:
    out = np.zeros((len(counts), 3))
    some = np.flatnonzero(counts)
    if len(some):
        first = (np.cumsum(counts) - counts)[some]
        out[some, 0] = 1 - np.exp(np.add.reduceat(np.log1p(-np.minimum(p, 1 - 1e-12)), first))
        out[some, 1] = np.maximum.reduceat(p, first)
        out[some, 2] = np.log1p(np.add.reduceat(p, first))
    return out


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    x = np.hstack([np.ones((len(x), 1)), x])
    w, ridge = np.zeros(x.shape[1]), np.diag([1e-3] + [1.0] * (x.shape[1] - 1))
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge, x.T @ (y - p) - ridge @ w)
        w += np.clip(step, -3, 3)
    return w


def _score(batches: Iterable[pa.RecordBatch], model: dict) -> Iterator[pa.RecordBatch]:
    weight = {w.encode(): v for w, v in model["words"].items()}
    doc = np.array(model["doc"])
    for table in text_chunks(batches):
        yield _scored(table, weight, doc, model)


def _scored(table: pa.Table, weight: dict, doc: np.ndarray, model: dict) -> pa.RecordBatch:
    text = table.column("text").combine_chunks()
    texts = text.fill_null(b"").to_pylist()
    codes, counts, vocabulary = encode_words(texts)
    own = np.array([weight.get(w, 0.0) for w in bare(vocabulary)]) + model["bias"]
    p = _marginals(own[codes] if len(codes) else np.zeros(0), counts, model["moves"])[0]
    x = _document_features(p, counts)
    scores = 1 / (1 + np.exp(-np.clip(doc[0] + x @ doc[1:], -30, 30)))
    first = np.cumsum(counts) - counts
    spans = [_spans(t, p[a : a + n]) if top >= 0.5 else [] for t, a, n, top in zip(texts, first, counts, x[:, 1], strict=True)]
    # The view takes bytes as they are: Spark's strings need not be valid UTF-8.
    return pa.record_batch(
        [table.column("row").combine_chunks(), text.view(pa.string()), pa.array(scores), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("p", pa.float64())])))],
        ["row", "text", "score", "spans"],
    )


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _spans(text: bytes, p: np.ndarray) -> list[dict]:
    out: list[dict] = []
    before = -2
    wanted = set(np.flatnonzero(p >= 0.5).tolist())
    for i, found in enumerate(WORD.finditer(text.decode())):
        if i not in wanted:
            continue
        if i == before + 1:
            out[-1]["stop"], out[-1]["p"] = found.end(), max(out[-1]["p"], float(p[i]))
        else:
            out.append({"start": found.start(), "stop": found.end(), "p": float(p[i])})
        before = i
    return out

"""N-gram Jaccard join by prefix trees.

A document's set is its distinct word n-grams as 64-bit hashes. Documents with equal sets
are one class. Two sets within the threshold share one of the first ``n - ceil(t n) + 1`` members of either (prefix
filter), so classes meet at shared prefix members; there a path-compressed tree of the sets is traversed with each set in turn: sets below a
node share the overlap counted on the way down, and a subtree is left as soon as the overlap so far plus the smaller
remaining length cannot reach what its smallest set needs.

1. A third of all hashes (by value) is counted over the corpus. A class with more members of its own than the threshold lets
   any partner miss is linked to nothing and leaves. This is exact and takes one small shuffle.
2. For the remaining classes all members are counted, and the test is repeated. The global order is by rising frequency from here.
3. Classes meet at their smallest member under two other orders; links found there are joined to components.
4. Prefix members still shared by different components are the only places where a link can be missing: their classes meet
   again, split by length and into block pairs where many meet, and only links between components are looked for.

So a group of copies is never expanded into pairs, and no link between components is lost. Defined results: null or empty
texts have empty sets and stay alone; fewer words than ``width`` form one n-gram; rows with the same id and text are one document.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweft.llm.components import components, stored
from codeweft.llm.keys import maybe_in
from codeweft.llm.words import CHUNK_BYTES, LAST_ID, LOWER_BYTES, encode_words, gathered, keyed, lean, lean_group, mix, pack_arrays, rolling, text_bytes, text_chunks, unpack_arrays, word_hashes
from codeweft.session import cut

#: Share of hash values counted in step 1 (members below 2**64 / COUNTED), and the members that one meeting's part may hold.
COUNTED = 3
BLOCK_MEMBERS = 1_000_000
#: Text whose counted members make one bucket (about a million).
BUCKET_BYTES = 20_000_000
#: Text of the corpus per file of the small tables (links, classes, meetings).
FILE_BYTES = 1_000_000_000
WORDS_AT_ONCE = 1 << 20
SALTS = (0x2545F4914F6CDD1D, 0x6A09E667F3BCC909)


def link_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, percent: int = 85) -> DataFrame:
    """One row per input row: ``id, k, tie, n_shingles, root`` (id null for null ids) where ``root`` is the smallest ``(k, tie)`` reachable by links."""
    texts = keyed(docs, id_col, text_col).select("k", "tie", "text")
    size = text_bytes(texts)
    buckets, files = max(1, -(-size // BUCKET_BYTES)), max(1, -(-size // FILE_BYTES))
    dealt = texts.mapInArrow(lambda it: lean(_sets(it, width, buckets)), "bucket long, kind int, blob binary")
    stage = cut(dealt.groupBy("bucket").applyInArrow(lean_group(lambda t: _shared_members(t, buckets)), f"{_DOCUMENT}, target long, blob binary"))
    single = stage.filter("blob is null").select("k", "tie", "n", "counted", "s1", "s2")
    classes = single.filter("n > 0").groupBy("s1", "s2").agg(F.min(F.struct("k", "tie")).alias("node"), F.max("n").alias("n"), F.max("counted").alias("counted"))
    live = stage.filter("blob is not null").select("target", "blob").groupBy("target").applyInArrow(lean_group(_sums), "s1 long, live long")
    spare = F.col("n") - F.ceil(F.col("n") * percent / F.lit(100))
    classes = stored(classes.join(live, "s1", "left").withColumn("open", F.col("counted") - F.least("counted", F.coalesce("live", F.lit(0))) <= spare), files)
    sets = stored(_sets_of(texts, classes.filter("open").select("node.k", "node.tie"), width, percent, files, size), 4 * files)
    links = _meet_at_minimum(sets, percent, files)
    labels = components(links, files)
    labelled = sets.join(labels, sets["node"] == labels["node"], "left").select(sets["node"], "n", "members", F.coalesce("root", sets["node"]).alias("root"))
    labelled = stored(labelled, 4 * files)
    missing = _meet_between_components(labelled, percent, files)
    roots = components(links.select("a", "b").unionByName(missing.select("a", "b")), files)
    found = classes.join(roots, "node", "left").select("s1", "s2", F.coalesce("root", "node").alias("root"))
    joined = gathered(single.join(found, ["s1", "s2"], "left"), size // 8)
    id_ = F.when(F.col("k") != LAST_ID, F.col("k")).alias("id")
    return joined.select(id_, "k", "tie", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("root")).otherwise(F.struct("k", "tie")).alias("root"))


def component_id(root: str = "root"):  # noqa: ANN201
    return F.when(F.col(f"{root}.k") != LAST_ID, F.col(f"{root}.k"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, percent: int = 85) -> DataFrame:
    """The rows of ``docs`` whose document is its component's smallest; all columns stay. Of rows that share id and text the smallest
    stays (columns that hold maps are compared as JSON)."""
    heads = link_components(docs, id_col, text_col, width, percent).filter("k = root.k and tie = root.tie").select("k", "tie").distinct()
    names = docs.columns
    key = docs[id_col].cast("long")
    marked = docs.select(
        F.struct(*[docs[c] for c in names]).alias("row"),
        F.coalesce(key, F.lit(LAST_ID)).alias("k"),
        F.xxhash64(F.coalesce(docs[text_col].cast("string"), F.lit(""))).alias("tie"),
    )
    maps = [f.name for f in docs.schema if "map<" in f.dataType.simpleString()]
    comparable = F.struct(*[F.to_json(F.struct(F.col("row").getField(c))) if c in maps else F.col("row").getField(c) for c in names])
    smallest = F.min_by("row", comparable) if maps else F.min("row")
    one = marked.join(heads, ["k", "tie"], "left_semi").groupBy("k", "tie").agg(smallest.alias("row"))
    size = text_bytes(docs.select(docs[text_col].cast("string").alias("text")))
    return gathered(one, size).select(*[F.col("row").getField(c).alias(c) for c in names])


def _member_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """Sorted distinct n-gram hashes of every text; words become Python objects for about WORDS_AT_ONCE bytes at a time."""
    out: list[np.ndarray] = []
    low = 0
    while low < len(texts):
        high, size = low, 0
        while high < len(texts) and (high == low or size + len(texts[high]) <= WORDS_AT_ONCE):
            size += len(texts[high])
            high += 1
        codes, counts, vocabulary = encode_words(t.translate(LOWER_BYTES) for t in texts[low:high])
        values = word_hashes(vocabulary)[codes] if vocabulary else np.zeros(0, np.uint64)
        grams, first = rolling(values, width), np.cumsum(counts) - counts
        for at, n in zip(first.tolist(), counts.tolist(), strict=True):
            if n >= width:
                out.append(np.unique(grams[at : at + n - width + 1]))
            else:
                out.append(mix(rolling(values[at : at + n], n) + np.uint64(n)) if n else np.zeros(0, np.uint64))
        low = high
    return out


_DOCUMENT = "k long, tie long, n long, counted long, s1 long, s2 long"
_DOCUMENT_NAMES = ["k", "tie", "n", "counted", "s1", "s2"]


def _sets(batches: Iterable[pa.RecordBatch], width: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Blobs for the buckets: of kind 0 the chunk's documents, 1 counted members with their class, 2 sums settled here."""
    limit, drop = np.uint64((1 << 64) // COUNTED), np.uint64(16)
    for table in text_chunks(batches):
        sets = _member_sets(table.column("text").to_pylist(), width)
        # 48 bits are enough to count by: a chance match only lets a class stay for the exact steps.
        few = [np.unique(s[: np.searchsorted(s, limit)] >> drop) for s in sets]
        sizes, counted = np.array([len(s) for s in sets], np.int64), np.array([len(f) for f in few], np.int64)
        s1 = np.array([mix(s).sum(dtype=np.uint64) for s in sets], np.uint64)
        s2 = np.array([mix(s ^ np.uint64(SALTS[0])).sum(dtype=np.uint64) for s in sets], np.uint64)
        out = [(int(s1[0] % np.uint64(buckets)), 0, pack_arrays(table.column("k").to_numpy(), table.column("tie").to_numpy(), sizes, counted, s1, s2))]
        _, first = np.unique(s1, return_index=True)
        members, s1 = np.concatenate([few[i] for i in first]), s1[first]
        del sets
        owner = np.repeat(np.arange(len(first)), counted[first])
        order = np.argsort(members, kind="stable")
        members, owner = members[order], owner[order]
        heads = np.flatnonzero(np.append(True, members[1:] != members[:-1])) if len(members) else np.zeros(0, np.int64)
        lengths = np.diff(np.append(heads, len(members)))
        several = lengths > 1
        # Members of several classes of this chunk are known to be shared: one row tells the others, the sums stay here.
        known = np.bincount(owner[np.repeat(several, lengths)], minlength=len(first))
        members, owner = members[heads], np.where(several, -1, owner[heads])
        bucket = (members // ((limit >> drop) // np.uint64(buckets) + np.uint64(1))).astype(np.int64)
        edges = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.zeros(0, np.int64)
        for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(bucket)], strict=True) if len(edges) else ():
            own = owner[a:b]
            used, which = np.unique(own[own >= 0], return_inverse=True)
            places = np.full(b - a, len(used), np.uint32)
            places[own >= 0] = which
            steps = np.diff(members[a:b], prepend=np.uint64(0)).astype(np.uint64)
            out.append((int(bucket[a]), 1, pack_arrays(steps.view(np.uint8).reshape(-1, 8).T, places.view(np.uint8).reshape(-1, 4).T, s1[used])))
        some = np.flatnonzero(known)
        if len(some):
            out.append((int(s1[0] % np.uint64(buckets)), 2, pack_arrays(s1[some], known[some].astype(np.int64))))
        yield pa.record_batch([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int32()), pa.array([o[2] for o in out], pa.binary())], ["bucket", "kind", "blob"])


def _shared_members(table: pa.Table, targets: int) -> pa.Table:
    """The documents, and blobs of how many counted members of each class belong to another class too."""
    documents, members, names, sums = [], [], [], []
    for kind, blob in zip(table.column("kind").to_pylist(), table.column("blob").to_pylist(), strict=True):
        if kind == 0:
            documents.append(np.stack(unpack_arrays(blob, *[np.int64] * 6)))
        elif kind == 2:
            sums.append(unpack_arrays(blob, np.int64, np.int64))
        else:
            steps, places, s1 = unpack_arrays(blob, np.uint8, np.uint8, np.int64)
            which = np.ascontiguousarray(places.reshape(4, -1).T).view(np.uint32).ravel()
            members.append(np.cumsum(np.ascontiguousarray(steps.reshape(8, -1).T).view(np.uint64).ravel(), dtype=np.uint64))
            # Several classes of one chunk have a stand-in, which differs from all names and other stand-ins.
            names.append(np.append(s1, np.int64(-1 - len(names)))[which])
    if members:
        members, names = np.concatenate(members), np.concatenate(names)
        order = np.lexsort((names, members))
        members, names = members[order], names[order]
        fresh = np.ones(len(members), bool)
        fresh[1:] = (members[1:] != members[:-1]) | (names[1:] != names[:-1])
        members, names = members[fresh], names[fresh]
        alone = np.ones(len(members), bool)
        alone[1:] &= members[1:] != members[:-1]
        alone[:-1] &= members[:-1] != members[1:]
        sums.append([names[~alone], np.ones(int((~alone).sum()), np.int64)])
    docs = np.concatenate(documents, axis=1) if documents else np.zeros((6, 0), np.int64)
    names, live = _added(sums)
    target = (names.view(np.uint64) % np.uint64(targets)).astype(np.int64)
    order = np.argsort(target, kind="stable")
    edges = np.searchsorted(target[order], np.arange(targets + 1))
    parts = [(t, order[a:b]) for t, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if b > a]
    blobs = [pack_arrays(names[rows], live[rows]) for _, rows in parts]
    columns = [pa.concat_arrays([pa.array(c), pa.nulls(len(blobs), pa.int64())]) for c in docs]
    columns.append(pa.concat_arrays([pa.nulls(docs.shape[1], pa.int64()), pa.array([t for t, _ in parts], pa.int64())]))
    columns.append(pa.concat_arrays([pa.nulls(docs.shape[1], pa.binary()), pa.array(blobs, pa.binary())]))
    return pa.table(columns, [*_DOCUMENT_NAMES, "target", "blob"])


def _added(sums: list) -> tuple[np.ndarray, np.ndarray]:
    if not sums:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    names, where = np.unique(np.concatenate([s[0] for s in sums]), return_inverse=True)
    return names, np.bincount(where, np.concatenate([s[1] for s in sums]), len(names)).astype(np.int64)


def _sums(table: pa.Table) -> pa.Table:
    names, live = _added([unpack_arrays(b, np.int64, np.int64) for b in table.column("blob").to_pylist()])
    return pa.table({"s1": names, "live": live})


def _sets_of(texts: DataFrame, wanted: DataFrame, width: int, percent: int, files: int, size: int) -> DataFrame:
    """``node, n, members``: members that several wanted classes share, by rising frequency; classes with too few of them go.

    A member is 5 bits for its frequency (half-octaves) and 58 of its hash, so ascending numbers are the global order. Members
    of one class only stand before all others in it and are just counted (``n`` minus the length of ``members``).
    """
    wanted = stored(wanted.withColumn("cid", F.monotonically_increasing_id()), files)
    texts = maybe_in(texts, wanted).filter("maybe").drop("maybe")
    own = texts.join(wanted, ["k", "tie"]).groupBy("k", "tie", "cid").agg(F.first("text").alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in text_chunks(batches, limit=CHUNK_BYTES // 2):
            sets = _member_sets(table.column("text").to_pylist(), width)
            sizes = np.array([len(s) for s in sets], np.int64)
            index = np.repeat(np.arange(len(sets)), sizes)
            flat = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
            for low in range(0, len(flat), 1 << 17):
                part = pa.array(index[low : low + (1 << 17)])
                columns = [table.column(c).combine_chunks().take(part) for c in ("cid", "k", "tie")]
                yield pa.record_batch([*columns, pa.array(sizes).take(part), pa.array(flat[low : low + (1 << 17)])], ["cid", "k", "tie", "n", "member"])

    postings = cut(gathered(own, size // 4).mapInArrow(lambda it: lean(run(it)), "cid long, k long, tie long, n long, member long"))
    often = postings.groupBy("member").agg(F.count("*").alias("df")).filter("df > 1")
    key = F.least(F.lit(31), F.floor(2 * F.log2("df"))).cast("long") * F.lit(1 << 58) + F.col("member").bitwiseAND(F.lit((1 << 58) - 1))
    shared = postings.select("cid", "member").join(often, "member").select("cid", key.alias("member"))
    sets = shared.groupBy("cid").agg(F.sort_array(F.collect_list("member")).alias("members"))
    sizes = postings.select("cid", "k", "tie", "n").distinct()
    kept = sets.join(sizes, "cid").filter(F.size("members") * 100 >= F.col("n") * percent)
    return kept.select(F.struct("k", "tie").alias("node"), "n", "members")


def _meet_at_minimum(sets: DataFrame, percent: int, files: int) -> DataFrame:
    """Links among classes with the same smallest member under other orders; large meetings are split, two pivots join the parts."""

    def keys(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k, tie, n, members = (batch.column(batch.schema.get_field_index(c)) for c in ("k", "tie", "n", "members"))
            arrays = _arrays(members)
            for salt in SALTS:
                least = [int(mix(m ^ np.uint64(salt)).min() ^ np.uint64(salt)) if len(m) else 0 for m in arrays]
                yield pa.record_batch([pa.array(np.array(least, np.uint64).view(np.int64)), k, tie, n], ["place", "k", "tie", "n"])

    flat = sets.select("node.k", "node.tie", "n", "members")
    places = stored(flat.mapInArrow(lambda it: lean(keys(it)), "place long, k long, tie long, n long"), files)
    met = places.groupBy("place").agg(F.count("*").alias("c"), F.sum("n").alias("total"), F.min(F.struct("k", "tie")).alias("low"), F.max(F.struct("k", "tie")).alias("high"))
    met = met.filter("c > 1").withColumn("parts", F.ceil(F.col("total") / BLOCK_MEMBERS).cast("int"))
    node = F.struct("k", "tie")
    own = F.array(F.pmod(F.xxhash64("k", "tie"), F.col("parts")).cast("int"))
    pivot = (node == F.col("low")) | (node == F.col("high"))
    dealt = places.join(met, "place").select("k", "tie", "place", F.explode(F.when(pivot, F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(own)).alias("part"))
    full = dealt.join(flat, ["k", "tie"]).select("place", "part", "k", "tie", "n", "members", F.lit(None).cast("long").alias("rk"), F.lit(None).cast("long").alias("rt"))
    found = full.groupBy("place", "part").applyInArrow(lean_group(lambda t: _tree_links(t, percent)), "ak long, at long, bk long, bt long")
    return _as_links(found, files)


def _as_links(found: DataFrame, files: int) -> DataFrame:
    return stored(found.select(F.struct(F.col("ak").alias("k"), F.col("at").alias("tie")).alias("a"), F.struct(F.col("bk").alias("k"), F.col("bt").alias("tie")).alias("b")), files)


def _meet_between_components(sets: DataFrame, percent: int, files: int) -> DataFrame:
    """Links between classes of different components, found at prefix members that several components share.

    In a pair, the first shared member leaves the smaller set at least what two sets of its size need, so it lies in that set's
    shorter prefix; places without such a set are no meeting. Places are gathered by the smallest of their classes, so a class
    travels once for all members of a passage that it shares with the same others.
    """
    step = float(np.log(100 / percent)) if percent < 100 else 1.0
    flat = sets.select("node.k", "node.tie", F.col("root.k").alias("rk"), F.col("root.tie").alias("rt"), "n", "members")
    # Of the first n - ceil(t n) + 1 members, those of this class alone (n - size) come first and meet nobody.
    own = F.col("n").cast("int") - F.size("members")
    take = F.size("members") - F.ceil(F.col("n") * percent / F.lit(100)).cast("int") + 1
    places = flat.select("k", "tie", "rk", "rt", "n", own.alias("own"), F.posexplode(F.slice("members", F.lit(1), take)).alias("at", "place"))
    short = F.col("own") + F.col("at") <= F.col("n") - F.ceil(2 * percent * F.col("n") / F.lit(100 + percent))
    # Sets within the threshold lie in the same length class or in neighbouring ones: a set joins its own and the next.
    level = F.floor(F.log(F.col("n").cast("double")) / step).cast("int")
    places = places.select("k", "tie", "rk", "rt", "n", "place", short.alias("short"), F.explode(F.array(level, level + 1)).alias("level"))
    root, node = F.struct("rk", "rt"), F.struct("k", "tie")
    met = places.groupBy("place", "level").agg(F.min(root).alias("low"), F.max(root).alias("high"), F.max("short").alias("short"), F.min(node).alias("home"))
    met = met.filter("low != high and short").select("place", "level", "home")
    meetings = stored(places.join(met, ["place", "level"]).select("home", "level", "k", "tie", "n").distinct(), files)
    parts = meetings.groupBy("home", "level").agg(F.ceil(F.sum("n") / BLOCK_MEMBERS).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("k", "tie"), F.col("parts")).cast("int")
    every = F.sequence(F.lit(0), F.col("parts") - 1)
    pairs = F.transform(every, lambda other: F.struct(F.least(part, other).alias("i"), F.greatest(part, other).alias("j")))
    dealt = meetings.join(parts, ["home", "level"]).select("home", "level", "k", "tie", F.explode(pairs).alias("pair"))
    full = dealt.join(flat, ["k", "tie"]).select("home", "level", "pair", "k", "tie", "n", "members", "rk", "rt")
    found = full.groupBy("home", "level", "pair").applyInArrow(lean_group(lambda t: _tree_links(t, percent)), "ak long, at long, bk long, bt long")
    return _as_links(found, files)


def _arrays(members) -> list[np.ndarray]:  # noqa: ANN001
    """List column to one array per row."""
    chunks = members.chunks if isinstance(members, pa.ChunkedArray) else [members]
    out: list[np.ndarray] = []
    for chunk in chunks:
        values, ends = chunk.values.to_numpy().view(np.uint64), chunk.offsets.to_numpy()
        out.extend(values[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True))
    return out


class _Node:
    __slots__ = ("piece", "children", "ends", "least", "most", "longest", "some", "uniform")

    def __init__(self, piece: np.ndarray) -> None:
        self.piece, self.children, self.ends = piece, {}, []
        # Smallest and largest set below, and the most members any of them has from the start of this piece on.
        self.least, self.most, self.longest = 1 << 62, 0, 0
        self.some, self.uniform = -1, True


class PrefixTree:
    """Path-compressed tree of ascending member arrays, with the components that links have made so far."""

    PIECE = 96

    def __init__(self, percent: int, groups: list[int]) -> None:
        self.percent, self.root, self.sizes = percent, _Node(np.zeros(0, np.uint64)), {}
        self.parent = groups

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def _uniform(self, node: _Node) -> bool:
        """Whether all sets below are in one component; unions only add to that, so the answer is kept once true."""
        if not node.uniform:
            own = self.find(node.some)
            node.uniform = all(c.uniform and self.find(c.some) == own for c in node.children.values()) and all(self.find(e) == own for e in node.ends)
        return node.uniform

    def join(self, i: int, x: np.ndarray, n: int) -> list[int]:
        """Sets within the threshold of ``x`` (of size ``n``, members of its own included) in other components; unites them with ``i``."""
        found, t = [], self.percent
        stack = [(self.root, 0)]
        while stack:
            node, overlap = stack.pop()
            if node.some < 0 or self._uniform(node) and self.find(node.some) == self.find(i):
                continue
            if 100 * node.most < t * n or 100 * n < t * node.least:
                continue
            need, below = -(-t * (n + node.least) // (100 + t)), node.longest
            for low in range(0, len(node.piece), self.PIECE):
                piece = node.piece[low : low + self.PIECE]
                at = np.searchsorted(x, piece)
                overlap += int((x[np.minimum(at, len(x) - 1)] == piece).sum()) if len(x) else 0
                below -= len(piece)
                # After this piece x has len(x) - at[-1] members left, and a set below at most ``below``.
                if overlap + min(len(x) - int(at[-1]), below) < need:
                    break
            else:
                for e in node.ends:
                    if self.find(e) != self.find(i) and overlap * (100 + t) >= t * (n + self.sizes[e]):
                        found.append(e)
                        self.parent[self.find(e)] = self.find(i)
                stack.extend((c, overlap) for c in node.children.values())
        return found

    def add(self, i: int, x: np.ndarray, n: int) -> None:
        node, self.sizes[i], at = self.root, n, 0
        self._note(node, i, len(x))
        while at < len(x):
            child = node.children.get(int(x[at]))
            if child is None:
                child = node.children[int(x[at])] = _Node(x[at:])
                self._note(child, i, len(x) - at)
                child.ends.append(i)
                return
            m = min(len(child.piece), len(x) - at)
            odd = np.flatnonzero(child.piece[:m] != x[at : at + m])
            m = int(odd[0]) if len(odd) else m
            if m < len(child.piece):
                upper = _Node(child.piece[:m])
                upper.least, upper.most, upper.longest, upper.some, upper.uniform = child.least, child.most, child.longest, child.some, child.uniform
                child.piece, child.longest = child.piece[m:], child.longest - m
                upper.children[int(child.piece[0])] = child
                node.children[int(x[at])] = child = upper
            self._note(child, i, len(x) - at)
            node, at = child, at + m
        node.ends.append(i)

    def _note(self, node: _Node, i: int, left: int) -> None:
        if node.some < 0:
            node.some = i
        elif node.uniform and self.find(node.some) != self.find(i):
            node.uniform = False
        n = self.sizes[i]
        node.least, node.most, node.longest = min(node.least, n), max(node.most, n), max(node.longest, left)


def _tree_links(table: pa.Table, percent: int) -> pa.Table:
    k, tie = table.column("k").to_numpy(), table.column("tie").to_numpy()
    sizes, members = table.column("n").to_pylist(), _arrays(table.column("members"))
    groups: dict = {}
    labels = zip(table.column("rk").to_pylist(), table.column("rt").to_pylist(), strict=True)
    parent = [i if label[0] is None else groups.setdefault(label, i) for i, label in enumerate(labels)]
    tree, a, b = PrefixTree(percent, parent), [], []
    for i in np.lexsort((tie, k)).tolist():
        for j in tree.join(i, members[i], sizes[i]):
            a.append(i)
            b.append(j)
        tree.add(i, members[i], sizes[i])
    return pa.table({"ak": k[a], "at": tie[a], "bk": k[b], "bt": tie[b]} if a else {c: pa.array([], pa.int64()) for c in ("ak", "at", "bk", "bt")})

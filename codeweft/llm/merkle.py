"""Merkle manifest of a table: a ternary hash tree per group of rows, and one above the groups' roots.

A tree of any size is cut into aligned blocks of 3**HEIGHT leaves. A block is one group of a shuffle and one row of a table: its
digests lie in one binary in van Emde Boas order, that is, the upper half of its levels first and then each subtree of the lower
half, every part laid out the same way. ``addresses`` computes the place of a node from its depth and index; construction reads
children and writes parents through it, and siblings are found through it. Block roots are the leaves of the next round, until
each tree is one block. Proofs go the other way: the siblings of a block's root are handed down to the block's leaves.

A node is the hash of up to three consecutive children, digests as lowercase hex; a last run may hold fewer, even one. Leaves are
numbered over range partitions, so a group that holds most rows is many blocks and no task owns it.

Defined results: a null value of a row is hashed as ``-``; rows without a group form one, before all others; rows without an
order key come first; rows that repeat are leaves of their own, equal keys ordered by digest; a group of one row is its leaf; no
rows give no result. Other columns of the input are not read, whatever their names, except those named in ``carry``, which
travel in a struct.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeweft.operators.chunking import number_rows
from codeweft.session import cut

FAN = 3
#: Levels below the root of a block: 6,561 leaves and 9,841 digests, 315 kB.
HEIGHT = 8
DIGEST = 32


def digest(values: list[Column]) -> Column:
    """SHA-256, lowercase hex, of the values in order: ``-`` for null, else the length in UTF-8 bytes, ``:`` and the text."""
    parts = []
    for value in values:
        text = value.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat(*parts).cast("binary"), 256)


@dataclass
class Manifest:
    """Tables of a manifest. ``rounds`` and ``tops`` go from the leaves up; a row of them is one block.

    ``leaves(tree, block, slot, leaf, claimed, row)``, blocks ``(tree, block, n, root, store)``, ``groups(tree, ordinal,
    subroot)``. ``tree`` is the group's text behind ``=``, or empty for the rows without a group.
    """

    leaves: DataFrame
    rounds: list[DataFrame]
    groups: DataFrame
    tops: list[DataFrame]
    height: int

    def subroots(self) -> DataFrame:
        """``tree, subroot`` of every group."""
        return self.groups.select("tree", F.lower(F.hex("subroot")).alias("subroot"))

    def root(self) -> DataFrame:
        """One row ``root``, or none for an empty table."""
        return self.tops[-1].select(F.lower(F.hex("root")).alias("root"))


def build(rows: DataFrame, leaf: Column, group: Column, order: Column, claimed: Column | None = None, carry: tuple[str, ...] = (), height: int = HEIGHT) -> Manifest:
    """Manifest of ``rows``: ``leaf`` is a row's digest (see ``digest``), trees are per ``group``, leaves ascend by ``order``.

    ``claimed`` is a digest to be tested against the manifest later on (the row's own, if null or not given). Blocks have
    ``height`` levels below their roots.
    """
    span = FAN**height
    own = F.unhex(leaf)
    tested = own if claimed is None else F.coalesce(F.unhex(claimed), own)
    tree = F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit(""))
    carried = F.struct(*[rows[c].alias(c) for c in carry]) if carry else F.lit(None).cast("struct<none:int>")
    # Kept as a table: the texts are hashed once, and the running number makes rows that are equal spread all the same.
    table = cut(rows.select(tree.alias("tree"), order.alias("by"), own.alias("leaf"), tested.alias("claimed"), carried.alias("row"), F.monotonically_increasing_id().alias("nth")))
    leaves = cut(_in_blocks(number_rows(table, ["by", "leaf", "nth"], group="tree"), span).select("tree", "block", "slot", "leaf", "claimed", "row"))
    rounds = _forest(leaves.select("tree", "block", "slot", F.col("leaf").alias("digest")), height)
    roots = rounds[-1].select(F.lit("").alias("all"), "tree", F.col("root").alias("subroot"))
    groups = cut(number_rows(roots, ["tree"], group="all").select("tree", "ordinal", "subroot"))
    tops = _forest(_in_blocks(groups, span).select(F.lit("").alias("tree"), "block", "slot", F.col("subroot").alias("digest")), height)
    return Manifest(leaves, rounds, groups, tops, height)


def prove(manifest: Manifest) -> DataFrame:
    """Every leaf with its proof and the root that its claimed digest leads to.

    ``tree, leaf, subroot, root, siblings, sides, folded, verified, row``: ``siblings`` are the digests of the runs' other
    members, level by level up to the root, left to right; a byte of ``sides`` per level is 3 * those on the left + those on the
    right. ``folded`` is the root recomputed from the claimed digest and the siblings.
    """
    none, height = F.lit(b""), manifest.height
    above = manifest.tops[-1].select("tree", "block", none.alias("siblings"), none.alias("sides"), none.alias("subroot"), F.col("root").alias("top"))
    for store in reversed(manifest.tops):
        above = _handed_down(store, above, height)
    groups = manifest.groups.select(F.col("ordinal").alias("block"), F.col("tree").alias("name"), F.col("subroot").alias("own"))
    above = above.join(groups, "block").select(F.col("name").alias("tree"), F.lit(0).cast("long").alias("block"), "siblings", "sides", F.col("own").alias("subroot"), "top")
    for store in reversed(manifest.rounds[1:]):
        above = _handed_down(store, above, height)
    blocks = manifest.rounds[0].join(above, ["tree", "block"])
    kind = manifest.leaves.schema["row"].dataType.simpleString()
    schema = f"tree string, leaf string, subroot string, root string, siblings binary, sides binary, folded string, verified boolean, row {kind}"
    by = ["tree", "block"]
    return manifest.leaves.groupBy(by).cogroup(blocks.groupBy(by)).applyInArrow(lambda leaves, blocks: _prove_block(leaves, blocks, height), schema)


def _in_blocks(rows: DataFrame, span: int) -> DataFrame:
    return rows.withColumn("block", F.expr(f"ordinal div {span}")).withColumn("slot", (F.col("ordinal") % span).cast("int"))


def _forest(nodes: DataFrame, height: int) -> list[DataFrame]:
    """Block tables of all trees, round by round; a round holds 1 / 3**height of the rows of the one before, the last one row a tree."""
    rounds = []
    while True:
        schema = "tree string, block long, n int, root binary, store binary"
        rounds.append(cut(nodes.groupBy("tree", "block").applyInArrow(lambda block: _build_block(block, height), schema)))
        if rounds[-1].filter("block > 0").isEmpty():
            return rounds
        nodes = _in_blocks(rounds[-1].select("tree", F.col("block").alias("ordinal"), F.col("root").alias("digest")), FAN**height)


def _handed_down(store: DataFrame, above: DataFrame, height: int) -> DataFrame:
    """``tree, block, siblings, sides, subroot, top`` of the blocks one round below, given those of the blocks of ``store``."""
    rows = store.select("tree", "block", "n", "store").join(above, ["tree", "block"])
    return rows.mapInArrow(lambda batches: _paths_of_blocks(batches, height), "tree string, block long, siblings binary, sides binary, subroot binary, top binary")


def size(levels: int) -> int:
    """Nodes of a complete tree of that many levels."""
    return (FAN**levels - 1) // (FAN - 1)


def addresses(levels: int, depth: int, index: np.ndarray) -> np.ndarray:
    """Places, in van Emde Boas order, of the nodes ``index`` at ``depth`` of a complete tree of ``levels`` levels."""
    at = np.zeros(len(index), np.int64)
    while levels > 1:
        upper = levels // 2
        if depth < upper:
            levels = upper
            continue
        depth, levels = depth - upper, levels - upper
        subtree, index = np.divmod(index, FAN**depth)
        at += size(upper) + subtree * size(levels)
    return at


def _levels(block: int, n: int, height: int) -> int:
    """Levels above the leaves of a block: all of them, unless it is a whole tree by itself."""
    if block or n == FAN**height:
        return height
    levels = 0
    while FAN**levels < n:
        levels += 1
    return levels


def _counts(levels: int, n: int) -> list[int]:
    """Nodes at each depth of a block with ``n`` leaves, the root's first."""
    counts = [n]
    for _ in range(levels):
        counts.append(-(-counts[-1] // FAN))
    return counts[::-1]


def _build_block(nodes: pa.Table, height: int) -> pa.Table:
    tree, block, n = nodes["tree"][0].as_py(), nodes["block"][0].as_py(), nodes.num_rows
    order = np.argsort(nodes["slot"].to_numpy())
    height = _levels(block, n, height)
    counts = _counts(height, n)
    store = np.zeros((size(height + 1), DIGEST), np.uint8)
    leaves = np.frombuffer(b"".join(nodes["digest"].to_pylist()), np.uint8).reshape(n, DIGEST)
    store[addresses(height + 1, height, np.arange(n))] = leaves[order]
    for depth in range(height, 0, -1):
        children = store[addresses(height + 1, depth, np.arange(counts[depth]))].tobytes().hex().encode()
        run = 2 * DIGEST * FAN
        parents = b"".join(sha256(children[i : i + run]).digest() for i in range(0, len(children), run))
        store[addresses(height + 1, depth - 1, np.arange(counts[depth - 1]))] = np.frombuffer(parents, np.uint8).reshape(-1, DIGEST)
    return pa.table({"tree": [tree], "block": pa.array([block], pa.int64()), "n": pa.array([n], pa.int32()), "root": [store[0].tobytes()], "store": [store.tobytes()]})


def _paths(block: int, n: int, store: bytes, siblings: bytes, sides: bytes, height: int) -> tuple[list[bytes], list[bytes]]:
    """Siblings and sides of every leaf of a block up to the root of all; those of the block's root are given."""
    height = _levels(block, n, height)
    held, sided = [siblings], [sides]
    for depth, count in enumerate(_counts(height, n)[1:], 1):
        places = (addresses(height + 1, depth, np.arange(count)) * DIGEST).tolist()
        own, side = [], []
        for start in range(0, count, FAN):
            run = [store[at : at + DIGEST] for at in places[start : start + FAN]]
            rest, turned = held[start // FAN], sided[start // FAN]
            for i in range(len(run)):
                own.append(b"".join([*run[:i], *run[i + 1 :], rest]))
                side.append(bytes([FAN * i + len(run) - 1 - i]) + turned)
        held, sided = own, side
    return held, sided


def _paths_of_blocks(batches: Iterator[pa.RecordBatch], height: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            n, first = row["n"], row["block"] * FAN**height
            siblings, sides = _paths(row["block"], n, row["store"], row["siblings"], row["sides"], height)
            yield pa.record_batch(
                {
                    "tree": pa.array([row["tree"]] * n, pa.string()), "block": pa.array(range(first, first + n), pa.int64()),
                    "siblings": pa.array(siblings, pa.binary()), "sides": pa.array(sides, pa.binary()),
                    "subroot": pa.array([row["subroot"]] * n, pa.binary()), "top": pa.array([row["top"]] * n, pa.binary()),
                }
            )


def fold(digest_: bytes, siblings: bytes, sides: bytes) -> bytes:
    """The root that a leaf's digest and its proof lead to."""
    at, shown, names = 0, digest_.hex(), siblings.hex()
    for side in sides:
        left, right = divmod(side, FAN)
        middle, end = at + 2 * DIGEST * left, at + 2 * DIGEST * (left + right)
        shown = sha256((names[at:middle] + shown + names[middle:end]).encode()).hexdigest()
        at = end
    return bytes.fromhex(shown)


def _prove_block(leaves: pa.Table, blocks: pa.Table, height: int) -> pa.Table:
    block = blocks.to_pylist()[0]
    siblings, sides = _paths(block["block"], block["n"], block["store"], block["siblings"], block["sides"], height)
    slots = leaves["slot"].to_pylist()
    siblings, sides = [siblings[s] for s in slots], [sides[s] for s in slots]
    folded = [fold(claimed, a, b) for claimed, a, b in zip(leaves["claimed"].to_pylist(), siblings, sides, strict=True)]
    n, root = len(slots), block["top"]
    return pa.table(
        {
            "tree": leaves["tree"], "leaf": pa.array([x.hex() for x in leaves["leaf"].to_pylist()], pa.string()),
            "subroot": pa.array([block["subroot"].hex()] * n, pa.string()), "root": pa.array([root.hex()] * n, pa.string()),
            "siblings": pa.array(siblings, pa.binary()), "sides": pa.array(sides, pa.binary()),
            "folded": pa.array([x.hex() for x in folded], pa.string()), "verified": pa.array([x == root for x in folded], pa.bool_()), "row": leaves["row"],
        }
    )

"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweft.session import cut


def stored(df: DataFrame, parts: int) -> DataFrame:
    """``cut`` into ``parts`` files. Small tables of many tiny files cost a process start per file on plain file systems."""
    return cut(df.repartition(parts))


def components(links: DataFrame, parts: int = 8) -> DataFrame:
    """``node, root`` for every node of ``links(a, b)``: the root is the component's smallest node.

    ``parts`` is the number of files of each step's table.

    Alternating stars: each step hangs a node's larger (then smaller) neighbours below its smallest one, until every node
    points at its root. A step is two joins on nodes; its result is a table, so lineage does not grow.
    """
    edges = stored(_ordered(links), parts)
    print_of = _print(edges)
    while print_of[0]:
        edges = stored(_star(_star(edges, larger=True), larger=False), parts)
        now = _print(edges)
        if now == print_of:
            break
        print_of = now
    roots = edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
    return roots.unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())


def _ordered(links: DataFrame) -> DataFrame:
    """Each link once, from the smaller node ``a`` to the larger ``b``."""
    return links.filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    if larger:
        # Every node with all its neighbours; the larger ones move to the smallest of the neighbourhood.
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        moved = edges.join(least, "a").select(F.col("m").alias("a"), "b")
    else:
        # Every node with its smaller neighbours; they and the node move to the smallest of them.
        least = edges.groupBy("b").agg(F.min("a").alias("m"))
        moved = edges.join(least, "b").select(F.explode(F.array("a", "b")).alias("b"), F.col("m").alias("a"))
    return _ordered(moved)


def _print(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)

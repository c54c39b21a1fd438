"""Connected components of an edge list, by alternating large and small stars."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritab.llm.common import cut

EDGES_A_TASK = 1 << 18


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` of every node of ``edges (a, b)``; the root is the smallest node of its component.

    A round points every larger neighbour of a node, then every smaller one, to the smallest
    neighbour. Minima are combined before the shuffle, so a hub of many edges gathers nothing.
    Rounds grow with the logarithm of the longest path. Loops and null ends are left out.
    A round runs in as many tasks as its edges need (``EDGES_A_TASK`` each) where partitions are more: each task of each
    shuffle writes files of its own, and many rounds of many almost empty ones fill the disk.
    """
    ordered = lambda df: df.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = cut(ordered(edges.select("a", "b")))
    print_of = lambda df: tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
    before, mark = None, print_of(now)
    few = lambda df: df.coalesce(max(1, -(-2 * mark[0] // EDGES_A_TASK)))
    now = few(now)
    while mark != before:
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = few(ordered(few(both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")))))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = few(large.join(least, "a"))
        now = cut(few(ordered(joined.select("a", F.col("m").alias("b")).union(joined.select(F.col("b").alias("a"), F.col("m").alias("b"))))))
        before, mark = mark, print_of(now)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(few(now.select("b", "b").distinct()))


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the links ``(a, b)`` and the least node that each is connected with."""
    nodes, ends = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = ends[:len(a)], ends[len(a):]
    root = np.arange(len(nodes))
    while True:
        before = root.copy()
        least = np.minimum(root[x], root[y])
        np.minimum.at(root, x, least)
        np.minimum.at(root, y, least)
        root = root[root]
        if np.array_equal(root, before):
            return nodes, nodes[root]

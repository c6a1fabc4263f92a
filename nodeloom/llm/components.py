"""Connected components of a link table, by hooking and contraction over joins."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


#: Links held before they are thinned; a forest of over half as many is given out.
HELD_LINKS = 1 << 18


def spanning(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Places of links that are a spanning forest of all: each tree takes its first link that leads out, until none does."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root, live, chosen = np.arange(len(nodes)), np.arange(len(a)), []
    while True:
        rx, ry = root[x[live]], root[y[live]]
        out = rx != ry
        live, rx, ry = live[out], rx[out], ry[out]
        if not len(live):
            return np.sort(np.concatenate([np.zeros(0, np.int64), *chosen]))
        first = np.full(len(nodes), len(live))
        np.minimum.at(first, rx, np.arange(len(live)))
        np.minimum.at(first, ry, np.arange(len(live)))
        own = np.flatnonzero(first < len(live))
        link = first[own]
        chosen.append(live[np.unique(link)])
        up = np.arange(len(nodes))
        up[own] = rx[link] + ry[link] - own
        twins = own[(up[up[own]] == own) & (own < up[own])]  # two trees that take the same link
        up[twins] = twins
        while (up[up] != up).any():
            up = up[up]
        root = up[root]


def thinned(links):
    """Pairs of arrays (a, b) to record batches with the same components: of all links of a task a spanning forest, so
    that a task makes fewer rows than its links have nodes, however many listings join them. Beyond ``HELD_LINKS`` / 2 links a forest is given out early.
    """

    def batch(a, b):
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    def thin():
        x, y = (np.concatenate(z) for z in zip(*held, strict=True))
        at = spanning(x, y)
        return x[at], y[at]

    held, n = [], 0
    for pair in links:
        held.append(pair)
        n += len(pair[0])
        if n > HELD_LINKS or len(held) > HELD_LINKS:
            a, b = thin()
            if 2 * len(a) > HELD_LINKS:
                yield batch(a, b)
                a = b = np.zeros(0, np.int64)
            held, n = [(a, b)], len(a)
    if held:
        yield batch(*thin())


def components(links: DataFrame, most_rounds: int = 64) -> DataFrame:
    """(a long, b long) to (node, component): the smallest node reachable, for each node with a link.

    A round hooks each root to its smallest neighbour, halves the paths and replaces the links by those between
    roots; links within a tree go. Sums and joins run on node ids only, one side of each join is unique, and the
    tables of a round are written to the shared folder. The number of rounds grows with the logarithm of the longest path.
    """
    spark = links.sparkSession
    links, at = common.store(links.select("a", "b").where(F.col("a") != F.col("b")).distinct(), "links")
    nodes, nodes_at = common.store(links.select("a").union(links.select("b")).distinct().select(F.col("a").alias("node"), F.col("a").alias("root")), "nodes")
    for _ in range(most_rounds):
        if links.isEmpty():
            return nodes.select("node", F.col("root").alias("component"))
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("child"), F.least("a", "low").alias("up"))
        hook, hook_at = common.store(hook, "hooks")
        above = hook.select(F.col("child").alias("up"), F.col("up").alias("top"))
        jump, jump_at = common.store(hook.join(above, "up").select("child", "top"), "hooks")
        above = jump.select(F.col("child").alias("top"), F.col("top").alias("highest"))
        jump, jump2_at = common.store(jump.join(above, "top").select("child", F.col("highest").alias("top")), "hooks")
        a, b = jump.select(F.col("child").alias("a"), F.col("top").alias("ra")), jump.select(F.col("child").alias("b"), F.col("top").alias("rb"))
        pairs = links.join(a, "a").join(b, "b").where(F.col("ra") != F.col("rb"))
        links, new_at = common.store(pairs.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "links")
        moved = nodes.join(jump.select(F.col("child").alias("root"), "top"), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
        nodes, new_nodes = common.store(moved, "nodes")
        for old in (at, nodes_at, hook_at, jump_at, jump2_at):
            common.discard(spark, old)
        at, nodes_at = new_at, new_nodes
    raise RuntimeError(f"links are left after {most_rounds} rounds")

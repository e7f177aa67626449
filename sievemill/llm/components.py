"""Connected components of a graph given as edges, by alternating star contraction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievemill.llm.common import drop_stash, stash

#: Graphs of at most so many edges are one task's work.
FEW = 100_000


def union(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(node, root) of all edges of a small graph, by joining trees of parents."""
    above: dict[int, int] = {}

    def top(x: int) -> int:
        while above[x] != x:
            above[x] = above[above[x]]
            x = above[x]
        return x

    for batch in batches:
        for a, b in zip(batch["a"].tolist(), batch["b"].tolist(), strict=True):
            above.setdefault(a, a)
            above.setdefault(b, b)
            x, y = top(a), top(b)
            if x != y:
                above[max(x, y)] = min(x, y)
    nodes = np.fromiter(above, np.int64, len(above))
    yield pd.DataFrame({"node": nodes, "root": np.array([top(x) for x in above], np.int64)})


def components(edges: DataFrame) -> DataFrame:
    """(node, root): each node of edges (columns a, b: longs) with the smallest node of its component.

    A graph of at most ``FEW`` edges is joined up in one task. In a larger one each round hangs the larger neighbours of every node under its smallest neighbour (large star), then the smaller
    ones (small star); the number of rounds is about the logarithm of the longest path. A node's smallest neighbour comes
    from an aggregate with partial sums and is joined back, so no neighbour list is ever built. Every round is written to
    the shared folder. Ends when a round changes nothing."""
    now = stash(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    if now.count() <= FEW:
        return now.repartition(1).mapInPandas(union, "node bigint, root bigint")
    state = signature(now)
    while True:
        large = star(now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b"))), larger=True)
        small = stash(star(large, larger=False), "edges")
        drop_stash(now)
        now, before, state = small, state, signature(small)
        if state == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()


def star(edges: DataFrame, larger: bool) -> DataFrame:
    """Edges (a > b). larger: from edges both ways, every node ties its larger neighbours to its least one (or itself).
    Else, from edges a > b, every node ties itself and its smaller neighbours to its least one."""
    least = edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
    both = edges.join(least, F.col("a") == F.col("n"))
    if larger:
        out = both.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = both.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select(F.col("n").alias("a"), F.col("m").alias("b")))
    return out.filter("a <> b").distinct()


def signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

"""Connected components of a graph given as a table of edges, by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's edges to as few that connect the same nodes: each node and the least of its component here."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (up := parent.setdefault(top, top)) != top:
            top = up
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            x, y = root(a), root(b)
            if x < y:
                parent[y] = x
            elif y < x:
                parent[x] = y
    low = [(x, root(x)) for x in parent]
    low = [(x, r) for x, r in low if x != r]
    for i in range(0, len(low), 100_000):
        part = low[i : i + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in part], pa.int64()), pa.array([r for _, r in part], pa.int64())], ["u", "v"])


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, label for every node that has an edge: label is the least node of its component.

    First every partition of edges becomes a forest, so what is shuffled is bounded by nodes, not edges (edges that
    were found together mostly lie together). Each round is two aggregations and joins on narrow rows, and ends in a written table. No node's neighbours are ever
    gathered. The number of rounds grows with the logarithm of the longest path.
    """
    forest = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).mapInArrow(_forest, "u long, v long")
    stars = written(forest.distinct(), "edges")
    told = None
    while True:
        # large star: neighbours above a node are tied to its least neighbour
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: a node and its neighbours below are tied to the least of these
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select("v", "u", "m").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        stars = written(small.unionByName(low.select("u", F.col("m").alias("v"))).where("u != v").distinct(), "edges")
        now = stars.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == told:
            break
        told = now
    rooted = stars.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return rooted.unionByName(rooted.select(F.col("label").alias("node"), "label").distinct())

"""Connected components of an edge table, in Spark."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Links that one task reduces at a time.
CHUNK = 100_000


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of a bounded chunk as stars: every node to the lowest node it reaches within the chunk."""
    head: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while head.setdefault(root, root) != root:
            root = head[root]
        while head[x] != root:
            head[x], x = root, head[x]
        return root

    def stars() -> pa.RecordBatch:
        found = [(find(x), x) for x in head]
        found = [(a, b) for a, b in found if a != b]
        head.clear()
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    seen = 0
    for batch in batches:
        for x, y in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            x, y = find(x), find(y)
            if x != y:
                head[max(x, y)] = min(x, y)
        seen += len(batch)
        if seen >= CHUNK:
            yield stars()
            seen = 0
    yield stars()


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b): label is the lowest node of its component.

    Links are first reduced to stars in chunks of bounded size, which leaves each chunk no more links than nodes.
    Then alternating stars: every larger neighbour is linked to a node's lowest neighbour, then every node and its
    smaller neighbours are.  These steps are joins and minima; each round is checkpointed, and the number of rounds
    grows with the logarithm of the largest component.  Repeated links do no harm; a node that is linked with
    itself alone is its own label."""
    links = cut(edges.select(F.least("a", "b").cast("long").alias("a"), F.greatest("a", "b").cast("long").alias("b")).distinct())
    n = links.count()
    alone = links.where("a = b").select(F.col("a").alias("node"), F.col("a").alias("label"))
    current = cut(links.where("a < b").repartition(-(-max(n, 1) // CHUNK)).mapInArrow(_forests, "a long, b long").distinct())

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    before = state(current)
    while True:
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        # larger neighbours of a node go to its lowest
        large = (both.where("b > a").join(lowest, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .unionByName(lowest.where("m < a").select("a", F.col("m").alias("b"))).distinct())
        # every node (the larger end of a link) and its smaller neighbours go to the lowest of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        current = cut(large.join(low, "a").where("b > m").select(F.col("m").alias("a"), "b")
                      .unionByName(low.select(F.col("m").alias("a"), F.col("a").alias("b"))).distinct())
        now = state(current)
        if now == before:
            break
        before = now
    # stars: every link goes from a component's lowest node to another
    return (current.select(F.col("b").alias("node"), F.col("a").alias("label"))
            .unionByName(current.select(F.col("a").alias("node"), F.col("a").alias("label"))).unionByName(alone)
            .groupBy("node").agg(F.min("label").alias("label")))

"""Connected components of a large set of links: union-find inside tasks, then stars across them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tickerloom.llm.store import kept


def forest(batches: Iterator[pa.RecordBatch], most: int = 500_000) -> Iterator[pa.RecordBatch]:
    """Replace the links of a task by (node, smallest node joined to it), in tables of bounded size."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = parent.setdefault(x, x)
        while parent[top] != top:
            parent[top] = parent[parent[top]]
            top = parent[top]
        parent[x] = top
        return top

    def made() -> pa.RecordBatch:
        pairs = [(x, root(x)) for x in parent]
        pairs = [(x, r) for x, r in pairs if x != r]
        return pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in pairs], pa.int64()), "b": pa.array([r for _, r in pairs], pa.int64())})

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        if len(parent) > most:
            yield made()
            parent.clear()
    yield made()


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every node in ``links`` (a, b): label is the smallest node that can be reached.

    Each turn hangs every neighbour on the smallest one, first from above and then from below, which
    needs a number of turns that grows with the logarithm of the longest chain.  A node with very many
    links is reduced before the shuffle, and joins split it.
    """
    edges = kept(links.mapInArrow(forest, "a long, b long").distinct(), "forest")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("low"))
        small = (large.join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b")
                 .unionByName(least.select("a", F.col("low").alias("b"))).distinct())
        edges = kept(small, "stars")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("label"))).distinct()

"""Connected components of an edge table, by union-find in partitions and large-star / small-star rounds between them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.session import join_hot, settle

_EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def union_find(a: list[int], b: list[int]) -> dict[int, int]:
    """Node to smallest node of its component."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while parent.setdefault(top, top) != top:
            top = parent[top]
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for x, y in zip(a, b):
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    return {x: root(x) for x in list(parent)}


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace the edges of every million rows by a star around the smallest node of each local component."""

    def star(a: list[int], b: list[int]) -> pa.RecordBatch:
        found = union_find(a, b)
        nodes = np.fromiter(found.keys(), np.int64, len(found))
        roots = np.fromiter(found.values(), np.int64, len(found))
        keep = nodes != roots
        return pa.RecordBatch.from_arrays([pa.array(roots[keep]), pa.array(nodes[keep])], schema=_EDGES)

    a: list[int] = []
    b: list[int] = []
    for batch in batches:
        a += batch.column(0).to_pylist()
        b += batch.column(1).to_pylist()
        if len(a) > 1_000_000:
            yield star(a, b)
            a, b = [], []
    if a:
        yield star(a, b)


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One round. Large: each node links its larger neighbours to its smallest neighbour. Small: each node links its
    smaller neighbours and itself to the smallest."""
    both = edges.select("a", "b")
    if large:
        both = both.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = settle(both.groupBy("a").agg(F.min("b").alias("low"), F.count("*").alias("degree")))
    low = low.withColumn("low", F.least("low", "a"))
    linked = join_hot(both, low, "a", "degree", F.col("b"))
    if large:
        out = linked.where("b > a").select("low", "b")
    else:
        out = linked.select("low", "b").unionByName(low.select("low", F.col("a").alias("b")))
    return out.where("low <> b").select(F.col("low").alias("a"), "b").distinct()


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, component: the smallest node of its component, for every node of the columns a and b (long). Loops and
    repeated edges do no harm; null ends are dropped; no edges give no rows. Only counts reach the driver."""
    edges = edges.where("a is not null and b is not null and a <> b").select(F.least("a", "b").cast("long").alias("a"), F.greatest("a", "b").cast("long").alias("b"))
    edges = settle(edges.mapInArrow(_local, "a long, b long").distinct())
    for _ in range(most_rounds):
        # a forest of stars is reached when no child is a parent and no child has two parents
        state = edges.select(F.col("b").alias("node"), F.lit(1).alias("child"), F.lit(0).alias("parent")).unionByName(edges.select(F.col("a").alias("node"), F.lit(0).alias("child"), F.lit(1).alias("parent")).distinct())
        bad = state.groupBy("node").agg(F.sum("child").alias("child"), F.sum("parent").alias("parent")).where("child > 1 or (child > 0 and parent > 0)")
        if bad.isEmpty():
            return edges.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
        edges = settle(_star(settle(_star(edges, True)), False))
    raise RuntimeError(f"no convergence after {most_rounds} rounds")

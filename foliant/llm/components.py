"""Connected components by alternating large and small stars over a distributed edge table.

Each task first replaces edges that it has at hand by stars with the same
components, a bounded number at a time, so that few rounds are left and most
small tables need none. Every round is two grouped minima (combined before the shuffle) and two
joins with one row per node on one side, so that a hub node which holds a
third of all edges is a skewed join that adaptive execution splits. The
edge table is written to the shared folder after each round, and so is the
result: plans that read it stay small.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.shared import materialize, release

#: Edges that a task contracts at a time.
AT_ONCE = 1 << 20


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node of its component) of the edges' nodes but the least ones."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while len(x):
        low, high = np.minimum(root[x], root[y]), np.maximum(root[x], root[y])
        apart = low < high
        x, y, low, high = x[apart], y[apart], low[apart], high[apart]
        np.minimum.at(root, high, low)  # roots follow smaller ones, so that there are no circles
        while (root[root] != root).any():
            root = root[root]
    own = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[own], nodes[root[own]]


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges (a, b) of a task as stars of their components, at most about AT_ONCE edges at a time."""
    held = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for batch in batches:
        held.append(tuple(batch.column(c).to_numpy() for c in ("a", "b")))
        if sum(len(a) for a, _ in held) >= AT_ONCE:
            held = [stars(*map(np.concatenate, zip(*held)))]
            if len(held[0][0]) >= AT_ONCE // 2:
                yield pa.RecordBatch.from_arrays(list(map(pa.array, held.pop())), ["a", "b"])
                held = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    yield pa.RecordBatch.from_arrays(list(map(pa.array, stars(*map(np.concatenate, zip(*held))))), ["a", "b"])


def _settled(edges: DataFrame) -> bool:
    """Whether each node leads to one other alone, which leads to none."""
    ends = edges.select(F.col("a").alias("node"), F.col("b").alias("to")).union(edges.select("b", F.lit(None).cast("long")))
    found = ends.groupBy("node").agg(F.min("to").alias("low"), F.max("to").alias("high"), F.count("*").alias("n"), F.count("to").alias("out"))
    return found.filter("low <> high or (out > 0 and n > out)").count() == 0


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of the edges (a, b), longs; component is the least node reachable.

    Edges from a node to itself and repeated edges are allowed, nulls are
    dropped. Without edges the result is empty.
    """
    contracted = lambda df: materialize(df.mapInArrow(_contracted, "a long, b long"), "edges")
    loops = edges.filter("a = b").select(F.col("a").alias("node"))
    edges = contracted(edges.filter("a <> b").select(F.col("a").cast("long"), F.col("b").cast("long")))
    while not _settled(edges):
        older, edges = edges, contracted(_small_star(_large_star(edges)))
        release(older)
    linked = edges.select(F.col("a").alias("node"), F.col("b").alias("component")).distinct()
    roots = edges.select(F.col("b").alias("node")).union(loops).distinct().join(linked, "node", "left_anti")
    joined = materialize(linked.union(roots.select("node", F.col("node").alias("component"))), "components")
    release(edges)
    return joined


def joined_further(joined: DataFrame, links: DataFrame) -> DataFrame:
    """(node, component) of connected_components() after links (a, b) between components, or single nodes, are added."""
    again = connected_components(links).toDF("component", "_to")
    moved = joined.join(again, "component", "left").select("node", F.coalesce("_to", "component").alias("component"))
    alone = again.join(joined.select(F.col("node").alias("component")), "component", "left_anti")
    return moved.union(alone.select(F.col("component").alias("node"), F.col("_to").alias("component")))

"""Connected components of an edge table, by alternating large-star and small-star steps.

Edges are first contracted within tasks, where a union-find over some 2^19 edges turns them to stars. Edges that
fit one union-find are whole components after it; more go on by steps, until what is left fits one. Each step is
one grouped minimum and one join, both partially aggregated or splittable; a task never gathers more edges than
one union-find takes. Every round is written to the shared folder, so lineage stays short.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.llm import frames

_HELD = 1 << 19  # edges that one union-find takes


def stars(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    """Edges (u, v) that join the same nodes as those given: each to the least node that these lead it to."""
    names, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(names))
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        for side in (a, b):
            np.minimum.at(root, root[side], low)
            np.minimum.at(root, side, low)
        root = root[root]
        if (root == before).all():
            break
    far = np.flatnonzero(root != np.arange(len(names)))
    return pa.RecordBatch.from_arrays([pa.array(names[far]), pa.array(names[root[far]])], names=["u", "v"])


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stars in place of a partition's edges, some hundred thousand edges at a time."""
    held: list[pa.RecordBatch] = []
    size = 0

    def flush() -> pa.RecordBatch:
        return stars(*(np.concatenate([x.column(c).to_numpy() for x in held]) for c in (0, 1)))

    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= _HELD:
            yield flush()
            held, size = [], 0
    if held:
        yield flush()


def _merged(edges: DataFrame) -> DataFrame:
    """Settled edges, contracted by as few tasks as their number asks for; by one, they are whole components."""
    tasks = -(-edges.count() // _HELD)
    out = frames.settled(edges.coalesce(max(tasks, 1)).mapInArrow(frames.task(_contracted, __name__), "u long, v long"), "edges")
    frames.discard(edges)
    return out


def _star(edges: DataFrame, large: bool) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near = both if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = near.join(least, "u")
    if large:
        out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of edges (u, v long): component is its component's least node.

    Loops, repeated edges and edges with a null end say nothing and may occur; nodes without any other
    edge are left out. No edges give no rows. Raises if `rounds` do not make every component whole.
    """
    own = edges.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").cast("long").alias("u"), F.least("u", "v").cast("long").alias("v"))
    edges = _merged(frames.settled(own, "edges"))
    for k in range(rounds + 1):
        # stars whose leaves have one centre each, and whose centres are no leaves, are whole components
        leaves = edges.select("u").distinct()
        open_ends = edges.groupBy("u").count().where("count > 1").select("u").unionByName(edges.select(F.col("v").alias("u")).distinct().join(leaves, "u", "left_semi"))
        if open_ends.isEmpty():
            break
        if k == rounds:
            raise RuntimeError(f"components are not whole after {rounds} rounds")
        edges = _merged(frames.settled(_star(_star(edges, True), False), "edges"))
    least = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(least)

"""Connected components of edges that need not fit one machine.

Each partition first contracts its own edges to stars (union-find over that partition). The stars are
then joined by alternating large-star and small-star steps, which end after a number of rounds
logarithmic in the longest path. A step is one aggregate and one equality join on the node; a node
with very many neighbours is counted before the shuffle in the one and split by the adaptive skew
join in the other. Each round is written to the shared folder, so its lineage is one read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stagekin.llm.common import batch, dropped, written

EDGE = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def smallest_reachable(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges and the smallest node that each reaches."""
    nodes, flat = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = flat[: len(u)], flat[len(u):]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        was = root.copy()
        for side in (a, b):
            np.minimum.at(root, root[side], low)
        while (root[root] != root).any():
            root = root[root]
        if (root == was).all():
            return nodes, nodes[root]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    u, v = np.empty(0, np.int64), np.empty(0, np.int64)
    for rows in batches:
        u = np.concatenate((u, rows.column(0).to_numpy()))
        v = np.concatenate((v, rows.column(1).to_numpy()))
        u, v = smallest_reachable(u, v)  # no more rows than nodes seen so far
        u, v = u[u != v], v[u != v]
    yield batch(EDGE, u, v)


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Edges with v < u."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node and component (its smallest node), for every node of an edge (u, v: long, not null)."""
    at = written(edges.select(F.col("u").cast("long"), F.col("v").cast("long")).filter("u != v")
                 .mapInArrow(_contract, "u long, v long").distinct(), "edges")

    while not _settled(at):
        after = written(_small_star(_large_star(at)), "edges")
        dropped(at)
        at = after
    return at.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        at.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _settled(edges: DataFrame) -> bool:
    """Whether every node has one centre and no centre has another: stars around their smallest nodes."""
    sides = edges.select(F.col("u").alias("n"), F.lit(1).alias("in"), F.lit(0).alias("out")).unionByName(
        edges.select(F.col("v").alias("n"), F.lit(0).alias("in"), F.lit(1).alias("out")))
    seen = sides.groupBy("n").agg(F.sum("in").alias("in"), F.max("out").alias("out"))
    return seen.filter(F.col("in") + F.col("out") > 1).isEmpty()

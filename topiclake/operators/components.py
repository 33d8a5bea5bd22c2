"""Connected components of edge tables, for several independent graphs at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topiclake.session import stage

# Graphs with at most this many edges are finished by one task per graph.
LOCAL_EDGES = 1_000_000


def find(parent: dict[int, int], node: int) -> int:
    """Root of a node, with path halving."""
    while parent.setdefault(node, node) != node:
        parent[node] = parent[parent[node]]
        node = parent[node]
    return node


def _union(edges: pa.Table) -> pa.Table:
    parent: dict[int, int] = {}
    for u, v in zip(edges.column("u").to_pylist(), edges.column("v").to_pylist()):
        a, b = find(parent, u), find(parent, v)
        if a != b:
            parent[max(a, b)] = min(a, b)
    nodes = np.fromiter(parent, np.int64, len(parent))
    return pa.table(
        {
            "graph": np.full(len(nodes), edges.column("graph")[0].as_py(), np.int32),
            "node": nodes,
            "root": np.array([find(parent, n) for n in nodes], np.int64),
        }
    )


def _least_neighbor(edges: DataFrame) -> DataFrame:
    return edges.groupBy("graph", "u").agg(F.min("v").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Point every greater neighbour of a node at the least node around it."""
    both = edges.unionByName(edges.select("graph", F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least_neighbor(both).withColumn("m", F.least("u", "m"))
    return both.join(least, ["graph", "u"]).filter("v > u").select(
        "graph", F.col("v").alias("u"), F.col("m").alias("v")
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Point a node and its lesser neighbours at the least of them."""
    least = _least_neighbor(edges)
    moved = edges.join(least, ["graph", "u"]).filter("v <> m").select(
        "graph", F.col("v").alias("u"), F.col("m").alias("v")
    )
    return moved.unionByName(least.select("graph", "u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(graph, node, root) of every node on an edge (graph, u, v); the root is the least node.

    Small graphs are finished in a task each. Larger ones alternate large-star and small-star
    rounds until every edge points at a root; the least neighbour is a partial aggregate and hub
    nodes are split by the skew join.
    """
    edges = stage(
        edges.filter("u <> v")
        .select("graph", F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct(),
        "edges",
    )
    if edges.limit(local_edges + 1).count() <= local_edges:
        return edges.groupBy("graph").applyInArrow(_union, "graph int, node long, root long")

    def fingerprint(e):
        return e.agg(F.count("*"), F.sum(F.xxhash64("graph", "u", "v").cast("decimal(38,0)"))).first()

    mark = fingerprint(edges)
    while True:
        edges = stage(_small_star(_large_star(edges)), "stars")
        now = fingerprint(edges)
        if now == mark:
            break
        mark = now
    leaves = edges.select("graph", F.col("u").alias("node"), F.col("v").alias("root"))
    roots = leaves.select("graph", F.col("root").alias("node"), "root").distinct()
    return leaves.unionByName(roots)

"""Connected components of an edge list by alternating large and small stars."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkweft.storage import drop_scratch, materialise


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of u is joined to the least of u and its neighbours."""
    both = _both_ways(edges)
    least = both.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """u and every smaller neighbour are joined to the least of these."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def _is_star_forest(edges: DataFrame) -> bool:
    """Whether each node has one parent at most, and no parent has a parent."""
    ends = edges.select(F.col("u").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select(F.col("v").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    per_node = ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return per_node.filter((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0))).isEmpty()


#: Edges that one task joins by itself at a time.
_LOCAL = 500_000


def _least(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and the least node that each reaches, without the least nodes themselves."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    u, v = np.split(ends.reshape(-1), 2)
    root = np.arange(len(nodes))
    while True:
        a, b = root[u], root[v]
        if (a == b).all():
            break
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root != root[root]).any():
            root = root[root]
    kept = root != np.arange(len(nodes))
    return nodes[kept], nodes[root[kept]]


def _contracted(batches):
    """Edges (u, v) with u > v of stars that join what the edges of a task, some at a time, join."""
    held: list[pa.RecordBatch] = []

    def stars():
        t = pa.Table.from_batches(held)
        u, v = _least(t.column("u").to_numpy(), t.column("v").to_numpy())
        return pa.record_batch({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    for batch in batches:
        held.append(batch)
        if sum(x.num_rows for x in held) >= _LOCAL:
            yield stars()
            held.clear()
    if held:
        yield stars()


def star_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(u, v) -> (node, root): the least node that each node of the edge list reaches.

    What a task can join by itself it does first, so that the rounds see stars alone, and none is needed where
    the edges of a component are neighbours. Each round halves the depth of the trees, so few are needed; its edges,
    never more than there are nodes and edges, are written to the shared folder, and the round before is deleted. A hub's minimum
    is combined before the shuffle, and its rows are split by the skew join that AQE plans.
    """
    edges = edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).filter("u <> v")
    edges = materialise(edges.mapInArrow(_contracted, "u long, v long"), "edges")
    for _ in range(rounds):
        if _is_star_forest(edges):
            break
        done = materialise(_small_star(_large_star(edges)), "edges")
        drop_scratch(edges)
        edges = done
    else:
        raise RuntimeError(f"no star forest after {rounds} rounds")
    # Both steps let an edge point from the larger to the smaller end.
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v").distinct())

"""Breadth-first and depth-first search."""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkweft.graph import Graph, number_rows
from sparkweft.plans.rounds import chain, cut


@dataclass
class BfsResult:
    """``found`` has (id, parent, distance, rank, depth): hops, place in the discovery order, and weight along the tree."""

    found: DataFrame
    target_found: bool

    def path(self, source: int, target: int) -> list[int]:
        return reconstruct_path(self.found, source, target)


def reconstruct_path(found: DataFrame, source: int, target: int) -> list[int]:
    """The tree path of a search, or [] if the target wasn't reached from the source."""
    if found.filter(F.col("id") == target).isEmpty():
        return []
    return chain(found.select("id", "parent"), target, source)[::-1]


def bfs(g: Graph, source: int, target: int | None = None) -> BfsResult:
    """Levels of a frontier joined to the adjacency. A vertex's parent is its first discoverer, neighbours in edge order.

    With a target the search ends when it would be taken from the queue.
    """
    adj = cut(g.adjacency.select("src", "dst", "eid", "weight"), "adjacency")
    frontier = g.spark.range(1).select(F.lit(source).cast("long").alias("id"), F.lit(None).cast("long").alias("parent"), F.lit(0).cast("long").alias("distance"), F.lit(0).cast("long").alias("rank"), F.lit(0.0).alias("depth"))
    levels, n = [frontier], 1
    reached, last = source == target, None
    while source != target:
        found = _together(levels)
        met = frontier.withColumnsRenamed({"id": "src"}).join(adj, "src").join(found.select(F.col("id").alias("dst")), "dst", "left_anti")
        if last is not None:
            met = met.filter(F.col("rank") < last)
        first = met.groupBy("dst").agg(F.min(F.struct("rank", "eid", "src", "distance", "depth", "weight")).alias("m"))
        level = first.select(F.col("dst").alias("id"), F.col("m.src").alias("parent"), (F.col("m.distance") + 1).alias("distance"), F.col("m.rank").alias("__r"), F.col("m.eid").alias("__e"), (F.col("m.depth") + F.col("m.weight")).alias("depth"))
        frontier = number_rows(level, ["__r", "__e", "id"], "rank", n).select("id", "parent", "distance", "rank", "depth")
        size = frontier.count()
        if not size:
            break
        levels.append(frontier)
        n += size
        if last is not None:
            break
        if target is not None and (at := frontier.filter(F.col("id") == target).select("rank").first()) is not None:
            reached, last = True, at[0]
    return BfsResult(_together(levels), reached)


def _together(levels: list[DataFrame]) -> DataFrame:
    """The union of the levels, in one table again after every sixteen."""
    if len(levels) > 16:
        levels[:] = [cut(_union(levels))]
    return _union(levels)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def multi_source_bfs(g: Graph, sources: DataFrame, symmetric: bool = False) -> DataFrame:
    """(source, id, distance, rank, depth, parent) from all ``sources`` (id) at once, each as :func:`bfs` would."""
    adj = cut((g.symmetric if symmetric else g.adjacency).select("src", "dst", "eid", "weight"), "adjacency")
    frontier = cut(sources.select(F.col("id").alias("source"), "id", F.lit(0).cast("long").alias("distance"), F.lit(0).cast("long").alias("rank"), F.lit(0.0).alias("depth"), F.lit(None).cast("long").alias("parent")))
    levels = [frontier]
    while True:
        found = _together(levels)
        met = frontier.select("source", F.col("id").alias("src"), "distance", "rank", "depth").join(adj, "src").join(found.select("source", F.col("id").alias("dst")), ["source", "dst"], "left_anti")
        first = met.groupBy("source", "dst").agg(F.min(F.struct("rank", "eid", "src", "distance", "depth", "weight")).alias("m"))
        # Within a level the order is that of (the parent's rank, the edge), for each source by itself.
        level = first.select("source", F.col("dst").alias("id"), (F.col("m.distance") + 1).alias("distance"), F.col("m.rank").alias("r"), F.col("m.eid").alias("e"), (F.col("m.depth") + F.col("m.weight")).alias("depth"), F.col("m.src").alias("parent"))
        frontier = cut(level.withColumn("rank", F.row_number().over(_by_source()).cast("long")).select("source", "id", "distance", "rank", "depth", "parent"))
        if frontier.isEmpty():
            return found
        levels.append(frontier)


def _by_source():
    from pyspark.sql import Window

    return Window.partitionBy("source").orderBy("r", "e", "id")


def _walk(kind: str, source: int, target: int | None):
    """The sequential search over the reachable part; one task, as depth-first order is sequential by nature."""

    def run(rows: pa.Table) -> pa.Table:
        order = rows.sort_by([("src", "ascending"), ("eid", "ascending")])
        near: dict[int, list[int]] = {}
        for s, d in zip(order.column("src").to_pylist(), order.column("dst").to_pylist()):
            if s is not None and d is not None:
                near.setdefault(s, []).append(d)
        parent: dict[int, int | None] = {}
        start: dict[int, int] = {}
        finish: dict[int, int] = {}
        pre: list[int] = []
        post: list[int] = []
        clock = 0
        if kind == "iterative":
            stack = [source]
            parent[source] = None
            while stack:
                v = stack.pop()
                if v in start:
                    continue
                start[v] = clock
                clock += 1
                pre.append(v)
                for w in reversed(near.get(v, ())):
                    if w not in start:
                        parent.setdefault(w, v)
                        stack.append(w)
        else:
            parent[source], start[source] = None, 0
            clock, stop = 1, source == target
            pre.append(source)
            path = [] if stop else [(source, iter(near.get(source, ())))]
            while path:
                v, rest = path[-1]
                for w in rest:
                    if w not in start:
                        parent[w], start[w] = v, clock
                        clock += 1
                        pre.append(w)
                        if w == target:
                            path = []
                            break
                        path.append((w, iter(near.get(w, ()))))
                        break
                else:
                    finish[v] = clock
                    clock += 1
                    post.append(v)
                    path.pop()
        place = {v: k for k, v in enumerate(post)}
        return pa.table({"id": pa.array(pre, pa.int64()), "parent": pa.array([parent[v] for v in pre], pa.int64()), "discovery": pa.array([start[v] for v in pre], pa.int64()), "finish": pa.array([finish.get(v) for v in pre], pa.int64()), "preorder": pa.array(range(len(pre)), pa.int64()), "postorder": pa.array([place.get(v) for v in pre], pa.int64())})

    return run


def _depth_first(g: Graph, kind: str, source: int, target: int | None) -> DataFrame:
    reach = bfs(g, source).found.select(F.col("id").alias("src"))
    rows = g.adjacency.join(reach, "src", "left_semi").select("src", "dst", "eid").union(g.spark.createDataFrame([(source, None, None)], "src long, dst long, eid long"))
    return rows.groupBy().applyInArrow(_walk(kind, source, target), "id long, parent long, discovery long, finish long, preorder long, postorder long")


def dfs(g: Graph, source: int, target: int | None = None) -> DataFrame:
    """(id, parent, discovery, finish, preorder, postorder). What is on the path when the target is met has no finish.

    Depth-first order depends on every step before, so the reachable part is walked by one task.
    """
    return _depth_first(g, "recursive", source, target)


def dfs_iterative(g: Graph, source: int) -> DataFrame:
    """With a stack: preorder and discovery only; a parent is who pushed the vertex first."""
    return _depth_first(g, "iterative", source, None)

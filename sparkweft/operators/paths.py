"""Shortest paths by rounds of relaxation: the frontier alone is joined to the edges."""

from __future__ import annotations

import heapq
from collections.abc import Callable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkweft.graph import Graph
from sparkweft.plans.rounds import chain, cut, one_cycle


@dataclass
class PathResult:
    found: bool
    distance: float
    path: list[int]
    nodes_explored: int | None = None


def _relax(edges: DataFrame, start: DataFrame, rounds: int | None, worth: Callable[[DataFrame], Column] | None = None) -> tuple[DataFrame, bool]:
    """Least distances (id, distance, pred) from ``start`` (id, distance); whether the last round still improved some.

    ``edges`` is (src, dst, weight, eid). Ties go to the smaller predecessor, then the smaller edge.
    """
    edges = cut(edges.select("src", "dst", "weight", "eid"), "edges")
    best = cut(start.select("id", "distance", F.lit(None).cast("long").alias("pred"), F.lit(True).alias("new")))
    k = 0
    while rounds is None or k < rounds:
        k += 1
        frontier = best.filter("new").select(F.col("id").alias("src"), "distance")
        offers = frontier.join(edges, "src").groupBy("dst").agg(F.min(F.struct((F.col("distance") + F.col("weight")).alias("distance"), F.col("src").alias("pred"), "eid")).alias("o"))
        offers = offers.select(F.col("dst").alias("id"), F.col("o.distance").alias("offer"), F.col("o.pred").alias("by"))
        if worth is not None:
            offers = offers.filter(worth(best))
        met = best.join(offers, "id", "full")
        better = F.col("offer").isNotNull() & (F.col("distance").isNull() | (F.col("offer") < F.col("distance")))
        best = cut(met.select("id", F.when(better, F.col("offer")).otherwise(F.col("distance")).alias("distance"), F.when(better, F.col("by")).otherwise(F.col("pred")).alias("pred"), better.alias("new")))
        if best.filter("new").isEmpty():
            return best.drop("new"), False
    return best.drop("new"), True


def shortest_distances(g: Graph, source: int) -> DataFrame:
    """(id, distance, pred) of all vertices that the source reaches; weights are not negative. An extra."""
    start = g.vertices.filter(F.col("id") == source).select("id", F.lit(0.0).alias("distance"))
    return _relax(g.adjacency, start, None)[0]


def _search(g: Graph, source: int, target: int, ahead: Callable[[Column], Column] | None) -> PathResult:
    ids = {r[0] for r in g.vertices.filter(F.col("id").isin(source, target)).select("id").collect()}
    if not {source, target} <= ids:
        return PathResult(False, float("inf"), [])
    if source == target:
        return PathResult(True, 0.0, [source])

    def worth(best: DataFrame) -> Column:
        known = best.filter(F.col("id") == target).select("distance").first()
        bound = float("inf") if known is None else known[0]
        rest = F.lit(0.0) if ahead is None else ahead(F.col("id"))
        return (F.col("offer") + rest < bound) | (F.col("id") == target)

    start = g.spark.createDataFrame([(source, 0.0)], "id long, distance double")
    best, _ = _relax(g.adjacency, start, None, worth)
    at = best.filter(F.col("id") == target).first()
    if at is None:
        return PathResult(False, float("inf"), [])
    return PathResult(True, at["distance"], chain(best.select("id", F.col("pred").alias("parent")), target, source)[::-1])


def dijkstra(g: Graph, source: int, target: int) -> PathResult:
    """What can't beat the best distance to the target so far is not followed. Weights are not negative."""
    return _search(g, source, target, None)


def _explore(source: int, target: int):
    """Pops of the queue of a best-first search that never reopens a vertex; sequential, so one task."""

    def run(rows: pa.Table) -> pa.Table:
        near: dict[int, list[tuple[int, float]]] = {}
        ahead: dict[int, float] = {}
        for s, d, w, h in zip(*(rows.column(c).to_pylist() for c in ("src", "dst", "weight", "h"))):
            if d is None:
                ahead[s] = h
            else:
                near.setdefault(s, []).append((d, w))
        cost, done, heap, n = {source: 0.0}, set(), [(ahead.get(source, 0.0), source)], 0
        while heap:
            _, v = heapq.heappop(heap)
            if v in done:
                continue
            done.add(v)
            n += 1
            if v == target:
                break
            for w, c in near.get(v, ()):
                if w not in done and cost[v] + c < cost.get(w, float("inf")):
                    cost[w] = cost[v] + c
                    heapq.heappush(heap, (cost[w] + ahead.get(w, 0.0), w))
        return pa.table({"n": pa.array([n], pa.int64())})

    return run


def astar(g: Graph, source: int, target: int, heuristic: Callable[[Column, Column], Column], explored: bool = False) -> PathResult:
    """``heuristic(v, target)`` is a column expression and must be consistent. ``explored`` counts the visited vertices too."""
    ahead = lambda v: heuristic(v, F.lit(target).cast("long")).cast("double")
    out = _search(g, source, target, ahead)
    if explored and out.found:
        rows = g.adjacency.select("src", "dst", "weight", F.lit(None).cast("double").alias("h")).union(g.vertices.select("id", F.lit(None).cast("long"), F.lit(None).cast("double"), ahead(F.col("id"))))
        out.nodes_explored = rows.groupBy().applyInArrow(_explore(source, target), "n long").first()[0]
    return out


def astar_dijkstra(g: Graph, source: int, target: int, explored: bool = False) -> PathResult:
    return astar(g, source, target, lambda v, t: F.lit(0.0), explored)


@dataclass
class BellmanFordResult:
    """``distances`` has (id, distance, pred) of every vertex, infinite where unreached; None for a missing source."""

    distances: DataFrame | None
    has_negative_cycle: bool
    negative_cycle: list[int] = field(default_factory=list)


def bellman_ford(g: Graph, source: int) -> BellmanFordResult:
    """Over directed edges alone. A round that still improves after as many as there are vertices tells of a negative cycle."""
    if not g.has_vertex(source):
        return BellmanFordResult(None, False)
    n = g.vertex_count()
    start = g.spark.createDataFrame([(source, 0.0)], "id long, distance double")
    best, improving = _relax(g.edges.filter("directed"), start, n)
    cycle = one_cycle(best.filter(F.col("pred").isNotNull()).select("id", F.col("pred").alias("parent")), n) if improving else []
    everyone = g.vertices.select("id").join(best, "id", "left").withColumn("distance", F.coalesce("distance", F.lit(float("inf"))))
    return BellmanFordResult(everyone, improving, cycle)


def get_shortest_path(g: Graph, source: int, target: int) -> list[int]:
    r = bellman_ford(g, source)
    if r.distances is None or r.has_negative_cycle:
        return []
    row = r.distances.filter(F.col("id") == target).first()
    if row is None or row["distance"] == float("inf"):
        return []
    return chain(r.distances.select("id", F.col("pred").alias("parent")), target, source)[::-1]


def has_negative_cycle(g: Graph, source: int) -> bool:
    return bellman_ford(g, source).has_negative_cycle


def get_distance(g: Graph, source: int, target: int) -> float:
    r = bellman_ford(g, source)
    row = None if r.distances is None else r.distances.filter(F.col("id") == target).first()
    return float("inf") if row is None else row["distance"]

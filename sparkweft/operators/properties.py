"""Structure of a graph as a whole: two-colouring, diameter, radius and centre."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkweft.graph import Graph
from sparkweft.plans.rounds import chain, cut

from .centrality import BATCH, _batches
from .components import component_roots
from .paths import _relax
from .traversal import multi_source_bfs


@dataclass
class BipartiteResult:
    """``coloring`` has (id, color) if there are two colours, ``odd_cycle`` a closed walk if not."""

    is_bipartite: bool
    coloring: DataFrame
    odd_cycle: list[int]


def is_bipartite(g: Graph) -> BipartiteResult:
    """By the parity of the hops from each component's least vertex, directions aside."""
    roots = component_roots(g).filter("id = root").select("id")
    tree = cut(multi_source_bfs(g, roots, symmetric=True))
    coloring = tree.select("id", (F.col("distance") % 2).cast("int").alias("color"))
    tag = lambda end: tree.select(F.col("id").alias(end), (F.col("distance") % 2).alias(f"c_{end}"))
    clash = g.edges.select("eid", "src", "dst").join(tag("src"), "src").join(tag("dst"), "dst").filter("c_src = c_dst").orderBy("eid").first()
    if clash is None:
        return BipartiteResult(True, coloring, [])
    parents = tree.select("id", "parent")
    a, b = chain(parents, clash["src"]), chain(parents, clash["dst"])
    while len(a) > 1 and len(b) > 1 and a[-2] == b[-2]:
        a.pop(), b.pop()
    return BipartiteResult(False, coloring, [*a, *reversed(b[:-1]), a[0]])


def eccentricities(g: Graph, metric: str = "bfs_tree", batch: int = BATCH) -> DataFrame:
    """(id, eccentricity): the greatest weight of a way to another vertex, infinite unless all are reached.

    ``bfs_tree`` sums weights along the hop tree of a breadth-first search, ``shortest`` along lightest paths.
    About ``batch`` sources are searched at a time.
    """
    n = g.vertex_count()
    if metric not in ("bfs_tree", "shortest"):
        raise ValueError("metric is bfs_tree or shortest")

    def part(sources: DataFrame) -> DataFrame:
        reach = multi_source_bfs(g, sources).select("source", "id", "depth") if metric == "bfs_tree" else _all_shortest(g, sources)
        return reach.groupBy("source").agg(F.count("*").alias("reached"), F.max("depth").alias("depth"))

    per = _batches(g, batch, part)
    return per.select(F.col("source").alias("id"), F.when(F.col("reached") == n, F.col("depth")).otherwise(float("inf")).alias("eccentricity"))


def _all_shortest(g: Graph, sources: DataFrame) -> DataFrame:
    edges = cut(g.adjacency.select("src", "dst", "weight"), "edges")
    best = cut(sources.select(F.col("id").alias("source"), "id", F.lit(0.0).alias("depth"), F.lit(True).alias("new")))
    while True:
        offers = best.filter("new").select("source", F.col("id").alias("src"), "depth").join(edges, "src").groupBy("source", F.col("dst").alias("id")).agg(F.min(F.col("depth") + F.col("weight")).alias("offer"))
        met = best.join(offers, ["source", "id"], "full")
        better = F.col("offer").isNotNull() & (F.col("depth").isNull() | (F.col("offer") < F.col("depth")))
        best = cut(met.select("source", "id", F.when(better, F.col("offer")).otherwise(F.col("depth")).alias("depth"), better.alias("new")))
        if best.filter("new").isEmpty():
            return best


def graph_diameter(g: Graph, metric: str = "bfs_tree") -> float:
    return eccentricities(g, metric).agg(F.coalesce(F.max("eccentricity"), F.lit(0.0))).first()[0]


def graph_radius(g: Graph, metric: str = "bfs_tree") -> float:
    """Infinite as soon as one vertex can't reach all others."""
    low, high = eccentricities(g, metric).agg(F.min("eccentricity"), F.max("eccentricity")).first()
    return 0.0 if low is None else float("inf") if high == float("inf") else low


def graph_center(g: Graph, metric: str = "bfs_tree") -> DataFrame:
    """(id) of the vertices whose eccentricity is the radius; none if the graph isn't connected."""
    ecc = cut(eccentricities(g, metric))
    low, high = ecc.agg(F.min("eccentricity"), F.max("eccentricity")).first()
    if low is None or high == float("inf"):
        return ecc.select("id").limit(0)
    return ecc.filter(F.abs(F.col("eccentricity") - F.lit(low)) < 1e-9).select("id").orderBy("id")

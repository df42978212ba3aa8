"""Connected and strongly connected components, and spanning trees."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkweft.graph import Graph, number_rows
from sparkweft.plans.rounds import cut

from .stars import star_components
from .traversal import multi_source_bfs


def component_roots(g: Graph) -> DataFrame:
    """(id, root): the least vertex that each is connected to, directions aside."""
    linked = star_components(g.edges.select(F.col("src").alias("u"), F.col("dst").alias("v")))
    return g.vertices.select("id").join(linked.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))


def _numbered(roots: DataFrame) -> DataFrame:
    roots = cut(roots)
    numbers = number_rows(roots.select("root").distinct(), ["root"], "component")
    return roots.join(numbers, "root").select("id", "component", "root")


def connected_components(g: Graph) -> DataFrame:
    """(id, component, root); components count from 0 in the order of their least vertex."""
    return _numbered(component_roots(g))


def component_sizes(components: DataFrame) -> DataFrame:
    return components.groupBy("component").agg(F.count("*").alias("size"))


def num_components(g: Graph) -> int:
    return component_roots(g).select("root").distinct().count()


def is_connected(g: Graph) -> bool:
    return num_components(g) <= 1


def largest_component_size(g: Graph) -> int:
    return component_roots(g).groupBy("root").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]


def _same(found: DataFrame, column: str, u: int, v: int) -> bool:
    rows = found.filter(F.col("id").isin(u, v)).select("id", column).collect()
    return len(rows) == len({u, v}) and len({r[1] for r in rows}) == 1


def same_component(g: Graph, u: int, v: int) -> bool:
    return _same(component_roots(g), "root", u, v)


def _spread(edges: DataFrame, colour: DataFrame) -> DataFrame:
    """(id, colour) to the least colour that reaches each vertex along (src, dst)."""
    state = cut(colour.select("id", "colour", F.lit(True).alias("new")))
    while True:
        offers = state.filter("new").select(F.col("id").alias("src"), "colour").join(edges, "src").groupBy(F.col("dst").alias("id")).agg(F.min("colour").alias("offer"))
        met = state.join(offers, "id", "left")
        better = F.coalesce(F.col("offer") < F.col("colour"), F.lit(False))
        state = cut(met.select("id", F.when(better, F.col("offer")).otherwise(F.col("colour")).alias("colour"), better.alias("new")))
        if state.filter("new").isEmpty():
            return state.drop("new")


def scc_roots(g: Graph) -> DataFrame:
    """(id, root) of the strongly connected components over directed edges.

    Vertices without an edge in or out among the rest are components of their own and are trimmed first.
    Of the rest, each takes the least vertex that reaches it as colour; what reaches a colour's own vertex
    backwards within the colour is its component. That settles one component a colour each time round.
    """
    edges = cut(g.edges.filter("directed").filter("src <> dst").select("src", "dst").distinct(), "edges")
    left = cut(g.vertices.select("id"))
    done = []
    while not left.isEmpty():
        while True:
            both = edges.select(F.col("src").alias("id")).intersect(edges.select(F.col("dst").alias("id")))
            kept = cut(left.join(both, "id", "left_semi"))
            if kept.count() == left.count():
                break
            done.append(cut(left.join(kept, "id", "left_anti").select("id", F.col("id").alias("root"))))
            edges = cut(edges.join(kept.select(F.col("id").alias("src")), "src", "left_semi").join(kept.select(F.col("id").alias("dst")), "dst", "left_semi"), "edges")
            left = kept
        if left.isEmpty():
            break
        colour = _spread(edges, left.select("id", F.col("id").alias("colour")))
        tag = lambda end: colour.select(F.col("id").alias(end), F.col("colour").alias(f"c_{end}"))
        back = cut(edges.join(tag("src"), "src").join(tag("dst"), "dst").filter("c_src = c_dst").select(F.col("dst").alias("src"), F.col("src").alias("dst")), "edges")
        reached = cut(colour.filter("id = colour").select("id", "colour"))
        frontier = reached
        while not frontier.isEmpty():
            found = frontier.select(F.col("id").alias("src"), "colour").join(back, "src").select(F.col("dst").alias("id"), "colour").distinct()
            frontier = cut(found.join(reached, "id", "left_anti"))
            reached = cut(reached.union(frontier))
        done.append(reached.select("id", F.col("colour").alias("root")))
        left = cut(left.join(reached, "id", "left_anti"))
        edges = cut(edges.join(left.select(F.col("id").alias("src")), "src", "left_semi").join(left.select(F.col("id").alias("dst")), "dst", "left_semi"), "edges")
    out = done[0] if done else g.vertices.select("id", F.col("id").alias("root")).limit(0)
    for more in done[1:]:
        out = out.union(more)
    return out


def strongly_connected_components(g: Graph) -> DataFrame:
    """(id, component, root); components count from 0 in the order of their least vertex."""
    return _numbered(scc_roots(g))


get_component_map = strongly_connected_components


def is_strongly_connected(g: Graph) -> bool:
    return scc_roots(g).select("root").distinct().count() == 1


def largest_scc_size(g: Graph) -> int:
    return scc_roots(g).groupBy("root").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]


def in_same_scc(g: Graph, u: int, v: int) -> bool:
    return _same(scc_roots(g), "root", u, v)


@dataclass
class SpanningTree:
    """``edges`` (eid), ``parents`` (id, parent) from the start, the total weight, and whether it spans the graph."""

    edges: DataFrame
    parents: DataFrame
    total_weight: float
    is_spanning_tree: bool


def spanning_forest(g: Graph) -> DataFrame:
    """Edges (eid, src, dst, weight) of a minimum spanning forest; of equal weights the smaller edge id.

    Boruvka: each component takes its least outgoing edge, and what is joined becomes one component.
    """
    edges = cut(g.edges.filter("src <> dst").select("eid", "src", "dst", "weight"), "edges")
    state = cut(g.vertices.select("id", F.col("id").alias("root")))
    taken: DataFrame | None = None
    while True:
        tag = lambda end: state.select(F.col("id").alias(end), F.col("root").alias(f"r_{end}"))
        across = cut(edges.join(tag("src"), "src").join(tag("dst"), "dst").filter("r_src <> r_dst"), "across")
        if across.isEmpty():
            return taken if taken is not None else edges.limit(0)
        key = F.struct("weight", "eid", "src", "dst", "r_src", "r_dst").alias("e")
        least = across.select(F.col("r_src").alias("r"), key).union(across.select(F.col("r_dst"), key)).groupBy("r").agg(F.min("e").alias("e"))
        chosen = cut(least.select("e.*").distinct())
        merged = star_components(chosen.select(F.col("r_src").alias("u"), F.col("r_dst").alias("v")))
        state = cut(state.join(merged.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left").select("id", F.coalesce("to", "root").alias("root")))
        edges = across.select("eid", "src", "dst", "weight")
        new = chosen.select("eid", "src", "dst", "weight")
        taken = cut(new if taken is None else taken.union(new))


def prim_mst(g: Graph, start: int | None = None) -> SpanningTree:
    """The minimum spanning tree of the start's component (by default of the least vertex), directions aside."""
    if start is None:
        start = g.vertices.agg(F.min("id")).first()[0]
    if start is None:
        none = g.spark.createDataFrame([], "id long, parent long")
        return SpanningTree(g.edges.select("eid").limit(0), none, 0.0, True)
    forest = spanning_forest(g)
    tree = Graph(g.vertices.select("id"), forest.withColumn("directed", F.lit(False)))
    reach = multi_source_bfs(tree, g.vertices.filter(F.col("id") == start).select("id"))
    mine = cut(forest.join(reach.select(F.col("id").alias("src")), "src", "left_semi"))
    weight, n = mine.agg(F.coalesce(F.sum("weight"), F.lit(0.0)), F.count("*")).first()
    return SpanningTree(mine.select("eid"), reach.select("id", "parent"), weight, n == g.vertex_count() - 1)


def kruskal_mst(g: Graph) -> DataFrame:
    """The forest of all components. An extra."""
    return spanning_forest(g).select("eid", "weight")

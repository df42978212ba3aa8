"""Graph algebra. Results have compact ids, 0..n-1 in the order of the old ones, unless ``compact`` is off."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkweft.graph import Graph, number_rows


def compacted(g: Graph, compact: bool = True) -> Graph:
    if not compact:
        return g
    ids = number_rows(g.vertices.select("id"), ["id"], "new_id")
    vertices = g.vertices.join(ids, "id").drop("id").withColumnRenamed("new_id", "id")
    edges = number_rows(g.edges, ["eid"], "__eid").drop("eid").withColumnRenamed("__eid", "eid")
    for end in ("src", "dst"):
        edges = edges.join(ids.select(F.col("id").alias(end), F.col("new_id").alias("__new")), end).drop(end).withColumnRenamed("__new", end)
    return Graph(vertices, edges)


def transpose(g: Graph, compact: bool = True) -> Graph:
    """Directed edges are turned round, undirected ones stay."""
    turned = g.edges.withColumns({"src": F.when(F.col("directed"), F.col("dst")).otherwise(F.col("src")), "dst": F.when(F.col("directed"), F.col("src")).otherwise(F.col("dst"))})
    return compacted(Graph(g.vertices, turned), compact)


def _among(edges: DataFrame, ids: DataFrame) -> DataFrame:
    return edges.join(ids.select(F.col("id").alias("src")), "src", "left_semi").join(ids.select(F.col("id").alias("dst")), "dst", "left_semi")


def induced_subgraph(g: Graph, ids: DataFrame, compact: bool = True) -> Graph:
    """The vertices of ``ids`` that exist and the edges between them."""
    vertices = g.vertices.join(ids.select("id"), "id", "left_semi")
    return compacted(Graph(vertices, _among(g.edges, vertices)), compact)


def edge_subgraph(g: Graph, ids: DataFrame, eids: DataFrame, compact: bool = True) -> Graph:
    inner = induced_subgraph(g, ids, compact=False)
    return compacted(Graph(inner.vertices, inner.edges.join(eids.select("eid"), "eid", "left_semi")), compact)


def graph_union(a: Graph, b: Graph) -> tuple[Graph, DataFrame, DataFrame]:
    """The disjoint union, and (id, new_id) of either side."""
    a_ids = number_rows(a.vertices.select("id"), ["id"], "new_id")
    b_ids = number_rows(b.vertices.select("id"), ["id"], "new_id", a.vertex_count())
    offset = a.edge_count()
    parts = []
    for g, ids, start in ((a, a_ids, 0), (b, b_ids, offset)):
        edges = number_rows(g.edges.select("eid", "src", "dst", "weight", "directed"), ["eid"], "__eid", start).drop("eid").withColumnRenamed("__eid", "eid")
        for end in ("src", "dst"):
            edges = edges.join(ids.select(F.col("id").alias(end), F.col("new_id").alias("__new")), end).drop(end).withColumnRenamed("__new", end)
        parts.append((ids.select(F.col("new_id").alias("id")), edges.select("eid", "src", "dst", "weight", "directed")))
    return Graph(parts[0][0].union(parts[1][0]), parts[0][1].union(parts[1][1])), a_ids, b_ids


disjoint_union = graph_union


def graph_intersection(a: Graph, b: Graph, compact: bool = True) -> Graph:
    """Common ids, and the edges of ``a`` whose pair ``b`` has too, with the weight and kind of ``a``."""
    vertices = a.vertices.join(b.vertices.select("id"), "id", "left_semi")
    pairs = b.adjacency.select("src", "dst").distinct()
    return compacted(Graph(vertices, _among(a.edges.join(pairs, ["src", "dst"], "left_semi"), vertices)), compact)


def complement(g: Graph, compact: bool = True) -> Graph:
    """All pairs of vertices that no undirected edge joins; its size is the square of the vertices by definition.

    The pairs come from an equi-join on blocks of ids, so they are dealt out over tasks.
    """
    n = 64
    ids = g.vertices.select("id", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias("block"))
    left = ids.select(F.col("id").alias("src"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("block"))
    pairs = left.join(ids.select(F.col("id").alias("dst"), "block"), "block").filter("src < dst").select("src", "dst")
    known = g.edges.filter(~F.col("directed")).select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
    rest = pairs.join(known, ["src", "dst"], "left_anti")
    numbered = number_rows(rest, ["src", "dst"], "eid").withColumns({"weight": F.lit(1.0), "directed": F.lit(False)})
    return compacted(Graph(g.vertices, numbered), compact)


def filter_vertices(g: Graph, keep: Column | str, compact: bool = True) -> Graph:
    """The subgraph of the vertices for which a condition on their columns holds."""
    return induced_subgraph(g, g.vertices.filter(keep).select("id"), compact)


def filter_edges(g: Graph, keep: Column | str, compact: bool = True) -> Graph:
    """All vertices, and the edges for which a condition on their columns holds."""
    return compacted(Graph(g.vertices, g.edges.filter(keep)), compact)


def line_graph(g: Graph) -> Graph:
    """One vertex per edge; edges that share an end are joined. An extra."""
    ends = g.edges.select("eid", F.col("src").alias("v")).union(g.edges.select("eid", "dst")).distinct()
    pairs = ends.alias("a").join(ends.alias("b"), "v").filter("a.eid < b.eid").select(F.col("a.eid").alias("src"), F.col("b.eid").alias("dst")).distinct()
    return Graph.from_edges(pairs, vertices=g.edges.select(F.col("eid").alias("id")))

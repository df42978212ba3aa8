"""Lazy views: ids are kept and nothing is copied; a view is a graph, so every operator takes one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

from sparkweft.graph import Graph

from .transform import _among, induced_subgraph, transpose


class View(Graph):
    """A graph that remembers what it was made from."""

    def __init__(self, shown: Graph, base: Graph):
        super().__init__(shown.vertices, shown.edges)
        self.base = base


def reversed_view(g: Graph) -> View:
    return View(transpose(g, compact=False), g)


def filtered_view(g: Graph, vertex: Column | str | None = None, edge: Column | str | None = None) -> View:
    """An edge shows if both its ends pass and it passes itself."""
    vertices, edges = g.vertices, g.edges
    if vertex is not None:
        vertices = vertices.filter(vertex)
        edges = _among(edges, vertices)
    if edge is not None:
        edges = edges.filter(edge)
    return View(Graph(vertices, edges), g)


def filter_vertices_view(g: Graph, keep: Column | str) -> View:
    return filtered_view(g, vertex=keep)


def filter_edges_view(g: Graph, keep: Column | str) -> View:
    return filtered_view(g, edge=keep)


class SubgraphView(View):
    def __init__(self, g: Graph, ids: DataFrame):
        super().__init__(induced_subgraph(g, ids, compact=False), g)

    def vertex_set(self) -> DataFrame:
        return self.vertices.select("id")


def subgraph_view(g: Graph, ids: DataFrame) -> SubgraphView:
    return SubgraphView(g, ids)

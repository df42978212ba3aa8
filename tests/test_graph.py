import math
import random

import pytest
from pyspark.sql import functions as F

from sparkweft.functions.geometry import euclidean_distance, manhattan_distance
from sparkweft.graph import Graph
from sparkweft.operators import centrality, components, order, paths, propmap, properties, transform, traversal, views

INF = float("inf")


def directed(*pairs):
    return [(p[0], p[1], p[2] if len(p) > 2 else 1.0, True) for p in pairs]


def ids(df, column="id"):
    return sorted(r[0] for r in df.select(column).collect())


def as_dict(df, key="id", value="score"):
    return {r[key]: r[value] for r in df.collect()}


def test_building_and_changing(spark):
    g = Graph.local(spark, 3, [(0, 1, 1.0, True), (0, 1, 2.0), (2, 2)])
    assert (g.vertex_count(), g.edge_count()) == (3, 3)
    assert [r[0] for r in g.neighbors(0).collect()] == [1, 1]
    assert g.degree(2) == 2 and g.has_edge(1, 0) and not g.has_edge(1, 2)
    assert g.get_edge(0, 1) == 0 and g.edge(1, 2) == (0, False)
    assert (g.source(1), g.target(1), g.get_edge_type(0)) == (0, 1, "directed")
    assert g.set_weight(1, 5.0).get_weight(1) == 5.0
    assert g.remove_edge(0, 1).edge_count() == 2 and g.remove_edge(99).edge_count() == 3
    assert g.remove_vertex(1).edge_count() == 1
    g2, v = g.add_vertex(name="x")
    assert v == 3 and g2.get_property(3, "name") == "x" and g2.set_property(3, "name", "y").get_property(3, "name") == "y"
    with pytest.raises(ValueError):
        g.add_edge(0, 9)
    with pytest.raises(ValueError):
        g.get_weight(7)
    assert g.clear().vertex_count() == 0 and Graph.empty(spark).edge_count() == 0


def test_breadth_and_depth_first(spark):
    g = Graph.local(spark, 6, [(0, 1), (0, 2), (1, 3), (1, 4), (2, 5)])
    r = traversal.bfs(g, 0)
    assert as_dict(r.found, value="distance") == {0: 0, 1: 1, 2: 1, 3: 2, 4: 2, 5: 2}
    assert as_dict(r.found, value="rank") == {0: 0, 1: 1, 2: 2, 3: 3, 4: 4, 5: 5}
    assert traversal.bfs(g, 3, 5).path(3, 5) == [3, 1, 0, 2, 5]
    d = {r["id"]: r for r in traversal.dfs(g, 0).collect()}
    assert [v for v, _ in sorted(d.items(), key=lambda x: x[1]["preorder"])] == [0, 1, 3, 4, 2, 5]
    assert d[0]["preorder"] == 0 and d[0]["postorder"] == 5 and d[0]["finish"] == 11
    assert ids(traversal.dfs_iterative(g, 0)) == [0, 1, 2, 3, 4, 5]
    # Without edges, and from a vertex that isn't there.
    assert traversal.bfs(Graph.empty(spark), 7).found.count() == 1


def grid(spark, n):
    edges = [(v, v + 1) for v in range(n * n) if v % n < n - 1] + [(v, v + n) for v in range(n * n - n)]
    return Graph.local(spark, n * n, edges)


def test_guided_search(spark):
    g = grid(spark, 5)
    r = paths.astar(g, 0, 24, lambda v, t: manhattan_distance(v, t, 5), explored=True)
    assert r.found and r.distance == 8.0 and len(r.path) == 9
    assert r.nodes_explored <= paths.astar_dijkstra(g, 0, 24, explored=True).nodes_explored
    assert spark.range(1).select(euclidean_distance(F.lit(0.0), F.lit(0.0), F.lit(3.0), F.lit(4.0))).first()[0] == 5.0


def test_roads(spark):
    roads = [(0, 1, 1.7), (1, 2, 6.4), (2, 3, 3.8), (3, 4, 2.7), (3, 5, 3.7), (4, 5, 2.9), (0, 2, 8.1), (1, 3, 9.6)]
    g = Graph.local(spark, 6, roads)
    r = paths.dijkstra(g, 0, 5)
    assert math.isclose(r.distance, 15.0) and r.path == [0, 1, 3, 5]
    assert paths.dijkstra(g, 0, 0).path == [0] and not paths.dijkstra(g, 0, 77).found


def test_negative_weights(spark):
    g = Graph.local(spark, 3, directed((0, 2, 10), (0, 1, 3), (1, 2, -5)))
    r = paths.bellman_ford(g, 0)
    assert not r.has_negative_cycle and {x["id"]: x["distance"] for x in r.distances.collect()} == {0: 0.0, 1: 3.0, 2: -2.0}
    assert paths.get_shortest_path(g, 0, 2) == [0, 1, 2]
    bad = paths.bellman_ford(Graph.local(spark, 3, directed((0, 1, 1), (1, 2, -3), (2, 0, 1))), 0)
    assert bad.has_negative_cycle and sorted(set(bad.negative_cycle)) == [0, 1, 2]
    away = Graph.local(spark, 4, directed((1, 2, 1), (2, 3, -3), (3, 1, 1)))
    assert not paths.has_negative_cycle(away, 0)
    mixed = Graph.local(spark, 3, [(0, 1, 1.0, True), (1, 2, 2.0)])
    assert paths.get_distance(mixed, 0, 2) == INF and paths.bellman_ford(mixed, 9).distances is None


def test_components(spark):
    g = Graph.local(spark, 8, [(0, 1), (1, 3), (3, 2), (2, 0), (5, 6), (5, 7)])
    found = components.connected_components(g)
    assert as_dict(found, value="component") == {0: 0, 1: 0, 2: 0, 3: 0, 4: 1, 5: 2, 6: 2, 7: 2}
    assert components.largest_component_size(g) == 4 and components.same_component(g, 5, 7) and not components.same_component(g, 0, 99)
    assert components.is_connected(Graph.empty(spark))


def test_strong_components(spark):
    g = Graph.local(spark, 5, directed((0, 1), (1, 2), (2, 3), (3, 1), (3, 4)))
    assert as_dict(components.strongly_connected_components(g), value="component") == {0: 0, 1: 1, 2: 1, 3: 1, 4: 2}
    assert components.in_same_scc(g, 1, 3) and not components.is_strongly_connected(g)


def test_strong_components_at_random(spark):
    r = random.Random(3)
    edges = [(r.randrange(14), r.randrange(14)) for _ in range(20)]
    reach = {v: {v} for v in range(14)}
    for _ in range(14):
        for a, b in edges:
            for s in reach.values():
                if a in s:
                    s.add(b)
    want = {v: min(w for w in reach[v] if v in reach[w]) for v in reach}
    assert as_dict(components.scc_roots(Graph.local(spark, 14, directed(*edges))), value="root") == want


def test_spanning_trees(spark):
    t = components.prim_mst(Graph.local(spark, 4, [(0, 1, 1), (1, 2, 2), (2, 3, 3), (3, 0, 4), (0, 2, 5)]))
    assert t.total_weight == 6.0 and t.is_spanning_tree and ids(t.edges, "eid") == [0, 1, 2]
    t = components.prim_mst(Graph.local(spark, 4, [(0, 1, 1), (2, 3, 2)]), 2)
    assert not t.is_spanning_tree and t.total_weight == 2.0
    assert components.prim_mst(Graph.empty(spark)).is_spanning_tree


def test_cycles(spark):
    r = order.find_cycle(Graph.local(spark, 3, directed((0, 1), (1, 2), (2, 1))))
    assert r.has_cycle and r.cycle[0] == r.cycle[-1] and set(r.cycle) == {1, 2}
    r = order.find_cycle(Graph.local(spark, 4, [(0, 1), (1, 2), (2, 0), (2, 3)]))
    assert r.has_cycle and r.cycle[0] == r.cycle[-1] and set(r.cycle) == {0, 1, 2}
    assert not order.find_cycle(Graph.local(spark, 3, [(0, 1), (0, 1), (1, 2)])).has_cycle
    assert order.has_cycle_undirected(Graph.local(spark, 2, [(1, 1)]))
    assert order.is_acyclic(Graph.local(spark, 3, directed((0, 1), (0, 2), (1, 2))))


def test_topological_order(spark):
    edges = directed(*[(i, i + 10) for i in range(40)])
    r = order.topological_sort(Graph.local(spark, 50, edges))
    place = {x["id"]: x["place"] for x in r.order.collect()}
    assert r.is_dag and len(place) == 50 and all(place[a] < place[b] for a, b, *_ in edges)
    g = Graph.local(spark, 4, directed((0, 1), (1, 2), (2, 1)))
    r = order.topological_sort(g)
    assert not r.is_dag and r.order.isEmpty() and set(r.cycle) == {1, 2}
    d = order.topological_sort_dfs(Graph.local(spark, 3, directed((0, 1), (2, 1))))
    place = {x["id"]: x["place"] for x in d.order.collect()}
    assert place[1] == 2
    assert order.all_topological_sorts(Graph.local(spark, 3, directed((0, 1), (2, 1)))) == [[0, 2, 1], [2, 0, 1]]


def test_centrality(spark):
    star = Graph.local(spark, 5, [(0, 1), (0, 2), (0, 3), (0, 4)])
    assert as_dict(centrality.degree_centrality_all(star)) == {0: 0.5, 1: 0.125, 2: 0.125, 3: 0.125, 4: 0.125}
    path = Graph.local(spark, 3, directed((0, 1), (1, 2)))
    assert as_dict(centrality.degree_centrality_all(path)) == {0: 0.5, 1: 1.0, 2: 0.5}
    assert as_dict(centrality.betweenness_centrality(path)) == {0: 0.0, 1: 1.0, 2: 0.0}
    line = Graph.local(spark, 3, [(0, 1), (1, 2)])
    assert as_dict(centrality.closeness_centrality_all(line)) == {0: pytest.approx(2 / 3), 1: 1.0, 2: pytest.approx(2 / 3)}
    scores = centrality.betweenness_centrality_normalized(line)
    assert as_dict(scores) == {0: 0.0, 1: 0.5, 2: 0.0}
    assert centrality.most_central_vertex(scores) == 1 and ids(centrality.top_k_central_vertices(scores, 2)) == [0, 1]
    with pytest.raises(ValueError):
        centrality.degree_centrality(line, 9)


def test_properties(spark):
    g = Graph.local(spark, 3, [(0, 1, 5), (1, 2, 3)])
    assert (properties.graph_diameter(g), properties.graph_radius(g), ids(properties.graph_center(g))) == (8.0, 5.0, [1])
    apart = Graph.local(spark, 4, [(0, 1), (2, 3)])
    assert properties.graph_diameter(apart) == INF and properties.graph_center(apart).isEmpty()
    square = properties.is_bipartite(Graph.local(spark, 4, [(0, 1), (1, 2), (2, 3), (3, 0)]))
    assert square.is_bipartite and as_dict(square.coloring, value="color") == {0: 0, 1: 1, 2: 0, 3: 1}
    three = properties.is_bipartite(Graph.local(spark, 3, [(0, 1), (1, 2), (2, 0)]))
    assert not three.is_bipartite and len(three.odd_cycle) % 2 == 0 and three.odd_cycle[0] == three.odd_cycle[-1]


def pairs(g):
    return sorted((r["src"], r["dst"], r["weight"], r["directed"]) for r in g.edges.collect())


def test_transformations(spark):
    a = Graph.local(spark, 3, [(0, 1, 1), (1, 2, 2)])
    b = Graph.local(spark, 3, [(0, 1, 1), (1, 2, 3)])
    assert pairs(transform.graph_intersection(a, b)) == [(0, 1, 1.0, False), (1, 2, 2.0, False)]
    u, left, right = transform.graph_union(a, b)
    assert u.vertex_count() == 6 and pairs(u)[-1] == (4, 5, 3.0, False) and as_dict(right, value="new_id") == {0: 3, 1: 4, 2: 5}
    assert pairs(transform.complement(a)) == [(0, 2, 1.0, False)]
    assert pairs(transform.transpose(Graph.local(spark, 3, [(0, 1, 1, True), (1, 2, 2)]))) == [(1, 0, 1.0, True), (1, 2, 2.0, False)]
    some = spark.createDataFrame([(0,), (2,), (99,)], "id long")
    kept = transform.induced_subgraph(Graph.local(spark, 3, [(0, 2), (0, 1)]), some)
    assert kept.vertex_count() == 2 and pairs(kept) == [(0, 1, 1.0, False)]
    assert pairs(transform.filter_edges(a, "weight > 1")) == [(1, 2, 2.0, False)]


def test_views(spark):
    g = Graph.local(spark, 4, [(0, 1, 1, True), (1, 2, 2), (2, 3, 3)])
    assert pairs(views.reversed_view(g))[0] == (1, 0, 1.0, True) or (1, 0, 1.0, True) in pairs(views.reversed_view(g))
    v = views.filtered_view(g, "id <> 3", "weight < 2")
    assert ids(v.vertices) == [0, 1, 2] and pairs(v) == [(0, 1, 1.0, True)] and v.base is g
    s = views.subgraph_view(g, spark.createDataFrame([(1,), (2,), (99,)], "id long"))
    assert ids(s.vertex_set()) == [1, 2] and not s.has_vertex(99) and s.edge_count() == 1


def test_property_maps(spark):
    m = propmap.make_associative_property_map(spark)
    propmap.put(m, 3, 1.5)
    assert propmap.get(m, 3) == 1.5 and m.size() == 1 and not m.contains(4)
    with pytest.raises(KeyError):
        m.get(4)
    m.set_default(9.0)
    assert m.get(4) == 9.0
    v = propmap.make_vector_property_map(spark, 2, 0.5)
    v.put(4, 2.0)
    assert v.size() == 5 and v.get(3) == 0.5 and v.contains(4) and not v.contains(5)
    assert propmap.make_constant_property_map(spark, 7).get(1) == 7 and propmap.make_identity_property_map(spark).get(8) == 8

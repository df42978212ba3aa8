"""Registered queries over the warehouse graphs, and the same as SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkweft.factor import linearize as lin
from sparkweft.factor import losses, optimize
from sparkweft.factor.model import FactorGraph, Values
from sparkweft.functions import geometry
from sparkweft.graph import Graph
from sparkweft.operators import centrality, components, order, paths, propmap, properties, transform, traversal, views
from sparkweft.plans import graphs
from sparkweft.sources import dot
from sparkweft.storage import scratch_path

from .graphs import CUSTOMERS, GEOGRAPHY, HEAVY, LINES, NATIONS, PARTS, PURCHASES, SUPPLIERS, SUPPLY, TRADE, TRANSITIONS, WORLD

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def register(f: Query) -> Query:
        _QUERIES[name or f.__name__] = f
        if sql is not None:
            _SQL[name or f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _row(spark: SparkSession, **values) -> DataFrame:
    """One row of results that an algorithm returns as Python values."""
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])


ADJ = "adj AS (SELECT eid, src, dst, weight FROM e UNION ALL SELECT eid, dst, src, weight FROM e)"  # of an undirected graph
EDGES = "SELECT eid, src, dst, round(weight, 6) AS weight FROM "


def _edges(g: Graph) -> DataFrame:
    return g.edges.select("eid", "src", "dst", F.round("weight", 6).alias("weight"))


# -- the graph itself


@query(f"WITH {SUPPLY} SELECT (SELECT count(*) FROM v) AS n_vertices, (SELECT count(*) FROM e) AS n_edges")
def g_counts(spark, sf_dir):
    return graphs.supply(spark, sf_dir).counts()


@query(f"WITH {SUPPLY}, {ADJ} SELECT v.id, count(adj.src) AS degree FROM v LEFT JOIN adj ON adj.src = v.id GROUP BY v.id")
def g_degree(spark, sf_dir):
    return graphs.supply(spark, sf_dir).degrees()


@query(f"WITH {TRADE} SELECT src AS id, string_agg(dst, ',' ORDER BY eid) AS neighbors FROM e GROUP BY src")
def g_neighbors(spark, sf_dir):
    return graphs.trade(spark, sf_dir).neighbor_lists().select("id", F.array_join(F.transform("neighbors", lambda x: x.cast("string")), ",").alias("neighbors"))


@query(f"WITH {HEAVY} SELECT a.id AS u, b.id AS v, EXISTS (SELECT 1 FROM e WHERE src = a.id AND dst = b.id) AS present FROM v a, v b")
def g_has_edge(spark, sf_dir):
    g = graphs.heavy_trade(spark, sf_dir)
    ids = g.vertices.select("id")  # nations: 25 rows
    pairs = ids.select(F.col("id").alias("u"), F.lit(1).alias("k")).join(ids.select(F.col("id").alias("v"), F.lit(1).alias("k")), "k")
    return g.has_edges(pairs)


@query(f"WITH {GEOGRAPHY}, {ADJ} SELECT src, dst, min(eid) AS eid FROM adj GROUP BY src, dst")
def g_get_edge_first(spark, sf_dir):
    return graphs.geography(spark, sf_dir).first_edges()


@query(f"WITH {GEOGRAPHY} SELECT eid, least(src, dst) AS source, greatest(src, dst) AS target FROM e")
def g_edge_endpoints(spark, sf_dir):
    return graphs.geography(spark, sf_dir).endpoints()


@query(f"WITH {TRADE} SELECT eid, src, dst, CASE WHEN eid = 0 THEN 7.5 ELSE round(weight, 6) END AS weight FROM e")
def g_set_weight(spark, sf_dir):
    return _edges(graphs.trade(spark, sf_dir).set_weight(0, 7.5))


@query(f"WITH {TRADE} {EDGES} e WHERE eid <> 0")
def g_remove_edge(spark, sf_dir):
    return _edges(graphs.trade(spark, sf_dir).remove_edge(0))


@query(f"WITH {TRADE} {EDGES} e WHERE src <> 0 AND dst <> 0")
def g_remove_vertex(spark, sf_dir):
    return _edges(graphs.trade(spark, sf_dir).remove_vertex(0))


@query(f"WITH {SUPPLY}, n AS (SELECT max(id) AS id, (SELECT max(eid) FROM e) AS eid FROM v) {EDGES} e UNION ALL SELECT eid + 1, id + 1, 0, 2.5 FROM n")
def g_add(spark, sf_dir):
    g, v = graphs.supply(spark, sf_dir).add_vertex()
    return _edges(g.add_edge(v, 0, 2.5)[0])


# -- text


@query(
    f"""WITH {TRADE} SELECT 0 AS part, 0::BIGINT AS number, 'digraph G {{' AS line UNION ALL SELECT 1, id, '  v' || id || ';' FROM v
    UNION ALL SELECT 2, eid, '  v' || src || ' -> v' || dst || ' [weight=' || weight || '];' FROM e UNION ALL SELECT 3, 0, '}}'"""
)
def dot_lines(spark, sf_dir):
    return dot.dot_lines(graphs.trade(spark, sf_dir))


@query(f"WITH {TRADE} SELECT eid, src, dst, round(weight, 6) AS weight, true AS directed FROM e")
def dot_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "dot")
    dot.write_dot(graphs.trade(spark, sf_dir), path)
    back = dot.read_dot(spark, path)
    return back.edges.select("eid", "src", "dst", F.round("weight", 6).alias("weight"), "directed")


# -- searches

_TREE = f"WITH RECURSIVE {GEOGRAPHY}, walk AS (SELECT 0::BIGINT AS id, NULL::BIGINT AS parent, 0::BIGINT AS distance UNION ALL SELECT e.dst, walk.id, walk.distance + 1 FROM walk JOIN e ON e.src = walk.id)"


@query(_TREE + " SELECT * FROM walk")
def bfs_dist(spark, sf_dir):
    return traversal.bfs(graphs.geography(spark, sf_dir), 0).found.select("id", "parent", "distance")


@query(
    f"SELECT 0::BIGINT AS place, n_regionkey::BIGINT AS id FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey = 0 UNION ALL SELECT 1, c_nationkey + {NATIONS} FROM customer WHERE c_custkey = 0 UNION ALL SELECT 2, c_custkey + {CUSTOMERS} FROM customer WHERE c_custkey = 0"
)
def bfs_path(spark, sf_dir):
    g = graphs.geography(spark, sf_dir)
    region = graphs.table(spark, sf_dir, "customer").filter("c_custkey = 0").join(graphs.table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("n_regionkey").first()[0]
    walk = traversal.bfs(g, region, CUSTOMERS).path(region, CUSTOMERS)
    return spark.createDataFrame(list(enumerate(walk)), "place long, id long")


def _rounds(edges: str, n: int, start: str = "SELECT 0::BIGINT AS id, 0.0::DOUBLE AS distance") -> str:
    """Relaxation in n rounds, each a table of its own."""
    out = [f"d0 AS MATERIALIZED ({start})"]
    out += [f"d{k} AS MATERIALIZED (SELECT id, min(distance) AS distance FROM (SELECT * FROM d{k - 1} UNION ALL SELECT x.dst, d{k - 1}.distance + x.weight FROM d{k - 1} JOIN {edges} x ON x.src = d{k - 1}.id) GROUP BY id)" for k in range(1, n + 1)]
    return ", ".join(out)


@query(f"WITH {TRADE}, {_rounds('e', 25)} SELECT id, round(distance, 6) AS distance FROM d25")
def sssp(spark, sf_dir):
    return paths.shortest_distances(graphs.trade(spark, sf_dir), 0).select("id", F.round("distance", 6).alias("distance"))


@query(f"WITH {TRADE}, {_rounds('e', 25)} SELECT true AS found, round(distance, 6) AS distance FROM d25 WHERE id = 24")
def dijkstra(spark, sf_dir):
    r = paths.dijkstra(graphs.trade(spark, sf_dir), 0, 24)
    return _row(spark, found=r.found, distance=round(r.distance, 6))


@query(f"WITH {TRADE}, {_rounds('e', 25)} SELECT true AS found, round(distance, 6) AS distance FROM d25 WHERE id = 24")
def astar(spark, sf_dir):
    g = graphs.trade(spark, sf_dir)
    least = g.edges.agg(F.min("weight")).first()[0]
    r = paths.astar(g, 0, 24, lambda v, t: F.when(v == t, 0.0).otherwise(least))
    return _row(spark, found=r.found, distance=round(r.distance, 6))


def _tilted(spark, sf_dir) -> Graph:
    """The trade graph with weights that fall with the target's number: many are negative, but no cycle is."""
    g = graphs.trade(spark, sf_dir)
    return Graph(g.vertices, g.edges.withColumn("weight", F.col("weight") + 1000 * (F.col("src") - F.col("dst"))))


@query(f"WITH {TRADE}, x AS (SELECT src, dst, weight + 1000 * (src - dst) AS weight FROM e), {_rounds('x', 25)} SELECT id, round(distance, 6) AS distance FROM d25")
def bellman_ford(spark, sf_dir):
    return paths.bellman_ford(_tilted(spark, sf_dir), 0).distances.filter("distance < double('inf')").select("id", F.round("distance", 6).alias("distance"))


@query(f"WITH {TRADE}, x AS (SELECT src, dst, 100 - weight AS weight FROM e), {_rounds('x', 26)} SELECT exists(SELECT 1 FROM d25 JOIN d26 USING (id) WHERE d26.distance < d25.distance) AS has_negative_cycle")
def neg_cycle(spark, sf_dir):
    g = graphs.trade(spark, sf_dir)
    turned = Graph(g.vertices, g.edges.withColumn("weight", 100 - F.col("weight")))
    return _row(spark, has_negative_cycle=paths.has_negative_cycle(turned, 0))


# -- components, order

_ROOTS = f"""roots AS (SELECT r_regionkey::BIGINT AS id, r_regionkey::BIGINT AS root FROM region UNION ALL SELECT n_nationkey + {NATIONS}, n_regionkey FROM nation
  UNION ALL SELECT c_custkey + {CUSTOMERS}, n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT s_suppkey + {SUPPLIERS}, n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""


@query(f"WITH {_ROOTS} SELECT id, dense_rank() OVER (ORDER BY root) - 1 AS component, root FROM roots")
def cc(spark, sf_dir):
    return components.connected_components(graphs.geography(spark, sf_dir))


@query(f"WITH {_ROOTS} SELECT max(n) AS largest, count(*) AS components FROM (SELECT count(*) AS n FROM roots GROUP BY root)")
def cc_largest(spark, sf_dir):
    sizes = components.component_sizes(components.connected_components(graphs.geography(spark, sf_dir)))
    return sizes.agg(F.max("size").alias("largest"), F.count("*").alias("components"))


@query(f"WITH {_ROOTS} SELECT (SELECT root FROM roots WHERE id = {CUSTOMERS}) = (SELECT root FROM roots WHERE id = {SUPPLIERS}) AS same")
def same_component(spark, sf_dir):
    return _row(spark, same=components.same_component(graphs.geography(spark, sf_dir), CUSTOMERS, SUPPLIERS))


@query(
    f"""WITH RECURSIVE {HEAVY}, r AS (SELECT id AS a, id AS b FROM v UNION SELECT r.a, e.dst FROM r JOIN e ON e.src = r.b),
    c AS (SELECT x.a AS id, min(x.b) AS root FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY x.a) SELECT id, dense_rank() OVER (ORDER BY root) - 1 AS component, root FROM c"""
)
def scc(spark, sf_dir):
    return components.strongly_connected_components(graphs.heavy_trade(spark, sf_dir))


@query(f"WITH RECURSIVE {HEAVY}, r AS (SELECT src AS a, dst AS b FROM e UNION SELECT r.a, e.dst FROM r JOIN e ON e.src = r.b) SELECT exists(SELECT 1 FROM r WHERE a = b) AS has_cycle")
def has_cycle_dir(spark, sf_dir):
    return _row(spark, has_cycle=order.has_cycle_directed(graphs.heavy_trade(spark, sf_dir)))


@query(f"WITH {GEOGRAPHY}, {_ROOTS} SELECT (SELECT count(*) FROM e) > (SELECT count(*) - count(DISTINCT root) FROM roots) AS has_cycle")
def has_cycle_undir(spark, sf_dir):
    return _row(spark, has_cycle=order.has_cycle_undirected(graphs.geography(spark, sf_dir)))


@query(
    f"""WITH {PURCHASES}, a AS (SELECT v.id, CASE WHEN e.dst IS NULL THEN 0 ELSE 1 END AS has FROM v LEFT JOIN (SELECT DISTINCT dst FROM e) e ON e.dst = v.id),
    l1 AS (SELECT id, has AS l FROM a), l2 AS (SELECT e.dst AS id, max(l + 1) AS l FROM e JOIN l1 ON e.src = l1.id GROUP BY 1) SELECT l1.id, CAST(greatest(l1.l, coalesce(l2.l, 0)) AS BIGINT) AS layer FROM l1 LEFT JOIN l2 USING (id)"""
)
def topo_layers(spark, sf_dir):
    return order.topological_layers(graphs.purchases(spark, sf_dir))


@query(f"WITH {PURCHASES} SELECT true AS is_dag, (SELECT count(*) FROM v) AS placed, 0::BIGINT AS wrong")
def topo_order(spark, sf_dir):
    g = graphs.purchases(spark, sf_dir)
    r = order.topological_sort(g)
    place = lambda end: r.order.select(F.col("id").alias(end), F.col("place").alias(f"p_{end}"))
    wrong = g.edges.join(place("src"), "src").join(place("dst"), "dst").filter("p_src >= p_dst").count()
    return _row(spark, is_dag=r.is_dag, placed=r.order.count(), wrong=wrong)


@query()
def mst_weight(spark, sf_dir):
    forest = components.spanning_forest(graphs.supply(spark, sf_dir))
    return forest.agg(F.count("*").alias("n_edges"), F.round(F.sum("weight"), 4).alias("total_weight"))


@query(f"WITH {WORLD} SELECT eid, true AS spans, (SELECT sum(weight) FROM e) AS total_weight FROM e")
def prim_mst(spark, sf_dir):
    t = components.prim_mst(graphs.world(spark, sf_dir))
    return t.edges.select("eid", F.lit(t.is_spanning_tree).alias("spans"), F.lit(t.total_weight).alias("total_weight"))


# -- centrality and properties


def _degree_sql(source: str) -> str:
    return f"WITH {source}, s AS (SELECT id, (SELECT count(*) FROM e WHERE src = id) + (SELECT count(*) FROM e WHERE dst = id) AS d FROM v) SELECT id, round(d / ((SELECT count(*) FROM v) - 1.0), 9) AS score FROM s"


def _scores(df: DataFrame) -> DataFrame:
    return df.select("id", F.round("score", 9).alias("score"))


@query(_degree_sql(TRADE))
def degree_centrality(spark, sf_dir):
    return _scores(centrality.degree_centrality_all(graphs.trade(spark, sf_dir)))


@query(f"WITH {SUPPLY}, {ADJ} SELECT v.id, round(count(adj.src) / (2.0 * ((SELECT count(*) FROM v) - 1)), 9) AS score FROM v LEFT JOIN adj ON adj.src = v.id GROUP BY v.id")
def degree_centrality_undirected(spark, sf_dir):
    return _scores(centrality.degree_centrality_all(graphs.supply(spark, sf_dir)))


_HOPS = f"WITH RECURSIVE {HEAVY}, w AS (SELECT id AS s, id AS t, 0 AS d FROM v UNION SELECT w.s, e.dst, w.d + 1 FROM w JOIN e ON e.src = w.t WHERE w.d < 25), h AS (SELECT s, t, min(d) AS d FROM w GROUP BY s, t)"


@query(_HOPS + " SELECT s AS id, round(CASE WHEN count(*) = (SELECT count(*) FROM v) AND sum(d) > 0 THEN ((SELECT count(*) FROM v) - 1.0) / sum(d) ELSE 0 END, 9) AS score FROM h GROUP BY s")
def closeness(spark, sf_dir):
    return _scores(centrality.closeness_centrality_all(graphs.heavy_trade(spark, sf_dir)))


#: Shortest paths are followed one by one, then counted.
_SIGMA = _HOPS + ", q AS (SELECT s, t, d FROM h WHERE d = 0 UNION ALL SELECT q.s, e.dst, q.d + 1 FROM q JOIN e ON e.src = q.t JOIN h ON h.s = q.s AND h.t = e.dst AND h.d = q.d + 1), n AS (SELECT s, t, count(*) AS k, any_value(d) AS d FROM q GROUP BY s, t), b AS (SELECT x.t AS id, sum(x.k * y.k / z.k::DOUBLE) AS score FROM n x JOIN n y ON y.s = x.t JOIN n z ON z.s = x.s AND z.t = y.t AND z.d = x.d + y.d WHERE x.s <> x.t AND y.s <> y.t GROUP BY x.t)"


@query(_SIGMA + " SELECT v.id, round(coalesce(score, 0), 9) AS score FROM v LEFT JOIN b USING (id)")
def betweenness(spark, sf_dir):
    return _scores(centrality.betweenness_centrality(graphs.heavy_trade(spark, sf_dir)))


@query(_SIGMA + " SELECT v.id, round(coalesce(score, 0) / (((SELECT count(*) FROM v) - 1) * ((SELECT count(*) FROM v) - 2)), 9) AS score FROM v LEFT JOIN b USING (id)")
def betweenness_norm(spark, sf_dir):
    return _scores(centrality.betweenness_centrality_normalized(graphs.heavy_trade(spark, sf_dir)))


@query(_degree_sql(HEAVY) + " ORDER BY score DESC, id LIMIT 5")
def topk(spark, sf_dir):
    return flagship(spark, sf_dir)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nations of highest degree centrality among the heavy trade edges."""
    return _scores(centrality.top_k_central_vertices(centrality.degree_centrality_all(graphs.heavy_trade(spark, sf_dir)), 5))


@query(f"SELECT id FROM ({_degree_sql(HEAVY)}) ORDER BY score DESC, id LIMIT 1")
def most_central(spark, sf_dir):
    return _row(spark, id=centrality.most_central_vertex(centrality.degree_centrality_all(graphs.heavy_trade(spark, sf_dir))))


@query()
def pagerank(spark, sf_dir):
    return _scores(centrality.pagerank(graphs.trade(spark, sf_dir)))


@query(f"WITH {SUPPLY} SELECT v.id, CASE WHEN id >= {PARTS} AND EXISTS (SELECT 1 FROM e WHERE dst = id) THEN 1 ELSE 0 END AS color FROM v")
def bipartite(spark, sf_dir):
    return properties.is_bipartite(graphs.supply(spark, sf_dir)).coloring


@query(f"WITH RECURSIVE {HEAVY}, r AS (SELECT src AS a, dst AS b FROM e UNION SELECT r.a, e.dst FROM r JOIN e ON e.src = r.b) SELECT NOT exists(SELECT 1 FROM r WHERE a = b) AS heavy_trade, true AS purchases")
def acyclic(spark, sf_dir):
    return _row(spark, heavy_trade=order.is_acyclic(graphs.heavy_trade(spark, sf_dir)), purchases=order.is_acyclic(graphs.purchases(spark, sf_dir)))


_ECC = f"WITH RECURSIVE {WORLD}, {ADJ}, w AS (SELECT id AS s, id AS t, NULL::BIGINT AS p, 0.0::DOUBLE AS d FROM v UNION ALL SELECT w.s, adj.dst, w.t, w.d + adj.weight FROM w JOIN adj ON adj.src = w.t WHERE adj.dst IS DISTINCT FROM w.p), ecc AS (SELECT s AS id, max(d) AS x FROM w GROUP BY s)"


@query(_ECC + " SELECT max(x) AS diameter FROM ecc")
def diameter(spark, sf_dir):
    return _row(spark, diameter=properties.graph_diameter(graphs.world(spark, sf_dir)))


@query(_ECC + " SELECT min(x) AS radius FROM ecc")
def radius(spark, sf_dir):
    return _row(spark, radius=properties.graph_radius(graphs.world(spark, sf_dir), "shortest"))


@query(_ECC + " SELECT id FROM ecc WHERE x = (SELECT min(x) FROM ecc)")
def center(spark, sf_dir):
    return properties.graph_center(graphs.world(spark, sf_dir))


# -- transformations and views


@query(f"WITH {TRADE} SELECT eid, dst AS src, src AS dst, round(weight, 6) AS weight FROM e")
def transpose(spark, sf_dir):
    return _edges(transform.transpose(graphs.trade(spark, sf_dir)))


_EVEN = "id % 2 = 0"


@query(f"WITH {TRADE} SELECT row_number() OVER (ORDER BY eid) - 1 AS eid, src // 2 AS src, dst // 2 AS dst, round(weight, 6) AS weight FROM e WHERE src % 2 = 0 AND dst % 2 = 0")
def induced(spark, sf_dir):
    g = graphs.trade(spark, sf_dir)
    return _edges(transform.induced_subgraph(g, g.vertices.filter(_EVEN).select("id")))


@query(f"WITH {TRADE} SELECT row_number() OVER (ORDER BY eid) - 1 AS eid, src // 2 AS src, dst // 2 AS dst, round(weight, 6) AS weight FROM e WHERE src % 2 = 0 AND dst % 2 = 0 AND eid % 3 = 0")
def edge_subgraph(spark, sf_dir):
    g = graphs.trade(spark, sf_dir)
    return _edges(transform.edge_subgraph(g, g.vertices.filter(_EVEN).select("id"), g.edges.filter("eid % 3 = 0").select("eid")))


@query(f"WITH {TRADE}, t4 AS (WITH {TRANSITIONS} SELECT * FROM e) SELECT eid, src, dst, round(weight, 6) AS weight FROM e UNION ALL SELECT eid + (SELECT count(*) FROM e), src + (SELECT count(*) FROM v), dst + (SELECT count(*) FROM v), weight FROM t4")
def g_union(spark, sf_dir):
    return _edges(transform.graph_union(graphs.trade(spark, sf_dir), graphs.transitions(spark, sf_dir))[0])


@query(f"WITH {TRADE}, t4 AS (WITH {TRANSITIONS} SELECT * FROM e), t5 AS (WITH {TRANSITIONS} SELECT * FROM v) SELECT row_number() OVER (ORDER BY eid) - 1 AS eid, src, dst, round(weight, 6) AS weight FROM e WHERE src IN (SELECT id FROM t5) AND dst IN (SELECT id FROM t5) AND EXISTS (SELECT 1 FROM t4 WHERE t4.src = e.src AND t4.dst = e.dst)")
def g_intersection(spark, sf_dir):
    return _edges(transform.graph_intersection(graphs.trade(spark, sf_dir), graphs.transitions(spark, sf_dir)))


@query(f"WITH {WORLD}, i AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS k FROM v) SELECT row_number() OVER (ORDER BY a.k, b.k) - 1 AS eid, a.k AS src, b.k AS dst, 1.0::DOUBLE AS weight FROM i a JOIN i b ON a.id < b.id WHERE NOT EXISTS (SELECT 1 FROM e WHERE least(src, dst) = a.id AND greatest(src, dst) = b.id)")
def g_complement(spark, sf_dir):
    return _edges(transform.complement(graphs.world(spark, sf_dir)))


@query(f"WITH {TRANSITIONS}, k AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS n FROM v WHERE name <> 'error') SELECT row_number() OVER (ORDER BY eid) - 1 AS eid, a.n AS src, b.n AS dst, round(weight, 6) AS weight FROM e JOIN k a ON a.id = src JOIN k b ON b.id = dst")
def filter_vertices(spark, sf_dir):
    return _edges(transform.filter_vertices(graphs.transitions(spark, sf_dir), "name <> 'error'"))


@query(f"WITH {TRADE} SELECT row_number() OVER (ORDER BY eid) - 1 AS eid, src, dst, round(weight, 6) AS weight FROM e WHERE src < dst")
def filter_edges(spark, sf_dir):
    return _edges(transform.filter_edges(graphs.trade(spark, sf_dir), "src < dst"))


@query(f"WITH {TRADE} SELECT eid, dst AS src, src AS dst, round(weight, 6) AS weight FROM e")
def view_reversed(spark, sf_dir):
    return _edges(views.reversed_view(graphs.trade(spark, sf_dir)))


@query(f"WITH {TRADE} {EDGES} e WHERE src < 12 AND dst < 12 AND src < dst")
def view_filtered(spark, sf_dir):
    return _edges(views.filtered_view(graphs.trade(spark, sf_dir), "id < 12", "src < dst"))


@query(f"WITH {TRADE} {EDGES} e WHERE src % 2 = 0 AND dst % 2 = 0")
def view_subgraph(spark, sf_dir):
    g = graphs.trade(spark, sf_dir)
    return _edges(views.subgraph_view(g, g.vertices.filter(_EVEN).select("id")))


# -- property maps


def _balances(spark, sf_dir, column="s_acctbal"):
    return graphs.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.col(column).cast("double").alias("value"))


@query(f"WITH {SUPPLY} SELECT v.id AS key, coalesce(s_acctbal, -1) AS value FROM v LEFT JOIN supplier ON s_suppkey = v.id")
def propmap_default(spark, sf_dir):
    m = propmap.make_associative_property_map(spark, default=-1.0, values=_balances(spark, sf_dir))
    return m.lookup(graphs.supply(spark, sf_dir).vertices.select(F.col("id").alias("key")))


@query("SELECT k AS key, coalesce(s_acctbal, 0) AS value FROM (SELECT unnest(range(0, (SELECT max(s_suppkey) + 6 FROM supplier))) AS k) LEFT JOIN supplier ON s_suppkey = k")
def propmap_dense(spark, sf_dir):
    rows = _balances(spark, sf_dir)
    return propmap.VectorPropertyMap(spark, rows.agg(F.max("key")).first()[0] + 6, 0.0, rows).items()


@query(f"WITH {SUPPLY} SELECT v.id, s_acctbal AS balance, CASE WHEN s_suppkey IS NULL THEN 0 ELSE s_nationkey END::DOUBLE AS nation, 'x' AS mark FROM v LEFT JOIN supplier ON s_suppkey = v.id WHERE v.id < {PARTS}")
def propmap_composite(spark, sf_dir):
    c = propmap.CompositePropertyMap()
    c.add_vertex_property("balance", propmap.AssociativePropertyMap(spark, _balances(spark, sf_dir), default=0.0))
    c.add_vertex_property("nation", propmap.AssociativePropertyMap(spark, _balances(spark, sf_dir, "s_nationkey"), default=0.0))
    c.add_vertex_property("mark", propmap.ConstantPropertyMap(spark, "x"))
    return c.attach(graphs.supply(spark, sf_dir)).vertices.filter(F.col("id") < PARTS).select("id", "balance", "nation", "mark")


# -- factor graphs


@query("SELECT o_orderkey, (111::BIGINT << 56) + o_orderkey AS key, 'o' AS chr, o_orderkey AS idx FROM orders")
def symbol_codec(spark, sf_dir):
    keyed = graphs.table(spark, sf_dir, "orders").select("o_orderkey", geometry.symbol("o", F.col("o_orderkey")).alias("key"))
    return keyed.select("o_orderkey", "key", geometry.symbol_chr(F.col("key")).alias("chr"), geometry.symbol_index(F.col("key")).alias("idx"))


def _chain_values(lines: DataFrame, factors: DataFrame, value) -> DataFrame:
    """Values of all keys of the chains: ``value`` for each line, and 0.25 where a chain starts."""
    start = factors.filter("kind = 'prior'").select(F.get("keys", F.lit(0)).alias("key"), F.lit(0.25).alias("x"))
    return start.union(lines.select("key", value)).select("key", F.lit("scalar").alias("kind"), F.array("x").alias("v"))


@query(f"WITH {LINES} SELECT key FROM lines UNION SELECT key - 1 FROM lines")
def factor_keys(spark, sf_dir):
    return FactorGraph(graphs.line_chains(spark, sf_dir)[1]).keys()


_ERRORS = f"""WITH {LINES}, x AS (SELECT key, l_extendedprice / 1000 AS x, k, l_quantity FROM lines), y AS (SELECT key, x FROM x UNION ALL SELECT key - 1, 0.25 FROM x WHERE k = 1),
pe AS (SELECT y.key, 0.5 * (y.x / 0.1) ** 2 AS error FROM x JOIN y ON y.key = x.key - 1 WHERE x.k = 1), be AS (SELECT x.key, 0.5 * ((x.x - y.x - x.l_quantity) / 0.1) ** 2 AS error FROM x JOIN y ON y.key = x.key - 1)"""


def _chain_errors(spark, sf_dir, kind: str) -> DataFrame:
    lines, factors = graphs.line_chains(spark, sf_dir)
    values = _chain_values(lines, factors, F.col("l_extendedprice") / 1000)
    of_kind = factors.filter(F.col("kind") == kind)
    last = of_kind.select("fid", F.element_at("keys", -1).alias("key"))
    return lin.errors(of_kind, values).join(last, "fid").select("key", F.round(F.sqrt("error"), 6).alias("root"))


@query(_ERRORS + " SELECT key, round(sqrt(error), 6) AS root FROM pe")
def prior_error(spark, sf_dir):
    return _chain_errors(spark, sf_dir, "prior")


@query(_ERRORS + " SELECT key, round(sqrt(error), 6) AS root FROM be")
def between_error(spark, sf_dir):
    return _chain_errors(spark, sf_dir, "between")


@query(_ERRORS + " SELECT round(sum(error) / 1e6, 3) AS total FROM (SELECT * FROM pe UNION ALL SELECT * FROM be)")
def total_error(spark, sf_dir):
    lines, factors = graphs.line_chains(spark, sf_dir)
    values = _chain_values(lines, factors, F.col("l_extendedprice") / 1000)
    return lin.errors(factors, values).agg(F.round(F.sum("error") / 1e6, 3).alias("total"))


def _poses(spark, sf_dir, losses_too: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(prior factors, between factors, values): a pose for each line, near its successor in the order."""
    lines, _ = graphs.line_chains(spark, sf_dir)
    values = lines.select("key", F.lit("se2").alias("kind"), F.array(F.col("l_discount") * 20, F.col("l_quantity") / 10, F.col("l_tax") * 30).alias("v"))
    pose = F.struct((F.col("l_tax") * 25).alias("theta"), F.lit(1.5).alias("x"), (F.col("l_discount") * 10).alias("y"))
    sigma, loss = F.array(F.lit(0.5), F.lit(0.4), F.lit(0.2)), F.lit(None).cast("struct<name:string,k:double>")
    prior = lines.select(F.col("key").alias("fid"), F.lit("se2_prior").alias("kind"), F.array("key").alias("keys"), pose.alias("meas"), sigma.alias("sigma"), loss.alias("loss"))
    between = lines.filter("k > 1").select(F.col("key").alias("fid"), F.lit("se2_between").alias("kind"), F.array(F.col("key") - 1, "key").alias("keys"), pose.alias("meas"), sigma.alias("sigma"), loss.alias("loss"))
    return prior, between, values


_POSES = f"WITH {LINES}, p AS (SELECT key, k, l_discount * 20 AS th, l_quantity / 10 AS x, l_tax * 30 AS y, l_tax * 25 AS mt, 1.5 AS mx, l_discount * 10 AS my FROM lines)"
_LOG = "l AS (SELECT key, t, CASE WHEN abs(t) < 1e-6 THEN 1 - t * t / 12 ELSE t / 2 * cos(t / 2) / sin(t / 2) END AS a, ex, ey FROM w), r AS (SELECT key, (a * ex + t / 2 * ey) / 0.5 AS r1, (a * ey - t / 2 * ex) / 0.4 AS r2, t / 0.2 AS r3 FROM l)"
#: The root, which unlike the error itself is no short decimal that rounding might split either way.
_POSE_ERROR = " SELECT key, round(sqrt(0.5 * (r1 * r1 + r2 * r2 + r3 * r3)), 6) AS root FROM r"


@query(f"{_POSES}, w AS (SELECT key, atan2(sin(th - mt), cos(th - mt)) AS t, cos(mt) * (x - mx) + sin(mt) * (y - my) AS ex, cos(mt) * (y - my) - sin(mt) * (x - mx) AS ey FROM p), {_LOG}{_POSE_ERROR}")
def se2_prior_error(spark, sf_dir):
    prior, _, values = _poses(spark, sf_dir)
    return lin.errors(prior, values).select(F.col("fid").alias("key"), F.round(F.sqrt("error"), 6).alias("root"))


@query(
    f"""{_POSES}, b AS (SELECT q.key, q.mt, q.mx, q.my, q.th - p.th AS u, cos(p.th) * (q.x - p.x) + sin(p.th) * (q.y - p.y) AS bx, cos(p.th) * (q.y - p.y) - sin(p.th) * (q.x - p.x) AS by_ FROM p JOIN p q ON q.key = p.key + 1 AND q.k > 1),
    w AS (SELECT key, atan2(sin(u - mt), cos(u - mt)) AS t, cos(mt) * (bx - mx) + sin(mt) * (by_ - my) AS ex, cos(mt) * (by_ - my) - sin(mt) * (bx - mx) AS ey FROM b), {_LOG}{_POSE_ERROR}"""
)
def se2_between_error(spark, sf_dir):
    _, between, values = _poses(spark, sf_dir)
    return lin.errors(between, values).select(F.col("fid").alias("key"), F.round(F.sqrt("error"), 6).alias("root"))


_NAMES = ("null", "huber", "cauchy", "tukey")


def _per_loss(spark, sf_dir, make) -> DataFrame:
    s = graphs.table(spark, sf_dir, "lineitem").select((F.col("l_quantity") * F.col("l_discount") * 10).alias("s")).distinct()
    loss = lambda n: F.struct(F.lit(n).alias("name"), F.lit(None).cast("double").alias("k"))
    return s.select(F.round("s", 6).alias("s"), *[F.round(make(loss(n), F.col("s")), 6).alias(n + "_") for n in _NAMES]).distinct()


_S = "WITH q AS (SELECT DISTINCT l_quantity * l_discount * 10 AS s FROM lineitem)"


@query(_S + """ SELECT DISTINCT round(s, 6) AS s, round(s, 6) AS null_, round(CASE WHEN s <= 1.345 ** 2 THEN s / 2 ELSE 1.345 * sqrt(s) - 1.345 ** 2 / 2 END, 6) AS huber_, round(2.3849 ** 2 / 2 * ln(1 + s / 2.3849 ** 2), 6) AS cauchy_,
 round(4.6851 ** 2 / 6 * CASE WHEN s <= 4.6851 ** 2 THEN 1 - (1 - s / 4.6851 ** 2) ** 3 ELSE 1 END, 6) AS tukey_ FROM q""")
def loss_eval(spark, sf_dir):
    return _per_loss(spark, sf_dir, losses.rho)


@query(_S + """ SELECT DISTINCT round(s, 6) AS s, 1.0::DOUBLE AS null_, round(CASE WHEN s <= 1.345 ** 2 THEN 1 ELSE 1.345 / sqrt(s) END, 6) AS huber_, round(2.3849 ** 2 / (2.3849 ** 2 + s), 6) AS cauchy_,
 round(CASE WHEN s <= 4.6851 ** 2 THEN (1 - s / 4.6851 ** 2) ** 2 ELSE 0 END, 6) AS tukey_ FROM q""")
def loss_weight(spark, sf_dir):
    return _per_loss(spark, sf_dir, losses.weight)


_SUMS = f"WITH {LINES} SELECT key, round(sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY k), 3) AS x FROM lines UNION ALL SELECT key - 1, 0.0 FROM lines WHERE k = 1"


def _optimum(spark, sf_dir, optimizer) -> DataFrame:
    lines, factors = graphs.line_chains(spark, sf_dir)
    values = _chain_values(lines, factors, F.lit(1.0))
    done = optimizer.optimize(FactorGraph(factors), Values(values)).values.table
    return done.select("key", (F.round(F.get("v", F.lit(0)), 3) + 0.0).alias("x"))


@query(_SUMS)
def gauss_newton(spark, sf_dir):
    return _optimum(spark, sf_dir, optimize.GaussNewtonOptimizer())


@query(_SUMS)
def levenberg(spark, sf_dir):
    return _optimum(spark, sf_dir, optimize.LevenbergMarquardtOptimizer(tolerance=1e-9))


from sparkweft.plans import details  # noqa: E402, F401 - registers the queries of its own

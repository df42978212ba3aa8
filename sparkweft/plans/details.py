"""Registered queries for single lookups, witnesses, property maps and the factor-graph surface; the rest is in the catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkweft import graph as free
from sparkweft.factor import adapter, dense, losses, optimize
from sparkweft.factor import linearize as lin
from sparkweft.factor.model import FactorGraph, Values
from sparkweft.functions import geometry
from sparkweft.operators import centrality, components, order, paths, propmap, transform, traversal
from sparkweft.plans import graphs
from sparkweft.sources import dot
from sparkweft.storage import scratch_path

from .catalog import _HOPS, _LOG, _POSES, _ROOTS, _SIGMA, EDGES, _chain_values, _edges, _poses, _rounds, _row, query
from .graphs import CUSTOMERS, GEOGRAPHY, HEAVY, LINES, NATIONS, PURCHASES, TRADE, TRANSITIONS

# -- the graph itself


@query(f"WITH {TRADE} SELECT id, CASE WHEN id = 3 THEN 5.5 END::DOUBLE AS mark, 5.5::DOUBLE AS read_back FROM v")
def g_vertex_property(spark, sf_dir):
    g = graphs.trade(spark, sf_dir).set_property(3, "mark", 5.5)
    return g.vertices.select("id", F.col("mark").cast("double").alias("mark"), F.lit(g.get_property(3, "mark")).alias("read_back"))


@query(f"WITH {TRADE} SELECT EXISTS (SELECT 1 FROM v WHERE id = 3) AS here, EXISTS (SELECT 1 FROM v WHERE id = 99) AS gone")
def g_has_vertex(spark, sf_dir):
    g = graphs.trade(spark, sf_dir)
    return _row(spark, here=g.has_vertex(3), gone=g.has_vertex(99))


@query(f"WITH {TRADE} SELECT round(weight, 6) AS weight FROM e WHERE eid = 7")
def g_get_weight(spark, sf_dir):
    return _row(spark, weight=round(graphs.trade(spark, sf_dir).get_weight(7), 6))


@query(f"WITH {TRADE} SELECT coalesce(min(eid), 0) AS eid, count(*) > 0 AS found, 0::BIGINT AS none, false AS none_found FROM e WHERE src = 2 AND dst = 3")
def g_edge(spark, sf_dir):
    g = graphs.trade(spark, sf_dir)
    (eid, found), (none, none_found) = g.edge(2, 3), g.edge(99, 99)
    return _row(spark, eid=eid, found=found, none=none, none_found=none_found).withColumns({"eid": F.col("eid").cast("long"), "none": F.col("none").cast("long")})


@query("SELECT 'directed' AS trade, 'undirected' AS geography")
def g_edge_type(spark, sf_dir):
    return _row(spark, trade=graphs.trade(spark, sf_dir).get_edge_type(0), geography=graphs.geography(spark, sf_dir).get_edge_type(0))


@query(f"WITH {TRADE} SELECT eid FROM e WHERE src = 5")
def g_out_edges(spark, sf_dir):
    return graphs.trade(spark, sf_dir).out_edges(5)


@query(f"WITH {GEOGRAPHY} SELECT id FROM v")
def g_vertices(spark, sf_dir):
    return graphs.geography(spark, sf_dir).vertex_ids()


@query(f"WITH {TRADE} SELECT eid, src, dst, round(weight, 6) AS weight, true AS directed FROM e")
def g_edges(spark, sf_dir):
    return graphs.trade(spark, sf_dir).edges.select("eid", "src", "dst", F.round("weight", 6).alias("weight"), "directed")


@query("SELECT 0::BIGINT AS n_vertices, 0::BIGINT AS n_edges")
def g_clear(spark, sf_dir):
    return graphs.trade(spark, sf_dir).clear().counts()


@query(f"WITH {TRADE} SELECT (SELECT count(*) FROM e) AS before, (SELECT count(*) FROM e) - 1 AS after")
def g_copy(spark, sf_dir):
    """A change of the copy leaves the original alone."""
    g = graphs.trade(spark, sf_dir)
    other = g.copy().remove_edge(0)
    return g.edges.agg(F.count("*").alias("before")).select("before", F.lit(other.edge_count()).cast("long").alias("after"))


@query(f"WITH {TRADE} SELECT (SELECT count(*) FROM v) + 1 AS vertices, (SELECT count(*) FROM e) AS edges, (SELECT count(*) FROM e WHERE src = 4) AS degree, (SELECT min(eid) FROM e WHERE src = 2 AND dst = 3) AS eid, 2::BIGINT AS source, 3::BIGINT AS target")
def g_free_functions(spark, sf_dir):
    g, v = free.add_vertex(graphs.trade(spark, sf_dir))
    g, e = free.add_edge(v, 4, g, 2.0, True)
    g = free.remove_edge(e, g)
    eid = free.get_edge(2, 3, g)
    values = {"vertices": free.num_vertices(g), "edges": free.num_edges(g), "degree": free.degree(4, g), "eid": eid, "source": free.source(eid, g), "target": free.target(eid, g)}
    return _row(spark, **values).select(*[F.col(c).cast("long").alias(c) for c in values])


@query(f"WITH {TRANSITIONS} SELECT id, '  v' || id || ' [label=\"' || name || '\"];' AS line FROM v")
def dot_labels(spark, sf_dir):
    return dot.dot_lines(graphs.transitions(spark, sf_dir), "name").filter("part = 1").select(F.col("number").alias("id"), "line")


@query(f"WITH {TRANSITIONS} SELECT id, upper(name) AS label FROM v")
def dot_label_reader(spark, sf_dir):
    path = scratch_path(spark, "dot")
    dot.write_dot(graphs.transitions(spark, sf_dir), path, "name")
    return dot.read_dot(spark, path, labels=F.upper).vertices.select("id", "label")


@query(f"WITH {TRADE}, t4 AS (WITH {TRANSITIONS} SELECT * FROM e) SELECT eid, src, dst, round(weight, 6) AS weight FROM e UNION ALL SELECT eid + (SELECT count(*) FROM e), src + (SELECT count(*) FROM v), dst + (SELECT count(*) FROM v), weight FROM t4")
def g_disjoint_union(spark, sf_dir):
    return _edges(transform.disjoint_union(graphs.trade(spark, sf_dir), graphs.transitions(spark, sf_dir))[0])


# -- searches and paths

#: The first region's tree: in depth-first order a nation comes before its customers, and these before its suppliers.
_DFS = f"""WITH c AS (SELECT c_nationkey AS nk, count(*) AS n FROM customer GROUP BY 1), s AS (SELECT s_nationkey AS nk, count(*) AS n FROM supplier GROUP BY 1),
n AS (SELECT n_nationkey AS nk, 1 + coalesce(c.n, 0) + coalesce(s.n, 0) AS size FROM nation LEFT JOIN c ON c.nk = n_nationkey LEFT JOIN s ON s.nk = n_nationkey WHERE n_regionkey = 0),
t AS (SELECT 0::BIGINT AS id, NULL::BIGINT AS parent, 0 AS depth, -1 AS nk, 1 + (SELECT sum(size) FROM n) AS size UNION ALL SELECT nk + {NATIONS}, 0, 1, nk, size FROM n
UNION ALL SELECT c_custkey + {CUSTOMERS}, nk + {NATIONS}, 2, nk, 1 FROM customer JOIN n ON c_nationkey = nk UNION ALL SELECT s_suppkey + 2000000000, nk + {NATIONS}, 2, nk, 1 FROM supplier JOIN n ON s_nationkey = nk),
p AS (SELECT *, row_number() OVER (ORDER BY nk, depth, id) - 1 AS pre FROM t)"""


@query(_DFS + " SELECT id, parent, 2 * pre - depth AS discovery, CAST(2 * pre - depth + 2 * size - 1 AS BIGINT) AS finish, pre AS preorder, CAST(pre - depth + size - 1 AS BIGINT) AS postorder FROM p")
def dfs_preorder(spark, sf_dir):
    return traversal.dfs(graphs.geography(spark, sf_dir), 0)


@query(_DFS + " SELECT id, parent, pre AS preorder FROM p")
def dfs_iterative(spark, sf_dir):
    return traversal.dfs_iterative(graphs.geography(spark, sf_dir), 0).select("id", "parent", "preorder")


#: The last nation of the first region, and what is seen before it.
@query(_DFS + ", k AS (SELECT max(pre) AS pre FROM p WHERE depth = 1) SELECT id, preorder, coalesce(id = (SELECT id FROM p JOIN k USING (pre)), false) AS target FROM (SELECT id, pre AS preorder FROM p WHERE pre <= (SELECT pre FROM k))")
def dfs_target(spark, sf_dir):
    last = graphs.table(spark, sf_dir, "nation").filter("n_regionkey = 0").agg(F.max("n_nationkey")).first()[0] + NATIONS
    return traversal.dfs(graphs.geography(spark, sf_dir), 0, last).select("id", "preorder", (F.col("id") == last).alias("target"))


@query(_DFS + f", k AS (SELECT max(pre) AS pre FROM p) SELECT place, id FROM (SELECT 2::BIGINT AS place, id FROM p JOIN k USING (pre) UNION ALL SELECT 1, parent FROM p JOIN k USING (pre) UNION ALL SELECT 0, 0)")
def dfs_path(spark, sf_dir):
    walk = traversal.dfs(graphs.geography(spark, sf_dir), 0)
    last = walk.agg(F.max_by("id", "preorder")).first()[0]
    return spark.createDataFrame(list(enumerate(traversal.reconstruct_path(walk, 0, last))), "place long, id long")


@query(_DFS + " SELECT id, row_number() OVER (ORDER BY depth, nk, id) - 1 AS rank FROM p")
def bfs_rank(spark, sf_dir):
    return traversal.bfs(graphs.geography(spark, sf_dir), 0).found.select("id", "rank")


@query(f"WITH {TRADE}, {_rounds('e', 25)} SELECT true AS found, round(distance, 6) AS distance FROM d25 WHERE id = 24")
def astar_dijkstra(spark, sf_dir):
    r = paths.astar_dijkstra(graphs.trade(spark, sf_dir), 0, 24)
    return _row(spark, found=r.found, distance=round(r.distance, 6))


def _path_row(spark, g, path):
    """Where a path starts and ends, and its weight, step by step along the lightest edge."""
    steps = spark.createDataFrame(list(zip(path, path[1:])), "src long, dst long")
    weight = steps.join(g.edges, ["src", "dst"]).groupBy("src", "dst").agg(F.min("weight").alias("weight"))
    return weight.agg(F.count("*").alias("n"), F.round(F.sum("weight"), 6).alias("distance")).select(F.lit(path[0]).alias("first"), F.lit(path[-1]).alias("last"), (F.col("n") == len(path) - 1).alias("unbroken"), "distance")


_PATH = f"WITH {TRADE}, {_rounds('e', 25)} SELECT 0 AS first, 24 AS last, true AS unbroken, round(distance, 6) AS distance FROM d25 WHERE id = 24"


@query(_PATH)
def dijkstra_path(spark, sf_dir):
    g = graphs.trade(spark, sf_dir)
    return _path_row(spark, g, paths.dijkstra(g, 0, 24).path)


@query(_PATH)
def bellman_ford_path(spark, sf_dir):
    g = graphs.trade(spark, sf_dir)
    return _path_row(spark, g, paths.get_shortest_path(g, 0, 24))


@query(f"WITH {TRADE}, {_rounds('e', 25)} SELECT round(distance, 6) AS distance FROM d25 WHERE id = 24")
def bellman_ford_distance(spark, sf_dir):
    return _row(spark, distance=round(paths.get_distance(graphs.trade(spark, sf_dir), 0, 24), 6))


@query("SELECT c_custkey, CAST(abs(c_custkey // 7 - c_nationkey // 7) + abs(c_custkey % 7 - c_nationkey % 7) AS DOUBLE) AS manhattan, round(sqrt((c_nationkey - c_custkey) * (c_nationkey - c_custkey) + (c_acctbal - 1.5) * (c_acctbal - 1.5)), 5) AS euclidean FROM customer")
def grid_distances(spark, sf_dir):
    c = graphs.table(spark, sf_dir, "customer").withColumns({"a": F.col("c_custkey").cast("long"), "b": F.col("c_nationkey").cast("long")})
    euclid = geometry.euclidean_distance(F.col("a"), F.lit(1.5), F.col("b"), F.col("c_acctbal").cast("double"))
    return c.select("c_custkey", geometry.manhattan_distance(F.col("a"), F.col("b"), 7).alias("manhattan"), F.round(euclid, 5).alias("euclidean"))


# -- components, order, trees


@query(f"WITH {_ROOTS}, {TRADE} SELECT (SELECT count(DISTINCT root) = 1 FROM roots) AS geography, true AS trade FROM (SELECT 1)")
def connected(spark, sf_dir):
    return _row(spark, geography=components.is_connected(graphs.geography(spark, sf_dir)), trade=components.is_connected(graphs.trade(spark, sf_dir)))


_SCC = f"WITH RECURSIVE {HEAVY}, r AS (SELECT id AS a, id AS b FROM v UNION SELECT r.a, e.dst FROM r JOIN e ON e.src = r.b), c AS (SELECT x.a AS id, min(x.b) AS root FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY x.a)"


@query(_SCC + " SELECT count(DISTINCT root) = 1 AS strongly_connected, (SELECT max(n) FROM (SELECT count(*) AS n FROM c GROUP BY root)) AS largest, (SELECT count(DISTINCT root) = 1 FROM c WHERE id IN (0, 1)) AS same FROM c")
def scc_facts(spark, sf_dir):
    g = graphs.heavy_trade(spark, sf_dir)
    row = _row(spark, strongly_connected=components.is_strongly_connected(g), largest=components.largest_scc_size(g), same=components.in_same_scc(g, 0, 1))
    return row.withColumn("largest", F.col("largest").cast("long"))


_REACH = f"WITH RECURSIVE {HEAVY}, r AS (SELECT src AS a, dst AS b FROM e UNION SELECT r.a, e.dst FROM r JOIN e ON e.src = r.b)"


def _witness(spark, g, cycle):
    """Whether there is a cycle, whether its ends meet, and how many of its steps are no edges."""
    steps = spark.createDataFrame(list(zip(cycle, cycle[1:])), "src long, dst long").distinct()
    known = g.adjacency.select("src", "dst").distinct()
    return steps.join(known, ["src", "dst"], "left_anti").agg(F.count("*").alias("broken")).select(F.lit(len(cycle) > 1).alias("has_cycle"), F.lit(not cycle or cycle[0] == cycle[-1]).alias("closed"), "broken")


@query(_REACH + " SELECT exists(SELECT 1 FROM r WHERE a = b) AS has_cycle, true AS closed, 0::BIGINT AS broken")
def cycle_witness(spark, sf_dir):
    g = graphs.heavy_trade(spark, sf_dir)
    return _witness(spark, g, order.find_cycle(g).cycle)


@query(_REACH + " SELECT exists(SELECT 1 FROM r WHERE a = b) AS has_cycle, true AS closed, 0::BIGINT AS broken")
def cycle_witness_dfs(spark, sf_dir):
    g = graphs.heavy_trade(spark, sf_dir)
    return _witness(spark, g, order.find_cycle_dfs(g))


@query("SELECT true AS has_cycle, true AS closed, 0::BIGINT AS broken")
def cycle_witness_undirected(spark, sf_dir):
    """Suppliers and parts form cycles as soon as two suppliers share two parts."""
    g = graphs.supply(spark, sf_dir)
    return _witness(spark, g, order.find_cycle_undirected(g).cycle)


@query(f"WITH {PURCHASES} SELECT true AS is_dag, (SELECT count(*) FROM v) AS placed, 0::BIGINT AS wrong")
def topo_order_dfs(spark, sf_dir):
    g = graphs.purchases(spark, sf_dir)
    r = order.topological_sort_dfs(g)
    place = lambda end: r.order.select(F.col("id").alias(end), F.col("place").alias(f"p_{end}"))
    wrong = g.edges.join(place("src"), "src").join(place("dst"), "dst").filter("p_src >= p_dst").agg(F.count("*").alias("wrong"))
    return wrong.select(F.lit(r.is_dag).alias("is_dag"), F.lit(r.order.count()).cast("long").alias("placed"), "wrong")


@query(f"WITH {GEOGRAPHY}, {_ROOTS}, t AS (WITH {TRADE} SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM e) SELECT (SELECT count(*) FROM e) = (SELECT count(*) - count(DISTINCT root) FROM roots) AS geography, (SELECT count(*) FROM t) < (SELECT count(*) FROM nation) AS trade")
def acyclic_undirected(spark, sf_dir):
    return _row(spark, geography=order.is_acyclic_undirected(graphs.geography(spark, sf_dir)), trade=order.is_acyclic_undirected(graphs.trade(spark, sf_dir)))


#: An edge is in the tree unless a way of lighter ones joins its ends.
_MST = f"""WITH RECURSIVE {TRADE}, b AS (SELECT eid, src AS a, dst AS b, weight FROM e UNION ALL SELECT eid, dst, src, weight FROM e),
r AS (SELECT eid, src AS at, weight FROM e UNION SELECT r.eid, b.b, r.weight FROM r JOIN b ON b.a = r.at AND (b.weight < r.weight OR (b.weight = r.weight AND b.eid < r.eid)))
SELECT eid FROM e WHERE src <> dst AND NOT EXISTS (SELECT 1 FROM r WHERE r.eid = e.eid AND r.at = e.dst)"""


@query(_MST)
def mst_trade(spark, sf_dir):
    return components.spanning_forest(graphs.trade(spark, sf_dir)).select("eid")


@query(_MST)
def prim_mst_start(spark, sf_dir):
    return components.prim_mst(graphs.trade(spark, sf_dir), 3).edges.select("eid")


# -- centrality of one vertex


@query(f"WITH {HEAVY} SELECT round(((SELECT count(*) FROM e WHERE src = 3) + (SELECT count(*) FROM e WHERE dst = 3)) / ((SELECT count(*) FROM v) - 1.0), 9) AS score")
def degree_centrality_one(spark, sf_dir):
    return _row(spark, score=round(centrality.degree_centrality(graphs.heavy_trade(spark, sf_dir), 3), 9))


@query(_HOPS + " SELECT round(CASE WHEN count(*) = (SELECT count(*) FROM v) AND sum(d) > 0 THEN ((SELECT count(*) FROM v) - 1.0) / sum(d) ELSE 0 END, 9) AS score FROM h WHERE s = 3")
def closeness_one(spark, sf_dir):
    return _row(spark, score=round(centrality.closeness_centrality(graphs.heavy_trade(spark, sf_dir), 3), 9))


@query(_SIGMA.split(", b AS (")[0] + " SELECT x.t AS id, round(coalesce(sum(x.k * y.k / z.k::DOUBLE) FILTER (y.t <> x.t), 0), 9) AS score FROM n x JOIN n y ON y.s = x.t JOIN n z ON z.s = 3 AND z.t = y.t AND z.d = x.d + y.d WHERE x.s = 3 AND x.t <> 3 GROUP BY x.t")
def betweenness_one(spark, sf_dir):
    return centrality.betweenness_single_source(graphs.heavy_trade(spark, sf_dir), 3).filter("id <> 3").select("id", F.round("score", 9).alias("score"))


# -- property maps


@query(f"WITH {TRADE} SELECT id AS key, id AS value FROM v")
def propmap_identity(spark, sf_dir):
    return propmap.make_identity_property_map(spark).lookup(graphs.trade(spark, sf_dir).vertices.select(F.col("id").alias("key")))


@query("SELECT 7.5::DOUBLE AS got, true AS present, false AS erased, (SELECT count(*) FROM supplier) AS size")
def propmap_interface(spark, sf_dir):
    values = graphs.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_acctbal").cast("double").alias("value"))
    m = propmap.make_associative_property_map(spark, default=0.0, values=values)
    propmap.put(m, -5, 7.5)
    got, present = propmap.get(m, -5), m.contains(-5)
    m.erase(-5)
    return _row(spark, got=got, present=present, erased=m.contains(-5), size=m.size()).withColumn("size", F.col("size").cast("long"))


# -- factor graphs

_FIRST = f"WITH {LINES}, f AS (SELECT min(key) AS key FROM lines)"


@query(_FIRST + " SELECT (SELECT count(*) + count(*) FILTER (k = 1) FROM lines) AS size, (SELECT 1 + count(*) FROM lines WHERE key = (SELECT key + 1 FROM f)) AS involving FROM f")
def factor_shape(spark, sf_dir):
    lines, factors = graphs.line_chains(spark, sf_dir)
    first = lines.agg(F.min("key")).first()[0]
    g = FactorGraph(factors)
    return _row(spark, size=g.size(), involving=g.involving(first).size()).select(F.col("size").cast("long").alias("size"), F.col("involving").cast("long").alias("involving"))


@query(_FIRST + " SELECT (SELECT count(*) + count(*) FILTER (k = 1) FROM lines) AS size, true AS here, false AS erased, round((SELECT l_extendedprice / 1000 FROM lines WHERE key = (SELECT key FROM f)), 6) AS first FROM f")
def values_shape(spark, sf_dir):
    lines, factors = graphs.line_chains(spark, sf_dir)
    v = Values(_chain_values(lines, factors, F.col("l_extendedprice") / 1000))
    first = lines.agg(F.min("key")).first()[0]
    row = _row(spark, size=v.size(), here=v.exists(first), erased=v.erase(first).exists(first), first=round(v.at(first, "scalar"), 6))
    return row.withColumn("size", F.col("size").cast("long"))


_SQUARES = f"{_POSES}, w AS (SELECT key, atan2(sin(th - mt), cos(th - mt)) AS t, cos(mt) * (x - mx) + sin(mt) * (y - my) AS ex, cos(mt) * (y - my) - sin(mt) * (x - mx) AS ey FROM p), {_LOG}, q AS (SELECT key, r1 * r1 + r2 * r2 + r3 * r3 AS s FROM r)"


@query(_SQUARES + " SELECT key, round(sqrt(CASE WHEN s <= 1.345 ** 2 THEN s / 2 ELSE 1.345 * sqrt(s) - 1.345 ** 2 / 2 END), 6) AS root FROM q")
def robust_error(spark, sf_dir):
    """A loss from its factory, set on all factors."""
    prior, _, values = _poses(spark, sf_dir)
    robust = FactorGraph(prior).with_loss(*losses.huber_loss())
    return lin.errors(robust.factors, values).select(F.col("fid").alias("key"), F.round(F.sqrt("error"), 6).alias("root"))


@query(_SQUARES + " SELECT key, round(sqrt(2.0 * 2.0 / 2 * ln(1 + s / (2.0 * 2.0))), 6) AS root FROM q")
def robust_error_scaled(spark, sf_dir):
    prior, _, values = _poses(spark, sf_dir)
    robust = FactorGraph(prior).with_loss(*losses.cauchy_loss(2.0))
    return lin.errors(robust.factors, values).select(F.col("fid").alias("key"), F.round(F.sqrt("error"), 6).alias("root"))


@query("SELECT l_orderkey, l_linenumber, round(l_quantity / 3 - ln(1 + l_quantity / 3), 6) AS cost FROM lineitem")
def user_loss(spark, sf_dir):
    """A loss of the user's own, registered by name."""
    losses.register_loss("fair", losses.Loss(lambda s, k: F.sqrt(s) / k - F.log1p(F.sqrt(s) / k), lambda s, k: 1 / (1 + F.sqrt(s) / k), 3.0))
    loss = F.struct(F.lit("fair").alias("name"), F.lit(None).cast("double").alias("k"))
    line = graphs.table(spark, sf_dir, "lineitem")
    return line.select("l_orderkey", "l_linenumber", F.round(losses.rho(loss, F.col("l_quantity") * F.col("l_quantity")), 6).alias("cost"))


@query(f"WITH {LINES} SELECT key, round(abs((l_quantity / 10) ** 2 - 2.5) / 0.5 / sqrt(2.0), 6) AS root, round(2 * l_quantity / 10 / 0.5, 3) AS slope FROM lines")
def user_factor(spark, sf_dir):
    """A factor kind of the user's own: the square of a scalar is measured; its slope is found numerically."""
    lin.register_kind("square", lin.Kind(1, "scalar", lambda a, b, m: [F.get(a, F.lit(0)) * F.get(a, F.lit(0)) - m["x"]], robust=False))
    lines, _ = graphs.line_chains(spark, sf_dir)
    values = lines.select("key", F.lit("scalar").alias("kind"), F.array(F.col("l_quantity") / 10).alias("v"))
    measured = F.struct(F.lit(0.0).alias("theta"), F.lit(2.5).alias("x"), F.lit(0.0).alias("y"))
    factors = lines.select(F.col("key").alias("fid"), F.lit("square").alias("kind"), F.array("key").alias("keys"), measured.alias("meas"), F.array(F.lit(0.5)).alias("sigma"), F.lit(None).cast("struct<name:string,k:double>").alias("loss"))
    slope = F.get(F.get(F.get("jacobians", F.lit(0)), F.lit(0)), F.lit(0))
    return lin.linearize(factors, values).select(F.col("fid").alias("key"), F.round(F.sqrt(F.col("s") / 2), 6).alias("root"), F.round(slope, 3).alias("slope"))


_CHAIN = f"WITH {LINES}, x AS (SELECT key, k, l_quantity AS q, l_extendedprice / 1000 AS x FROM lines), y AS (SELECT key, x FROM x UNION ALL SELECT key - 1, 0.25 FROM x WHERE k = 1), b AS (SELECT x.key, (x.x - y.x - x.q) / 0.1 AS r FROM x JOIN y ON y.key = x.key - 1)"


def _chain(spark, sf_dir):
    lines, factors = graphs.line_chains(spark, sf_dir)
    return lines, factors, Values(_chain_values(lines, factors, F.col("l_extendedprice") / 1000))


@query(_CHAIN + " SELECT key, round(r, 5) AS b, -10.0::DOUBLE AS j0, 10.0::DOUBLE AS j1 FROM b")
def linearized(spark, sf_dir):
    _, factors, values = _chain(spark, sf_dir)
    block = lambda i: F.round(F.get(F.get(F.get("jacobians", F.lit(i)), F.lit(0)), F.lit(0)), 9)
    found = lin.linearize(factors.filter("kind = 'between'"), values.table)
    return found.select(F.get("keys", F.lit(1)).alias("key"), F.round(F.get("b", F.lit(0)), 5).alias("b"), block(0).alias("j0"), block(1).alias("j1"))


@query(_CHAIN + " SELECT key, round(r, 5) AS residual FROM b")
def error_vector(spark, sf_dir):
    _, factors, values = _chain(spark, sf_dir)
    return lin.residuals(factors.filter("kind = 'between'"), values.table).select(F.get("keys", F.lit(1)).alias("key"), F.round(F.get("r", F.lit(0)), 5).alias("residual"))


@query(_CHAIN + " SELECT 1::BIGINT AS dim, round(sqrt(r * r / 2), 6) AS still, round(sqrt((r + 10 * 0.5 - 10 * 0.25) ** 2 / 2), 6) AS moved FROM b WHERE key = (SELECT min(key) FROM b)")
def gaussian_factor(spark, sf_dir):
    lines, factors, values = _chain(spark, sf_dir)
    first = lines.agg(F.min("key")).first()[0]
    row = lin.linearize(factors.filter((F.col("kind") == "between") & (F.get("keys", F.lit(1)) == first)), values.table).first()
    one = lin.GaussianFactor.of(row)
    still, moved = one.error({}), one.error({first: 0.5, first - 1: 0.25})
    return _row(spark, dim=one.dim(), still=round(still**0.5, 6), moved=round(moved**0.5, 6)).withColumn("dim", F.col("dim").cast("long"))


@query("SELECT 0.8::DOUBLE AS x0, 1.4::DOUBLE AS x1, true AS singular, 5.0::DOUBLE AS norm, 11.0::DOUBLE AS dot, 5.5::DOUBLE AS shifted, 7.0::DOUBLE AS product, 2.0::DOUBLE AS turned")
def dense_kernels(spark, sf_dir):
    x = dense.solve([[2, 1], [1, 3]], [3, 5])
    a = [[1, 2], [3, 4]]
    values = {"x0": round(float(x[0]), 9), "x1": round(float(x[1]), 9), "singular": dense.try_solve(dense.matmul([[1], [1]], [[1, 1]]), dense.add_diagonal([[0.0, 0], [0, 0]], 1.0)[0]) is None, "norm": dense.norm([3, 4]), "dot": dense.dot([1, 2], [3, 4])}
    return _row(spark, **values, shifted=float(dense.add_diagonal(a, 1.5)[1][1]), product=float(dense.matmul(a, a)[0][0]), turned=float(dense.transpose(a)[1][0]))


@query(_CHAIN + " SELECT row_number() OVER (ORDER BY key) - 1 AS index, round(x, 6) AS x FROM y")
def adapter_params(spark, sf_dir):
    _, factors, values = _chain(spark, sf_dir)
    a = adapter.FactorGraphAdapter(FactorGraph(factors), values)
    back = a.params_to_values(a.values_to_params(values))
    return a.values_to_params(back).select("index", F.round("x", 6).alias("x"))


@query(_CHAIN + ", o AS (SELECT key, row_number() OVER (ORDER BY key) - 1 AS index FROM y) SELECT b.key, o.index, CASE WHEN o.key = b.key THEN 10.0 ELSE -10.0 END::DOUBLE AS value, round(r, 5) AS residual FROM b JOIN o ON o.key IN (b.key, b.key - 1)")
def adapter_jacobian(spark, sf_dir):
    _, factors, values = _chain(spark, sf_dir)
    between = factors.filter("kind = 'between'")
    a = adapter.FactorGraphAdapter(FactorGraph(between), values)
    named = between.select("fid", F.get("keys", F.lit(1)).alias("key"))
    met = a.jacobian(values).join(a.residual(values), ["fid", "row"]).join(named, "fid")
    return met.select("key", "index", F.round("value", 9).alias("value"), F.round("r", 5).alias("residual"))


@query(_CHAIN + ", p AS (SELECT key - 1 AS key, 0.25 / 0.1 AS r FROM x WHERE k = 1), g AS (SELECT key, r / 0.1 AS g FROM b UNION ALL SELECT key - 1, -r / 0.1 FROM b UNION ALL SELECT key, r / 0.1 FROM p), t AS (SELECT sum(r * r) / 2 AS total FROM (SELECT r FROM b UNION ALL SELECT r FROM p)) SELECT index, round(g, 3) AS g, round((SELECT total FROM t) / 1e6, 3) AS total FROM (SELECT row_number() OVER (ORDER BY key) - 1 AS index, g FROM (SELECT key, sum(g) AS g FROM g GROUP BY key))")
def objective(spark, sf_dir):
    _, factors, values = _chain(spark, sf_dir)
    f = adapter.FactorGraphObjective(FactorGraph(factors), values)
    total, slope = f.evaluate_with_gradient(f.adapter.values_to_params(values))
    return slope.select("index", F.round("g", 3).alias("g"), F.round(F.lit(total / 1e6), 3).alias("total"))


def _priors(spark, sf_dir):
    """Each line's quantity as the prior of a scalar that starts at 1."""
    lines, _ = graphs.line_chains(spark, sf_dir)
    measured = F.struct(F.lit(0.0).alias("theta"), F.col("l_quantity").cast("double").alias("x"), F.lit(0.0).alias("y"))
    factors = lines.select(F.col("key").alias("fid"), F.lit("prior").alias("kind"), F.array("key").alias("keys"), measured.alias("meas"), F.array(F.lit(0.1)).alias("sigma"), F.lit(None).cast("struct<name:string,k:double>").alias("loss"))
    return FactorGraph(factors), Values(lines.select("key", F.lit("scalar").alias("kind"), F.array(F.lit(1.0)).alias("v")))


@query(f"WITH {LINES} SELECT key, round(l_quantity + (1 - l_quantity) / 32, 6) AS x FROM lines")
def gradient_descent(spark, sf_dir):
    """Each of five steps halves the way to the prior."""
    done = optimize.GradientDescentOptimizer(max_iterations=5, step_size=0.005).optimize(*_priors(spark, sf_dir))
    return done.values.table.select("key", F.round(F.get("v", F.lit(0)), 6).alias("x"))


@query(f"WITH {LINES} SELECT key, round(1 - 0.01::DOUBLE * sign(1 - l_quantity), 6) AS x FROM lines")
def adam(spark, sf_dir):
    """The first step has the length of the rate, whatever the slope."""
    done = optimize.GradientDescentOptimizer(max_iterations=1, step_size=0.01, use_adaptive_lr=True).optimize(*_priors(spark, sf_dir))
    return done.values.table.select("key", F.round(F.get("v", F.lit(0)), 6).alias("x"))

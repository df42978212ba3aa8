"""Mixed directed and undirected multigraphs as a pair of DataFrames.

``vertices(id, properties...)`` and ``edges(eid, src, dst, weight, directed, properties...)``. A graph is
immutable: every change returns a new one, and nothing is computed until an action asks for it.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkweft.storage import materialise

EDGE_COLUMNS = ("eid", "src", "dst", "weight", "directed")


def number_rows(df: DataFrame, order: Iterable[Column | str], name: str, start: int = 0) -> DataFrame:
    """Add dense numbers in the given order without bringing the rows together.

    The rows are range-sorted, a partition's rows count from the sum of those before it, and only one
    count for each partition is gathered. Ties in ``order`` are numbered in any order.
    """
    placed = materialise(df.orderBy(*order).withColumn("__at", F.monotonically_increasing_id()), "numbered")
    part, row = F.shiftright("__at", 33), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = sorted((r["p"], r["n"]) for r in placed.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())
    offset, offsets = start, []
    for p, n in sizes:
        offsets.append((p, offset))
        offset += n
    # A row for each partition.
    before = F.broadcast(df.sparkSession.createDataFrame(offsets, "__part long, __before long"))
    return placed.join(before, part == F.col("__part")).withColumn(name, F.col("__before") + row).drop("__at", "__part", "__before")


class Graph:
    """A graph over Spark tables. ``adjacency`` lists each undirected edge from both ends."""

    def __init__(self, vertices: DataFrame, edges: DataFrame):
        if "id" not in vertices.columns or not {"src", "dst"} <= set(edges.columns):
            raise ValueError("vertices need the column id, edges need src and dst")
        if "eid" not in edges.columns:
            edges = number_rows(edges, ["src", "dst"], "eid")
        if "weight" not in edges.columns:
            edges = edges.withColumn("weight", F.lit(1.0))
        if "directed" not in edges.columns:
            edges = edges.withColumn("directed", F.lit(False))
        more = [c for c in edges.columns if c not in EDGE_COLUMNS]
        self.vertices = vertices.withColumn("id", F.col("id").cast("long"))
        self.edges = edges.select(*[F.col(c).cast("long").alias(c) for c in ("eid", "src", "dst")], F.coalesce(F.col("weight").cast("double"), F.lit(1.0)).alias("weight"), F.coalesce(F.col("directed"), F.lit(False)).alias("directed"), *more)

    # -- construction

    @classmethod
    def empty(cls, spark: SparkSession) -> Graph:
        return cls(spark.createDataFrame([], "id long"), spark.createDataFrame([], "eid long, src long, dst long, weight double, directed boolean"))

    @classmethod
    def from_edges(cls, edges: DataFrame, src: str = "src", dst: str = "dst", weight: str | None = None, directed: bool | str = False, vertices: DataFrame | None = None) -> Graph:
        """A graph from any edge table; without ``vertices`` the endpoints are the vertices."""
        rows = edges.select(*([F.col("eid")] if "eid" in edges.columns else []), F.col(src).alias("src"), F.col(dst).alias("dst"), (F.col(weight) if weight else F.lit(1.0)).alias("weight"), (F.col(directed) if isinstance(directed, str) else F.lit(directed)).alias("directed"))
        if vertices is None:
            vertices = rows.select(F.col("src").alias("id")).union(rows.select("dst")).distinct()
        return cls(vertices, rows)

    @classmethod
    def local(cls, spark: SparkSession, n: int, edges: Iterable[tuple], properties: Mapping[str, Iterable] | None = None) -> Graph:
        """A small graph for tests: vertices 0..n-1 and (src, dst[, weight[, directed]]) tuples in order."""
        rows = [(k, e[0], e[1], float(e[2]) if len(e) > 2 else 1.0, bool(e[3]) if len(e) > 3 else False) for k, e in enumerate(edges)]
        names = list(properties or {})
        values = list(zip(range(n), *(properties or {}).values())) if names else [(i,) for i in range(n)]
        vertices = spark.createDataFrame(values, ["id", *names]) if values else spark.createDataFrame([], "id long")
        return cls(vertices, spark.createDataFrame(rows, "eid long, src long, dst long, weight double, directed boolean"))

    @property
    def spark(self) -> SparkSession:
        return self.vertices.sparkSession

    def cached(self) -> Graph:
        """The same graph with both tables written to the shared folder, so its plan starts anew."""
        return Graph(materialise(self.vertices, "vertices"), materialise(self.edges, "edges"))

    # -- reading

    @property
    def adjacency(self) -> DataFrame:
        """(eid, src, dst, weight, directed): an undirected edge from both ends, a self-loop of it twice."""
        e = self.edges.select(*EDGE_COLUMNS)
        return e.union(e.filter(~F.col("directed")).select("eid", F.col("dst").alias("src"), F.col("src").alias("dst"), "weight", "directed"))

    @property
    def symmetric(self) -> DataFrame:
        """(eid, src, dst, weight): every edge from both ends whatever its direction."""
        e = self.edges.select("eid", "src", "dst", "weight")
        return e.union(e.select("eid", F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))

    def vertex_count(self) -> int:
        return self.vertices.count()

    def edge_count(self) -> int:
        return self.edges.count()

    def counts(self) -> DataFrame:
        """One row (n_vertices, n_edges)."""
        v = self.vertices.select(F.lit(1).alias("v"), F.lit(0).alias("e"))
        return v.union(self.edges.select(F.lit(0), F.lit(1))).agg(F.coalesce(F.sum("v"), F.lit(0)).alias("n_vertices"), F.coalesce(F.sum("e"), F.lit(0)).alias("n_edges"))

    def has_vertex(self, v: int) -> bool:
        return not self.vertices.filter(F.col("id") == v).isEmpty()

    def has_edge(self, u: int, v: int) -> bool:
        return not self.adjacency.filter((F.col("src") == u) & (F.col("dst") == v)).isEmpty()

    def has_edges(self, pairs: DataFrame) -> DataFrame:
        """(u, v) -> (u, v, present), for many pairs at once."""
        known = self.adjacency.select(F.col("src").alias("u"), F.col("dst").alias("v")).distinct().withColumn("present", F.lit(True))
        return pairs.select("u", "v").join(known, ["u", "v"], "left").withColumn("present", F.coalesce("present", F.lit(False)))

    def _edge(self, e: int):
        row = self.edges.filter(F.col("eid") == e).first()
        if row is None:
            raise ValueError(f"no edge {e}")
        return row

    def get_weight(self, e: int) -> float:
        return self._edge(e)["weight"]

    def get_edge_type(self, e: int) -> str:
        return "directed" if self._edge(e)["directed"] else "undirected"

    def source(self, e: int) -> int:
        r = self._edge(e)
        return r["src"] if r["directed"] else min(r["src"], r["dst"])

    def target(self, e: int) -> int:
        r = self._edge(e)
        return r["dst"] if r["directed"] else max(r["src"], r["dst"])

    def endpoints(self) -> DataFrame:
        """(eid, source, target) of all edges; an undirected edge starts at its smaller end."""
        pick = lambda f, c: F.when(F.col("directed"), F.col(c)).otherwise(f("src", "dst"))
        return self.edges.select("eid", pick(F.least, "src").alias("source"), pick(F.greatest, "dst").alias("target"))

    def get_edge(self, u: int, v: int) -> int | None:
        """The edge inserted first from u to v, or None."""
        return self.adjacency.filter((F.col("src") == u) & (F.col("dst") == v)).agg(F.min("eid")).first()[0]

    def edge(self, u: int, v: int) -> tuple[int, bool]:
        e = self.get_edge(u, v)
        return (0, False) if e is None else (e, True)

    def first_edges(self) -> DataFrame:
        """(src, dst, eid): the first edge of every pair that has one."""
        return self.adjacency.groupBy("src", "dst").agg(F.min("eid").alias("eid"))

    def out_edges(self, v: int) -> DataFrame:
        return self.adjacency.filter(F.col("src") == v).select("eid").orderBy("eid")

    def neighbors(self, v: int) -> DataFrame:
        """The targets in insertion order; parallel edges repeat them."""
        return self.adjacency.filter(F.col("src") == v).orderBy("eid").select(F.col("dst").alias("id"))

    def neighbor_lists(self) -> DataFrame:
        """(id, neighbors) of every vertex that has some, in insertion order."""
        pairs = self.adjacency.groupBy("src").agg(F.sort_array(F.collect_list(F.struct("eid", "dst"))).alias("n"))
        return pairs.select(F.col("src").alias("id"), F.col("n.dst").alias("neighbors"))

    def degrees(self) -> DataFrame:
        """(id, degree) of every vertex: the length of its adjacency list."""
        n = self.adjacency.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))
        return self.vertices.select("id").join(n, "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))

    def degree(self, v: int) -> int:
        return self.adjacency.filter(F.col("src") == v).count()

    def vertex_ids(self) -> DataFrame:
        return self.vertices.select("id").orderBy("id")

    def get_property(self, v: int, name: str):
        row = self.vertices.filter(F.col("id") == v).select(name).first()
        if row is None:
            raise ValueError(f"no vertex {v}")
        return row[0]

    # -- changing

    def _next(self, df: DataFrame, column: str) -> int:
        top = df.agg(F.max(column)).first()[0]
        return 0 if top is None else top + 1

    def add_vertex(self, **properties) -> tuple[Graph, int]:
        v = self._next(self.vertices, "id")
        new = self.spark.createDataFrame([(v,)], "id long").select("id", *[F.lit(x).alias(k) for k, x in properties.items()])
        return Graph(self.vertices.unionByName(new, allowMissingColumns=True), self.edges), v

    def add_vertices(self, vertices: DataFrame) -> Graph:
        """Vertices from a table; without ids they get the next ones."""
        if "id" not in vertices.columns:
            vertices = number_rows(vertices, vertices.columns, "id", self._next(self.vertices, "id"))
        return Graph(self.vertices.unionByName(vertices, allowMissingColumns=True), self.edges)

    def add_edge(self, u: int, v: int, weight: float = 1.0, directed: bool = False) -> tuple[Graph, int]:
        e = self._next(self.edges, "eid")
        row = self.spark.createDataFrame([(e, u, v, float(weight), directed)], "eid long, src long, dst long, weight double, directed boolean")
        return self.add_edges(row), e

    def add_edges(self, edges: DataFrame) -> Graph:
        """Edges from a table; an endpoint that isn't a vertex is an error."""
        if "eid" not in edges.columns:
            edges = number_rows(edges, ["src", "dst"], "eid", self._next(self.edges, "eid"))
        new = Graph(self.vertices, edges).edges
        ends = new.select(F.col("src").alias("id")).union(new.select("dst"))
        lost = ends.join(self.vertices, "id", "left_anti").first()
        if lost is not None:
            raise ValueError(f"no vertex {lost[0]}")
        return Graph(self.vertices, self.edges.unionByName(new, allowMissingColumns=True))

    def set_weight(self, e: int, weight: float) -> Graph:
        self._edge(e)
        return self.set_weights(F.col("eid") == e, F.lit(float(weight)))

    def set_weights(self, where: Column, weight: Column) -> Graph:
        return Graph(self.vertices, self.edges.withColumn("weight", F.when(where, weight).otherwise(F.col("weight"))))

    def set_property(self, v: int, name: str, value) -> Graph:
        old = F.col(name) if name in self.vertices.columns else F.lit(None)
        return Graph(self.vertices.withColumn(name, F.when(F.col("id") == v, F.lit(value)).otherwise(old)), self.edges)

    def remove_edge(self, e: int, v: int | None = None) -> Graph:
        """The edge ``e``, or with two vertices the first edge from the one to the other; none is no error."""
        if v is not None:
            e = self.get_edge(e, v)
        return self if e is None else Graph(self.vertices, self.edges.filter(F.col("eid") != e))

    def remove_edges(self, ids: DataFrame) -> Graph:
        return Graph(self.vertices, self.edges.join(ids.select("eid"), "eid", "left_anti"))

    def remove_vertex(self, v: int) -> Graph:
        """The vertex and every edge that touches it."""
        return Graph(self.vertices.filter(F.col("id") != v), self.edges.filter((F.col("src") != v) & (F.col("dst") != v)))

    def remove_vertices(self, ids: DataFrame) -> Graph:
        gone = ids.select("id")
        edges = self.edges.join(gone.select(F.col("id").alias("src")), "src", "left_anti").join(gone.select(F.col("id").alias("dst")), "dst", "left_anti")
        return Graph(self.vertices.join(gone, "id", "left_anti"), edges)

    def clear(self) -> Graph:
        return Graph(self.vertices.limit(0), self.edges.limit(0))

    def copy(self) -> Graph:
        """Tables don't change, so a copy is another reference."""
        return Graph(self.vertices, self.edges)

    # -- attributes by name

    def with_vertex_property(self, name: str, values: DataFrame) -> Graph:
        """Attach a (id, value) table as a column; vertices without a value get null."""
        return Graph(self.vertices.drop(name).join(values.select("id", F.col("value").alias(name)), "id", "left"), self.edges)

    def with_edge_property(self, name: str, values: DataFrame) -> Graph:
        return Graph(self.vertices, self.edges.drop(name).join(values.select("eid", F.col("value").alias(name)), "eid", "left"))

    # -- kinds

    def edge_kinds(self) -> tuple[bool, bool]:
        """Whether there are directed edges, and undirected ones; one small job."""
        r = self.edges.agg(F.coalesce(F.max("directed"), F.lit(False)), F.coalesce(F.max(~F.col("directed")), F.lit(False))).first()
        return r[0], r[1]


# Free functions over a graph.


def num_vertices(g: Graph) -> int:
    return g.vertex_count()


def num_edges(g: Graph) -> int:
    return g.edge_count()


def add_vertex(g: Graph, **properties) -> tuple[Graph, int]:
    return g.add_vertex(**properties)


def add_edge(u: int, v: int, g: Graph, weight: float = 1.0, directed: bool = False) -> tuple[Graph, int]:
    return g.add_edge(u, v, weight, directed)


def degree(v: int, g: Graph) -> int:
    return g.degree(v)


def neighbors(v: int, g: Graph) -> DataFrame:
    return g.neighbors(v)


def vertices(g: Graph) -> DataFrame:
    return g.vertex_ids()


def edges(g: Graph) -> DataFrame:
    return g.edges


def clear_graph(g: Graph) -> Graph:
    return g.clear()


def remove_vertex(v: int, g: Graph) -> Graph:
    return g.remove_vertex(v)


def remove_edge(e: int, g: Graph) -> Graph:
    return g.remove_edge(e)


def get_edge(u: int, v: int, g: Graph) -> int | None:
    return g.get_edge(u, v)


def edge(u: int, v: int, g: Graph) -> tuple[int, bool]:
    return g.edge(u, v)


def source(e: int, g: Graph) -> int:
    return g.source(e)


def target(e: int, g: Graph) -> int:
    return g.target(e)

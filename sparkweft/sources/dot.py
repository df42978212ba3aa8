"""Graphs as DOT text, and edge tables of any format Spark reads."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkweft.graph import Graph, number_rows
from sparkweft.storage import materialise

NUMBER = r"[-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?"


def _escaped(label: Column) -> Column:
    return F.replace(F.replace(label, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))


def dot_lines(g: Graph, label: Column | str | None = None) -> DataFrame:
    """(part, number, line): header, vertices, edges and footer in the order of (part, number).

    ``label`` is an expression over the vertex columns. One directed edge makes the whole a digraph, in which
    undirected edges are marked.
    """
    mixed = g.edges.agg(F.coalesce(F.max("directed"), F.lit(False)).alias("any"))  # one row
    edges = g.edges.crossJoin(F.broadcast(mixed))
    label = F.expr(label) if isinstance(label, str) else label
    name = lambda c: F.concat(F.lit("v"), F.col(c).cast("string"))
    tail = F.lit("") if label is None else F.concat(F.lit(' [label="'), _escaped(F.coalesce(label.cast("string"), F.lit(""))), F.lit('"]'))
    head = mixed.select(F.lit(0).alias("part"), F.lit(0).cast("long").alias("number"), F.when(F.col("any"), "digraph G {").otherwise("graph G {").alias("line"))
    vertices = g.vertices.select(F.lit(1), F.col("id"), F.concat(F.lit("  "), name("id"), tail, F.lit(";")))
    arrow = F.when(F.col("any"), " -> ").otherwise(" -- ")
    mark = F.when(F.col("any") & ~F.col("directed"), ",dir=none").otherwise("")
    lines = edges.select(F.lit(2), "eid", F.concat(F.lit("  "), name("src"), arrow, name("dst"), F.lit(" [weight="), F.col("weight").cast("string"), mark, F.lit("];")))
    foot = mixed.select(F.lit(3), F.lit(0).cast("long"), F.lit("}"))
    return head.union(vertices).union(lines).union(foot)


def write_dot(g: Graph, path: str, label: Column | str | None = None, files: int = 1) -> None:
    """A folder of text files whose names' order is that of the text; by default of a single one."""
    rows = dot_lines(g, label)
    rows = rows.coalesce(1).sortWithinPartitions("part", "number") if files == 1 else rows.repartitionByRange(files, "part", "number").sortWithinPartitions("part", "number")
    rows.select("line").write.text(path)


def read_dot(spark: SparkSession, path: str, labels: bool | Callable[[Column], Column] = False) -> Graph:
    """Read DOT text. Vertices get ids 0.. in the order they are first seen; edges may come without brackets.

    With ``labels`` vertices get a ``label`` column, made of the text by ``labels`` if that is a function, and an edge to an undeclared vertex is an error; without,
    edges make their vertices. A comment runs from ``//`` to the line's end, but not within quotes.
    """
    # A split's start orders the parts of a file, and rows are numbered within it.
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("m"))
    placed = number_rows(raw, ["f", "b", "m"], "at")
    line = F.trim(F.regexp_replace("value", r'^((?:[^"/]|"(?:[^"\\]|\\.)*"|/(?!/))*)//.*$', "$1"))
    edge = r'^v(\d+)\s*(--|->)\s*v(\d+)\s*(?:\[(.*)\])?\s*;?$'
    vertex = r'^v(\d+)\s*(?:\[(.*)\])?\s*;?$'
    rows = placed.select("at", line.alias("line")).filter(~F.col("line").rlike(r"^(strict\s+)?(di)?graph\b.*\{$|^\}?$"))
    rows = materialise(
        rows.select(
            "at",
            F.when(F.col("line").rlike(edge), F.struct(F.regexp_extract("line", edge, 1).cast("long").alias("u"), F.regexp_extract("line", edge, 2).alias("op"), F.regexp_extract("line", edge, 3).cast("long").alias("v"), F.regexp_extract("line", edge, 4).alias("more"))).alias("e"),
            F.when(F.col("line").rlike(vertex), F.struct(F.regexp_extract("line", vertex, 1).cast("long").alias("v"), F.regexp_extract("line", vertex, 2).alias("more"))).alias("n"),
        ).filter("e IS NOT NULL OR n IS NOT NULL"),
        "dot",
    )
    found = F.regexp_extract("n.more", r'label\s*=\s*"((?:[^"\\]|\\.)*)"', 1)
    declared = rows.filter("n IS NOT NULL").select(F.col("n.v").alias("name"), (F.col("at") * 2).alias("at"), F.regexp_replace(found, r"\\(.)", "$1").alias("label"))
    edges = rows.filter("e IS NOT NULL").select("at", "e.*")
    ends = edges.select(F.col("u").alias("name"), (F.col("at") * 2).alias("at")).union(edges.select("v", F.col("at") * 2 + 1))
    if labels and (lost := ends.join(declared, "name", "left_anti").first()) is not None:
        raise ValueError(f"an edge names the undeclared vertex v{lost['name']}")
    seen = declared.union(ends.select("name", "at", F.lit(None).cast("string"))).groupBy("name").agg(F.min("at").alias("at"), F.min_by("label", F.when(F.col("label").isNotNull(), F.col("at"))).alias("label"))
    ids = number_rows(seen, ["at"], "id")
    of = lambda end: ids.select(F.col("name").alias(end), F.col("id").alias(f"id_{end}"))
    weight = F.regexp_extract("more", rf"weight\s*=\s*\"?({NUMBER})", 1)
    directed = (F.col("op") == "->") & ~F.col("more").rlike(r"dir\s*=\s*\"?none")
    table = edges.join(of("u"), "u").join(of("v"), "v").select("at", F.col("id_u").alias("src"), F.col("id_v").alias("dst"), F.when(weight != "", weight.cast("double")).otherwise(1.0).alias("weight"), directed.alias("directed"))
    label = [labels(F.col("label")).alias("label")] if callable(labels) else [F.col("label")] * labels
    return Graph(ids.select("id", *label), number_rows(table, ["at"], "eid").drop("at"))


def read_edges(spark: SparkSession, path: str, format: str = "parquet", src: str = "src", dst: str = "dst", weight: str | None = None, directed: bool | str = False, **options) -> Graph:
    """A graph from an edge table in any format that Spark reads."""
    return Graph.from_edges(spark.read.options(**options).format(format).load(path), src, dst, weight, directed)

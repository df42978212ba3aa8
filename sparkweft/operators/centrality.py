"""Centrality of vertices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkweft.graph import Graph
from sparkweft.plans.rounds import cut

from .traversal import multi_source_bfs


def degree_centrality_all(g: Graph) -> DataFrame:
    """(id, score): without directed edges degree / 2(n-1), else (directed in + adjacent out) / (n-1); one plan."""
    out = g.adjacency.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n_out"), F.lit(0).cast("long").alias("n_in"))
    into = g.edges.filter("directed").groupBy(F.col("dst").alias("id")).agg(F.lit(0).cast("long").alias("n_out"), F.count("*").alias("n_in"))
    none = g.vertices.select("id", F.lit(0).cast("long").alias("n_out"), F.lit(0).cast("long").alias("n_in"))
    per = none.union(out).union(into).groupBy("id").agg(F.sum("n_out").alias("n_out"), F.sum("n_in").alias("n_in"))
    n = g.vertex_count()
    directed, _ = g.edge_kinds()
    if n <= 1:
        return per.select("id", F.lit(0.0).alias("score"))
    score = (F.col("n_out") + F.col("n_in")) / F.lit(float(n - 1)) if directed else F.col("n_out") / F.lit(2.0 * (n - 1))
    return per.select("id", score.alias("score"))


def _one(scores: DataFrame, v: int) -> float:
    row = scores.filter(F.col("id") == v).first()
    if row is None:
        raise ValueError(f"no vertex {v}")
    return row["score"]


def degree_centrality(g: Graph, v: int) -> float:
    return _one(degree_centrality_all(g), v)


def _closeness(g: Graph, sources: DataFrame) -> DataFrame:
    n = g.vertex_count()
    reach = multi_source_bfs(g, sources).groupBy("source").agg(F.count("*").alias("reached"), F.sum("distance").alias("total"))
    score = F.when((F.col("reached") == n) & (F.col("total") > 0), (n - 1) / F.col("total")).otherwise(0.0)
    return reach.select(F.col("source").alias("id"), score.alias("score"))


#: Sources that are searched at a time.
BATCH = 1024


def closeness_centrality_all(g: Graph, batch: int = BATCH) -> DataFrame:
    """(id, score): (n-1) over the sum of hops, 0 unless all are reached.

    The state is a row for each vertex and each of about ``batch`` sources that are searched at a time.
    """
    return _batches(g, batch, lambda s: _closeness(g, s))


def _batches(g: Graph, batch: int, part) -> DataFrame:
    ids = g.vertices.select("id")
    n = max(1, -(-g.vertex_count() // batch))
    out = None
    for k in range(n):
        scores = cut(part(ids.filter(F.pmod(F.xxhash64("id"), F.lit(n)) == k)))
        out = scores if out is None else out.union(scores)
    return out


def closeness_centrality(g: Graph, v: int) -> float:
    return _one(_closeness(g, g.vertices.filter(F.col("id") == v).select("id")), v)


def betweenness_by_source(g: Graph, sources: DataFrame) -> DataFrame:
    """(source, id, delta): each source's dependencies on the vertices behind it.

    Forward the shortest paths are counted level by level, parallel edges as paths of their own; backward each
    vertex hands its dependency to those before it in proportion.
    """
    adj = cut(g.adjacency.select("src", "dst"), "adjacency")
    level = cut(sources.select(F.col("id").alias("source"), "id", F.lit(1.0).alias("sigma")))
    seen, levels = level.select("source", "id"), [level]
    while True:
        met = level.select("source", F.col("id").alias("src"), "sigma").join(adj, "src").join(seen.select("source", F.col("id").alias("dst")), ["source", "dst"], "left_anti")
        level = cut(met.groupBy("source", F.col("dst").alias("id")).agg(F.sum("sigma").alias("sigma")))
        if level.isEmpty():
            break
        levels.append(level)
        seen = cut(seen.union(level.select("source", "id")))
    after = cut(levels[-1].withColumn("delta", F.lit(0.0)))
    done = after.select("source", "id", "delta")
    for level in reversed(levels[:-1]):
        share = after.select("source", F.col("id").alias("dst"), F.col("sigma").alias("s_w"), "delta")
        steps = level.select("source", F.col("id").alias("src"), F.col("sigma").alias("s_v")).join(adj, "src").join(share, ["source", "dst"])
        given = steps.groupBy("source", F.col("src").alias("id")).agg(F.sum(F.col("s_v") / F.col("s_w") * (1 + F.col("delta"))).alias("delta"))
        after = cut(level.join(given, ["source", "id"], "left").withColumn("delta", F.coalesce("delta", F.lit(0.0))))
        done = done.union(after.select("source", "id", "delta"))
    return done


def betweenness_single_source(g: Graph, source: int) -> DataFrame:
    return betweenness_by_source(g, g.vertices.filter(F.col("id") == source).select("id")).select("id", F.col("delta").alias("score"))


def betweenness_centrality(g: Graph, normalized: bool = False, batch: int = BATCH) -> DataFrame:
    """(id, score); halved where no edge is directed, and ``normalized`` by (n-1)(n-2) if n > 2."""
    deltas = _batches(g, batch, lambda s: betweenness_by_source(g, s).filter("id <> source").groupBy("id").agg(F.sum("delta").alias("delta")))
    total = deltas.groupBy("id").agg(F.sum("delta").alias("delta"))
    scale = 1.0 if g.edge_kinds()[0] else 0.5
    n = g.vertex_count()
    if normalized and n > 2:
        scale /= (n - 1) * (n - 2)
    return g.vertices.select("id").join(total, "id", "left").select("id", (F.coalesce("delta", F.lit(0.0)) * scale).alias("score"))


def betweenness_centrality_normalized(g: Graph) -> DataFrame:
    return betweenness_centrality(g, normalized=True)


def top_k_central_vertices(scores: DataFrame, k: int) -> DataFrame:
    """The k highest (id, score); of equal scores the smaller ids."""
    return scores.orderBy(F.col("score").desc(), "id").limit(k)


def most_central_vertex(scores: DataFrame) -> int:
    v = scores.agg(F.max_by("id", F.struct("score", -F.col("id")))).first()[0]
    if v is None:
        raise ValueError("there are no scores")
    return v


def pagerank(g: Graph, damping: float = 0.85, rounds: int = 20) -> DataFrame:
    """(id, score) by power iteration; what has no way out spreads evenly. An extra."""
    n = g.vertex_count()
    out = g.adjacency.groupBy("src").agg(F.count("*").alias("n"))
    adj = cut(g.adjacency.select("src", "dst").join(out, "src"), "adjacency")
    rank = cut(g.vertices.select("id", F.lit(1.0 / max(n, 1)).alias("score")))
    for _ in range(rounds):
        given = rank.withColumnRenamed("id", "src").join(adj, "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("score") / F.col("n")).alias("got"))
        lost = 1.0 - (given.agg(F.sum("got")).first()[0] or 0.0)
        rank = cut(rank.select("id").join(given, "id", "left").select("id", ((1 - damping + damping * lost) / n + damping * F.coalesce("got", F.lit(0.0))).alias("score")))
    return rank

"""Edges that arrive as a stream. Extras: nothing else in the library needs them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkweft.operators.stars import star_components


def running_degrees(edges: DataFrame) -> DataFrame:
    """Stream of (src, dst) -> running (id, degree), for update or complete mode; one stateful aggregation."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id"))
    return ends.groupBy("id").agg(F.count("*").alias("degree"))


def windowed_counts(edges: DataFrame, time: str, length: str, slide: str | None = None, late: str = "1 hour", by: str = "src") -> DataFrame:
    """Edges for each vertex in tumbling or sliding windows; what comes later than ``late`` is left out."""
    window = F.window(time, length, slide) if slide else F.window(time, length)
    return edges.withWatermark(time, late).groupBy(window.alias("window"), by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), F.col(by).alias("id"), "n")


def session_counts(edges: DataFrame, time: str, gap: str, late: str = "1 hour", by: str = "src") -> DataFrame:
    """Edges for each vertex in sessions that ``gap`` without an edge ends."""
    return edges.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("window"), by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), F.col(by).alias("id"), "n")


class IncrementalComponents:
    """Components of all edges so far, merged batch by batch: for ``foreachBatch``.

    Only the new edges between different roots are contracted; a table of (node, root) is written a batch to a
    path of its own, so a batch that is run again after a failure overwrites what it had written.
    """

    def __init__(self, folder: str):
        self.folder = folder
        self.done: dict[int, str] = {}

    @property
    def path(self) -> str | None:
        """The newest table."""
        return self.done[max(self.done)] if self.done else None

    def __call__(self, batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        pairs = batch.select(F.col("src").alias("u"), F.col("dst").alias("v"))
        before = [n for n in self.done if n < number]
        known = spark.read.parquet(self.done[max(before)]) if before else spark.createDataFrame([], "node long, root long")
        tag = lambda end: known.select(F.col("node").alias(end), F.col("root").alias(f"r_{end}"))
        met = pairs.join(tag("u"), "u", "left").join(tag("v"), "v", "left").select(F.coalesce("r_u", "u").alias("u"), F.coalesce("r_v", "v").alias("v"))
        moved = star_components(met).select(F.col("node").alias("root"), F.col("root").alias("to"))
        nodes = known.union(pairs.select("u", "u").union(pairs.select("v", "v")).distinct().join(known.select(F.col("node").alias("u")), "u", "left_anti"))
        path = f"{self.folder}/components-{number:09d}"
        nodes.join(moved, "root", "left").select("node", F.coalesce("to", "root").alias("root")).write.mode("overwrite").parquet(path)
        self.done = {n: self.done[n] for n in before} | {number: path}

"""Rounds of a fixpoint: each is written to the shared folder, so no plan grows with their number."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkweft.storage import materialise


def cut(df: DataFrame, name: str = "round") -> DataFrame:
    return materialise(df, name)


def dealt_distinct(df: DataFrame, by: str) -> DataFrame:
    """The distinct rows, dealt out by a column first.

    Where rows hardly repeat, sums made before a shuffle save nothing and hold as many rows as a task reads; what a
    task reads of a shuffle is bounded.
    """
    return df.repartition(by).distinct()


def on_cycles(parents: DataFrame, n: int) -> DataFrame:
    """(id, parent) with one parent a row -> the rows whose id lies on a cycle of parents.

    After n steps or more along the parents only cycles are reached; the steps are doubled each round.
    """
    jump = cut(parents.select("id", F.col("parent").alias("to")))
    steps = 1
    while steps < max(1, n):
        jump = cut(jump.alias("a").join(jump.alias("b"), F.col("a.to") == F.col("b.id")).select(F.col("a.id").alias("id"), F.col("b.to").alias("to")))
        steps *= 2
    return parents.join(jump.select(F.col("to").alias("id")).distinct(), "id", "left_semi")


def _walk(parents: DataFrame, start: int, stop: int | None) -> list[int]:
    """The ids from ``start`` up along (id, parent), each once, at least to ``stop`` if it is among them.

    The steps double each round, so there are as many rounds as the length has binary digits, and only
    the way itself is gathered.
    """
    jump = cut(parents.filter(F.col("parent").isNotNull()).select("id", F.col("parent").alias("to")))
    way = jump.sparkSession.createDataFrame([(start, 0)], "id long, place long")
    step, known = 1, 1
    while True:
        further = way.join(jump, "id").select(F.col("to").alias("id"), F.col("place") + step)
        way = cut(way.union(further).groupBy("id").agg(F.min("place").alias("place")), "way")
        n = way.count()
        if n == known or (stop is not None and not way.filter(F.col("id") == stop).isEmpty()):
            return [r["id"] for r in sorted(way.collect(), key=lambda r: r["place"])]
        jump = cut(jump.alias("a").join(jump.alias("b"), F.col("a.to") == F.col("b.id")).select(F.col("a.id").alias("id"), F.col("b.to").alias("to")))
        step, known = 2 * step, n


def one_cycle(parents: DataFrame, n: int) -> list[int]:
    """A closed walk (first == last) in the direction parent -> child on the cycle of the least id, or []."""
    rows = cut(on_cycles(parents, n), "cycles")
    start = rows.agg(F.min("id")).first()[0]
    if start is None:
        return []
    walk = _walk(rows, start, None)
    return [start, *reversed(walk[1:]), start]


def chain(parents: DataFrame, start: int, stop: int | None = None) -> list[int]:
    """The ids from ``start`` up along (id, parent) to ``stop`` or to a row without parent; [] if neither comes."""
    if start == stop:
        return [start]
    walk = _walk(parents, start, stop)
    if stop is not None:
        return walk[: walk.index(stop) + 1] if stop in walk else []
    last = parents.filter((F.col("id") == walk[-1]) & F.col("parent").isNotNull())
    return walk if last.isEmpty() else []

"""Pipeline stages: documents in, documents out, each deciding by one of the operators.

Every stage takes (spark, docs, sf_dir), keeps the columns of ``docs`` in their order whatever their
names, and works on all its input. Rows with null ids pass where an operator can't tell them apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkweft.storage import materialise

from . import decontaminate, mixing, quality, secrets, similar
from .common import table


def _plain(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The rows under names that nothing clashes with, and the plain name of each column."""
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a base rule or score below the threshold go."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    plain, name = _plain(docs)
    judged = quality.judge(plain, model, name["doc_id"], name["text"], tuple(c for c in name.values() if c != name["doc_id"]))
    return judged.filter("kept").select(*[F.col(p).alias(c) for c, p in name.items()])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that pairs of similarity 0.8 or more connect the smallest id stays; rows without an id stay."""
    groups = similar.similar(docs.select("doc_id", "text"))
    gone = materialise(groups.filter(F.col("doc_id") > F.col("component_id")).select("doc_id").distinct(), "copies")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share a window with a benchmark item go."""
    found = decontaminate.decontaminate(docs.select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    gone = materialise(found.filter("contaminated").select("doc_id", "text_hash").distinct(), "leaks")
    same = docs["doc_id"].eqNullSafe(gone["doc_id"]) & (F.xxhash64(docs["text"]) == gone["text_hash"])
    return docs.join(gone, same, "left_anti")


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the text, and n_chars follows where one was; every document stays."""
    plain, name = _plain(docs)
    scanned = secrets.scan(plain, secrets.fit(spark), id_col=name["doc_id"], text_col=name["text"], path_col=name["source"], keep=[p for c, p in name.items() if c not in ("doc_id", "text")])
    masked = F.exists("findings", lambda f: f["secret"])
    new = {"text": F.col("redacted"), "n_chars": F.when(masked, F.length("redacted").cast("long")).otherwise(F.col(name.get("n_chars", name["doc_id"])).cast("long"))}
    return scanned.select(*[new.get(c, F.col(p)).alias(c) for c, p in name.items()])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How often the mix takes each document: (doc_id, size, source_size, target, copies, taken)."""
    return mixing.mix(docs)

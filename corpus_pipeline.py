"""From raw documents to a mix: quality, near-duplicates, contamination, secrets, sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkweft.llm import stages
from sparkweft.storage import materialise

STAGES = [
    ("quality_rules", stages.quality_rules),
    ("near_dedup", stages.near_dedup),
    ("decontamination", stages.decontamination),
    ("secret_scan", stages.secret_scan),
    ("mix_sources", stages.mix_sources),
]

#: SQL expresses neither the fingerprints nor the learned stages; tests/llm holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents of ``sf_dir``; each reads what the one before has written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

"""From raw documents to training sequences: each stage's decisions hold for the next one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mailgrade.llm import stages
from mailgrade.llm.common import stored

STAGES = [
    ("language_id", stages.known_language),
    ("simhash_near_dedup", stages.one_of_each),
    ("benchmark_decontamination", stages.uncontaminated),
    ("pii_surrogates", stages.without_personal_data),
    ("best_fit_packing", stages.sequences),
]

#: Hashing, training and packing have no SQL form; tests/llm holds the brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over the documents; each writes its result before the next one reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs

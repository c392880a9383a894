"""Stages of the corpus pipeline: an operator, and what its result decides."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailgrade.llm import langid, packing, pii, simhash, winnow
from mailgrade.llm.common import text_key


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model accepts; null, empty and letterless ones go."""
    told = langid.identify(docs, docs.columns)
    return told.filter(~F.col("rejected")).select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, that with the least id; unlike texts stay, whatever their ids."""
    kept = simhash.survivors(docs).select(F.col("doc_id").alias("kept_doc"), F.col("text_key").alias("kept_key"))
    keyed = docs.withColumn("own_key", text_key(F.col("text")))
    same = F.col("doc_id").eqNullSafe(F.col("kept_doc")) & (F.col("own_key") == F.col("kept_key"))
    rows = keyed.join(kept, same, "left_semi")
    return rows.dropDuplicates(["doc_id", "own_key"]).select(*docs.columns)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of any benchmark item."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    found = winnow.hits(docs, items).select(F.col("doc_id").alias("hit_doc"), F.col("text_key").alias("hit_key"))
    same = F.col("doc_id").eqNullSafe(F.col("hit_doc")) & (text_key(F.col("text")) == F.col("hit_key"))
    return docs.join(found, same, "left_anti").select(*docs.columns)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with surrogates for personal data; n_chars follows the new text."""
    done = pii.redact(docs, keep=docs.columns)
    return done.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The remaining documents' pieces with their place in training sequences."""
    return packing.packed(docs)

"""The operators of this package applied to whole tables, as the driver calls them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailgrade.llm import codes, langid, lm, multiset, packing, pages, periods, pii, repeats, simhash, tokencount, urls, winnow
from mailgrade.llm.oracle import ORACLE  # noqa: F401

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def _table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def _register(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


@_register
def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.main_text(_table(spark, sf_dir, "pages", "page_id", "url", "html"))


@_register
def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.removed(_table(spark, sf_dir, "documents", "doc_id", "text"), texts=False).drop("kept")


@_register
def op3_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.redact(_table(spark, sf_dir, "documents", "doc_id", "text"))


@_register
def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(_table(spark, sf_dir, "documents", "doc_id", "text"), langid.remainder(F.col("doc_id"), 7) == 2)


@_register
def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(_table(spark, sf_dir, "documents", "doc_id", "text"))


@_register
def op6_multiset_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = multiset.edited_pairs(_table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select(
        "doc_id", "n_chars", "edited_sha256", multiset.as_text(F.col("lanes")).alias("fingerprint"),
        multiset.as_text(F.col("edited_lanes")).alias("edited_fingerprint"), "near_edited", "near_next",
    )


@_register
def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(_table(spark, sf_dir, "documents", "doc_id", "text"))


@_register
def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = winnow.contamination(
        _table(spark, sf_dir, "documents", "doc_id", "text"), _table(spark, sf_dir, "benchmark", "item_id", "text")
    )
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "item_ids").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


@_register
def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@_register
def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    found = langid.identify(docs, ["doc_id"])
    held = langid.remainder(F.col("doc_id"), 3) == 1
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")


#: The rules that op11's contract names.
RULES = [
    urls.Rule(urls.BLOCK, "net/"), urls.Rule(urls.ALLOW, "example.net/en/"), urls.Rule(urls.BLOCK, "example.com/de/"), urls.Rule(urls.ALLOW, "org/fr/"),
]


@_register
def op11_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(_table(spark, sf_dir, "pages", "page_id", "url"), RULES)


@_register
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.periodic_runs(_table(spark, sf_dir, "documents", "doc_id", "text"), tails=True)


@_register
def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compressed(_table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"))

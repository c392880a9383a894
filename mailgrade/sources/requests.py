"""Batches of scoring requests: one JSON document holds an array of mails."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.quality import payload_error
from ..schema import BATCH_REQUEST

# What a request as a whole may lack.
NO_EMAILS = "Request must contain an 'emails' array."
EMPTY_EMAILS = "'emails' must be a non-empty list."


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """Requests from JSON lines."""
    return spark.read.schema(BATCH_REQUEST).json(path)


def parse_requests(df: DataFrame, column: str = "value") -> DataFrame:
    """Requests from a column of JSON text."""
    return df.select(F.from_json(column, BATCH_REQUEST).alias("r")).select("r.*")


def request_error() -> Column:
    """Why a request as a whole cannot be served, or null."""
    return F.when(F.col("emails").isNull(), F.lit(NO_EMAILS)).when(
        F.size("emails") == 0, F.lit(EMPTY_EMAILS)
    )


def explode_requests(requests: DataFrame) -> DataFrame:
    """One row per mail with its ``index`` and an ``error`` text or null.

    A request without mails gives one row without an index that says what the request lacks.
    """
    whole = requests.withColumn("_whole", request_error())
    return (
        whole.select("request_id", "_whole", F.posexplode_outer("emails").alias("index", "m"))
        .select("request_id", "index", "m.*", "_whole")
        .withColumn("error", F.coalesce("_whole", payload_error()))
        .drop("_whole")
    )


def request_totals(rows: DataFrame) -> DataFrame:
    """``(request_id, total, successful, failed, request_error)`` over the mails of each request."""
    mails = F.col("index").isNotNull()
    return rows.groupBy("request_id").agg(
        F.count("index").alias("total"),
        F.count(F.when(mails & F.col("error").isNull(), 1)).alias("successful"),
        F.count(F.when(mails, F.col("error"))).alias("failed"),
        F.max(F.when(~mails, F.col("error"))).alias("request_error"),
    )

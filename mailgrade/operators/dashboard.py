"""Summaries of the result store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import LABELS
from .metrics import distribution


def total(results: DataFrame) -> DataFrame:
    return results.agg(F.count("*").alias("total"))


def priority_counts(results: DataFrame) -> DataFrame:
    """Rows per priority; unscored rows form a null group."""
    return results.groupBy("priority").agg(F.count("*").alias("n"))


def priority_counts_filled(results: DataFrame) -> DataFrame:
    """One row per known priority, 0 where there is none."""
    labels = results.sparkSession.createDataFrame([(p,) for p in LABELS], "priority string")
    return labels.join(priority_counts(results), "priority", "left").withColumn(
        "n", F.coalesce("n", F.lit(0))
    )


def priority_share(results: DataFrame) -> DataFrame:
    """Percent of all rows per priority, one decimal."""
    return distribution(results, "priority", digits=1).drop("n")


def average_confidence(results: DataFrame) -> DataFrame:
    """Mean confidence to 3 places, and as the whole percent that is shown."""
    mean = F.coalesce(F.round(F.avg("confidence"), 3), F.lit(0.0))
    return results.agg(mean.alias("avg_confidence")).withColumn(
        "avg_percent", F.round(F.col("avg_confidence") * 100).cast("int")
    )


def recent(results: DataFrame, k: int = 10) -> DataFrame:
    """The k newest results; ties go by id."""
    return results.orderBy(F.desc_nulls_last("created_at"), "id").limit(k)

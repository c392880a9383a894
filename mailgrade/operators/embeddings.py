"""Embedding block: precomputed vectors joined by mail id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import EMBEDDING_SIZE


def join_embeddings(
    mail: DataFrame, vectors: DataFrame, size: int = EMBEDDING_SIZE, key: str = "id"
) -> DataFrame:
    """Add ``embedding``; a mail without a vector gets zeros.

    ``vectors`` has ``key`` and ``embedding``. Both sides are joined on their
    unique key, so no key is heavier than another.
    """
    zeros = F.array_repeat(F.lit(0.0).cast("float"), size)
    return mail.join(vectors.select(key, "embedding"), key, "left").withColumn(
        "embedding", F.coalesce("embedding", zeros)
    )


def length(vector: Column) -> Column:
    """Euclidean length of an ``array<float>``."""
    return F.sqrt(
        F.aggregate(vector, F.lit(0.0), lambda acc, v: acc + v.cast("double") * v.cast("double"))
    )

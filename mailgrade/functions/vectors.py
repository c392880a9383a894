"""Look into ML vectors without making them dense."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parts(vector: str) -> Column:
    """``struct<size, indices, values>`` of a vector column, sparse or dense."""
    inner = F.unwrap_udt(vector)
    values = inner["values"]
    return F.struct(
        F.coalesce(inner["size"], F.size(values)).alias("size"),
        F.coalesce(
            inner["indices"],
            F.when(F.size(values) > 0, F.sequence(F.lit(0), F.size(values) - 1)),
            F.expr("CAST(array() AS array<int>)"),
        ).alias("indices"),
        values.alias("values"),
    )

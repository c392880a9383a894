"""Small vectors of class shares as ``array<double>``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import LABELS
from .matching import let

# Share vectors in label order.
UNREADABLE = (0.05, 0.15, 0.70, 0.10)
JUNK = (0.02, 0.03, 0.05, 0.90)
PLANNING = (0.02, 0.10, 0.78, 0.10)


def shares(values: Sequence[float]) -> Column:
    return F.array(*(F.lit(float(v)) for v in values))


def normalise(vector: Column) -> Column:
    def over_sum(v: Column) -> Column:
        total = F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)
        return let(total, lambda t: F.transform(v, lambda x: x / t))

    return let(vector, over_sum)


def blend(first: Column, weight_first: float, second: Column, weight_second: float) -> Column:
    mixed = F.zip_with(
        first, second, lambda a, b: F.lit(weight_first) * a + F.lit(weight_second) * b
    )
    return normalise(mixed)


def argmax(vector: Column) -> Column:
    """Position of the largest share; the lowest position wins a tie."""
    return (F.array_position(vector, F.array_max(vector)) - 1).cast("int")


def score_map(vector: Column) -> Column:
    return F.map_from_arrays(F.lit(list(LABELS)), vector)


def readable(vector: Column) -> Column:
    """The vector, or the stand-in distribution when there is none."""
    return F.coalesce(vector, shares(UNREADABLE))

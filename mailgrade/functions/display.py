"""Expressions the result pages need."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import SCORES
from .mail import strip, text


def confidence_percent(confidence: Column) -> Column:
    return F.round(F.coalesce(confidence, F.lit(0.0)) * 100, 1)


def accuracy_band(accuracy: Column) -> Column:
    value = F.coalesce(accuracy, F.lit(0.0))
    return (
        F.when(value >= 0.85, F.lit("success"))
        .when(value >= 0.75, F.lit("primary"))
        .when(value >= 0.65, F.lit("warning"))
        .otherwise(F.lit("danger"))
    )


def short_text(value: Column, chars: int = 80) -> Column:
    """Cut to ``chars`` characters, the closing dots included; '' when blank."""
    value = text(value)
    return (
        F.when(strip(value) == "", F.lit(""))
        .when(F.length(value) > chars, F.concat(F.substring(value, 1, chars - 3), F.lit("...")))
        .otherwise(value)
    )


def body_snippet(body: Column) -> Column:
    return short_text(body, 200)


def duration_text(millis: Column) -> Column:
    return (
        F.when(millis.isNull(), F.lit("N/A"))
        .when(millis < 1000, F.format_string("%d ms", millis))
        # format_number rounds the stored binary value, format_string its decimal spelling.
        .otherwise(
            F.concat(
                F.call_function("format_number", millis / F.lit(1000.0), F.lit("0.00")),
                F.lit(" s"),
            )
        )
    )


def to_json_text(scores: Column) -> Column:
    return F.to_json(scores)


def from_json_text(value: Column) -> Column:
    """Scores from JSON text; text that is missing or broken reads as an empty map."""
    empty = F.create_map().cast(SCORES)
    return F.coalesce(F.from_json(value, SCORES, {"mode": "PERMISSIVE"}), empty)


def top_signals(scores: Column, k: int = 10, by_size: bool = False) -> Column:
    """The k strongest entries as ``array<struct<key, value>>``; ties go by key.

    ``by_size`` ranks by absolute value and rounds to 4 places.
    """
    rank = (lambda v: -F.abs(v)) if by_size else (lambda v: -v)
    shown = (lambda v: F.round(v, 4)) if by_size else (lambda v: v)
    keyed = F.transform(
        F.map_entries(scores),
        lambda e: F.struct(rank(e["value"]).alias("rank"), e["key"].alias("key"),
                           e["value"].alias("value")),
    )
    return F.transform(
        F.slice(F.sort_array(keyed), 1, k),
        lambda e: F.struct(e["key"].alias("key"), shown(e["value"]).alias("value")),
    )

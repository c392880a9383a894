"""Which signals speak for a score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import phrases as P
from ..functions import mail as M
from ..functions import matching

# Weight of each kind of signal.
PHRASE_WEIGHTS = (("critical", 1.0), ("high", 0.5), ("low", 0.3))
QUESTION_WEIGHT, EXCLAMATION_WEIGHT = 0.3, 0.2
TOP_SIGNALS = 10
_LIST_STEP = 1_000_000


def _signal(weight: Column, order: Column, name: Column) -> Column:
    return F.struct((-weight).alias("rank"), order.cast("int").alias("order"), name.alias("name"))


def _phrase_signals(hits: Column, kind: str, weight: float, phrases, step: int) -> Column:
    places = matching.constant(phrases)
    return F.transform(
        matching.among(hits, phrases),
        lambda p: _signal(
            F.lit(weight),
            F.array_position(places, p) + step,
            F.concat(F.lit(f"{kind}_keyword:"), p),
        ),
    )


def rule_signals(df: DataFrame, book: P.PhraseBook = P.DEFAULT, k: int = TOP_SIGNALS) -> DataFrame:
    """Add ``signals``: the k heaviest rule signals as ``array<struct<name, weight>>``.

    Equal weights keep list order. Everything happens inside the row, so there
    is no join with the phrases and no window over the mail.
    """
    body, hits = M.text("body"), F.col("_hits")
    parts = [
        _phrase_signals(hits, kind, weight, getattr(book, kind), step * _LIST_STEP)
        for step, (kind, weight) in enumerate(PHRASE_WEIGHTS)
    ]
    last = len(PHRASE_WEIGHTS) * _LIST_STEP
    marks = M.exclamation_count(body)
    structural = F.filter(
        F.array(
            F.when(
                F.contains(body, F.lit("?")),
                _signal(F.lit(QUESTION_WEIGHT), F.lit(last), F.lit("has_question")),
            ),
            F.when(
                marks > 0,
                _signal(
                    marks * F.lit(EXCLAMATION_WEIGHT), F.lit(last + 1), F.lit("exclamation_count")
                ),
            ),
        ),
        lambda s: s.isNotNull(),
    )
    strongest = F.slice(F.sort_array(F.concat(*parts, structural)), 1, k)
    every = book.critical + book.high + book.low
    with_hits = df.withColumn(
        "_hits", matching.found(M.signal_text(M.text("subject"), body), every)
    )
    signals = F.transform(
        strongest, lambda s: F.struct(s["name"].alias("name"), (-s["rank"]).alias("weight"))
    )
    return matching.computed_once(with_hits, {"signals": signals}).drop("_hits")


def signal_map(signals: Column) -> Column:
    return F.map_from_arrays(signals["name"], signals["weight"])

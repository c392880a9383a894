"""Hand-made feature columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import phrases as P
from ..functions import dates
from ..functions import mail as M
from ..functions import matching
from .quality import with_defaults

# Column order of the three layouts.
META = (
    "sender_domain_hash", "recipient_count", "has_cc", "has_bcc", "hour_of_day", "day_of_week",
    "is_weekend", "subject_length", "body_length", "word_count", "subject_has_re",
    "subject_has_fw", "is_reply", "is_forward", "forward_count",
)
URGENCY = (
    "urgency_keyword_count", "has_deadline", "has_question", "exclamation_count", "thread_depth",
    "attachment_count",
)
COMPACT = (
    "recipient_count", "has_cc", "has_bcc", "hour_of_day", "day_of_week", "is_weekend",
    "subject_length", "body_length", "word_count", "is_reply", "is_forward", "urgency_kw_count",
    "has_deadline", "has_question", "exclamation_count", "sender_domain_hash",
)
FULL = META + URGENCY
# The narrow layout leaves out the reply and forward columns.
NARROW = META[:10] + URGENCY


def _shared() -> dict[str, Column]:
    subject, body = F.col("subject"), F.col("body")
    return {
        "is_weekend": dates.is_weekend(F.col("day_of_week")),
        "subject_length": F.length(subject),
        "body_length": F.length(body),
        "word_count": M.word_count(body),
        "has_question": M.has_question(body),
        "exclamation_count": M.exclamation_count(body),
    }


def mail_features(df: DataFrame, book: P.PhraseBook = P.DEFAULT) -> DataFrame:
    """Add the 15 meta and 6 urgency columns (:data:`FULL`)."""
    subject, body = F.col("subject"), F.col("body")
    hits, lowered = F.col("_hits"), F.col("_signal_text")
    filled = with_defaults(df).withColumn("_signal_text", M.signal_text(subject, body))
    return (
        matching.computed_once(filled, {"_hits": matching.found(lowered, book.urgency)})
        .withColumns(
            {
                **_shared(),
                "sender_domain_hash": M.domain_bucket(M.sender_domain(F.col("sender"))),
                "is_reply": F.col("subject_has_re"),
                "is_forward": F.col("subject_has_fw"),
                "forward_count": M.forward_count(subject),
                "urgency_keyword_count": matching.count_among(hits, book.critical)
                + matching.count_among(hits, book.high),
                "has_deadline": M.has_deadline(lowered),
                "thread_depth": M.thread_depth(subject),
                "attachment_count": M.attachment_count(body),
            }
        )
        .drop("_signal_text", "_hits")
    )


def compact_features(df: DataFrame, book: P.PhraseBook = P.COMPACT) -> DataFrame:
    """Add the 16 columns of the compact layout (:data:`COMPACT`)."""
    subject, body = F.col("subject"), F.col("body")
    hits, lowered = F.col("_hits"), F.col("_signal_text")
    filled = with_defaults(df).withColumn("_signal_text", M.signal_text(subject, body))
    return (
        matching.computed_once(filled, {"_hits": matching.found(lowered, book.urgency)})
        .withColumns(
            {
                **_shared(),
                "is_reply": M.has_reply_prefix(subject),
                "is_forward": M.has_forward_prefix(subject),
                "urgency_kw_count": matching.count_among(hits, book.critical)
                + matching.count_among(hits, book.high),
                "has_deadline": M.has_deadline(lowered, compact=True),
                "sender_domain_hash": M.domain_bucket(
                    M.sender_domain(F.col("sender")), missing_is_zero=True
                ),
            }
        )
        .drop("_signal_text", "_hits")
    )


def narrow_meta(vector: Column, tail: int = 0) -> Column:
    """Project ``array<double>`` of the full layout (21 + tail) to the narrow one (16 + tail).

    A row that is already narrow, or of any other width, passes through.
    """
    cut = F.concat(
        F.slice(vector, 1, 10), F.slice(vector, 16, 6 + tail) if tail else F.slice(vector, 16, 6)
    )
    return F.when(F.size(vector) == len(FULL) + tail, cut).otherwise(vector)


def feature_names(vocabulary: DataFrame) -> DataFrame:
    """``(idx, name)`` of the narrow layout followed by the vocabulary ``(idx, term)``."""
    spark = vocabulary.sparkSession
    meta = spark.createDataFrame(list(enumerate(NARROW)), "idx int, name string")
    terms = vocabulary.select((F.col("idx") + len(NARROW)).alias("idx"), F.col("term").alias("name"))
    return meta.unionByName(terms)

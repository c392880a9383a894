"""Mail views over the given tables: documents give the text, events the date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import spread

# Sender names, recipients and subjects by id modulo coprime numbers.
_SENDERS = ("ceo", "director", "noreply", "no-reply")
_RECIPIENTS = ("", "a@x.example", "a@x.example, b@y.example",
               "a@x.example, b@y.example, c@z.example")
_SUBJECTS = (
    "URGENT: gateway outage!!!", "Security alert on host", "Please review the draft?",
    "Re: budget talks", "Re: Re: budget talks", "Fwd: article of note", "FW: FW: photo album",
    "Weekly digest", "Unsubscribe from promo list", "Viva next year",
    "Viva next year, reply asap", "Lunch menu", "Font files", "", "Parking lots",
    "Deadline by friday",
)
_FOLDERS = ("urgent", "spam", "junk/old", "newsletter", "notifications")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _pick(values, modulus: int):
    return F.get(F.lit(list(values)), (F.col("id") % modulus).cast("int"))


def _as_mail(documents: DataFrame, events: DataFrame) -> DataFrame:
    user = F.concat(F.lit("user"), F.coalesce(F.col("user_id").cast("string"), F.lit("0")))
    return (
        documents.select(F.col("doc_id").alias("id"), "source", F.col("text").alias("body"))
        .join(
            events.select(F.col("event_id").alias("id"), "user_id", F.col("ts").alias("date")),
            "id",
            "left",
        )
        .select(
            "id",
            F.concat(F.lit("<"), F.col("id").cast("string"), F.lit("@"), "source",
                     F.lit(".example>")).alias("message_id"),
            F.concat(F.coalesce(_pick(_SENDERS, 11), user), F.lit("@"), "source",
                     F.lit(".example")).alias("sender"),
            _pick(_RECIPIENTS, 4).alias("recipients"),
            F.when(F.col("id") % 5 == 0, "team@x.example").otherwise("").alias("cc"),
            F.when(F.col("id") % 13 == 0, "audit@x.example").otherwise("").alias("bcc"),
            _pick(_SUBJECTS, 16).alias("subject"),
            "body",
            "date",
            F.coalesce(_pick(_FOLDERS, 17), F.lit("inbox")).alias("folder"),
        )
    )


def mail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(id, message_id, sender, recipients, cc, bcc, subject, body, date, folder)``."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return _as_mail(spread(documents), table(spark, sf_dir, "events"))


def mail_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(id, subject, body)`` of the mail, without the join that only dates and users need."""
    documents = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("body"))
    return spread(documents).select("id", _pick(_SUBJECTS, 16).alias("subject"), "body")


def mail_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same view with the documents read as a stream."""
    static = table(spark, sf_dir, "documents")
    # A table is one file or a folder of them. A pattern finds both; a plain path has to be a folder.
    documents = spark.readStream.schema(static.schema).parquet(f"{sf_dir.rstrip('/')}/documents.parque[t]")
    return _as_mail(spread(documents), table(spark, sf_dir, "events"))


def mail_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mail with every tenth repeated; ``seq`` is the order of arrival."""
    copies = F.when(F.col("id") % 10 == 0, F.array(F.lit(0), F.lit(1))).otherwise(
        F.array(F.lit(0))
    )
    return mail(spark, sf_dir).withColumn("seq", F.explode(copies))


def mail_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mail with gaps and stray priorities."""

    def gap(name: str, modulus: int):
        return F.when(F.col("id") % modulus == 0, "").otherwise(F.col(name)).alias(name)

    return mail(spark, sf_dir).select(
        "id", "message_id", gap("sender", 6), gap("subject", 3), gap("body", 7),
        _pick(("critical", "high", "low", "bogus"), 5).alias("priority"),
    )


def mail_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw address and date headers."""
    to_header = F.when(F.col("recipients") == "", "undisclosed-recipients:;").otherwise(
        F.concat(F.lit('"Team, All" <'),
                 F.replace("recipients", F.lit(", "), F.lit(">, <")), F.lit(">"))
    )
    dates = ("Mon, 14 May 2001 16:39:00 -0700 (PDT)", "2026-04-23T15:21", "not a date")
    return mail(spark, sf_dir).select(
        "id", to_header.alias("to_header"), _pick(dates, 3).alias("date_header")
    )


def model_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mail with the output of a stand-in model: ``prediction`` and ``probability``."""
    outputs = ((2, (0.05, 0.15, 0.70, 0.10)), (0, (0.70, 0.20, 0.05, 0.05)),
               (1, (0.10, 0.75, 0.10, 0.05)))
    vectors = F.array(*(F.array(*(F.lit(v) for v in p)) for _, p in outputs))
    return mail(spark, sf_dir).withColumns(
        {
            "prediction": _pick([c for c, _ in outputs], 3),
            "probability": F.get(vectors, (F.col("id") % 3).cast("int")),
        }
    )


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")

"""From raw messages to a labelled mail table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import phrases as P
from ..functions import mail as M
from ..operators import quality, rules, sampling
from ..schema import MAIL
from ..sources import folder, messages


def label_and_measure(mail: DataFrame, book: P.PhraseBook = P.DEFAULT) -> DataFrame:
    """Add label, lengths, counts and flags to parsed mail."""
    labelled = rules.weak_label(mail, book)
    subject, body = F.col("subject"), F.col("body")
    return labelled.withColumns(
        {
            "priority_label": M.label_name(F.col("priority")),
            "body_length": F.length(body),
            "subject_length": F.length(subject),
            "word_count": M.word_count(body),
            "recipient_count": M.recipient_count(F.col("recipients")),
            "has_cc": M.is_filled(F.col("cc")),
            "has_bcc": M.is_filled(F.col("bcc")),
            "subject_has_re": M.has_reply_prefix(subject),
            "subject_has_fw": M.has_forward_prefix(subject),
            "is_reply": M.has_reply_prefix(subject),
            "is_forward": M.has_forward_prefix(subject),
        }
    )


def ingest(
    files: DataFrame, root: str, max_mails: int | None = None, book: P.PhraseBook = P.DEFAULT
) -> tuple[DataFrame, DataFrame]:
    """``(mail table, rejects)`` from ``(path, content)`` rows.

    A cap samples the *files* by path before anything is parsed. Duplicates are
    removed after labelling; the first by path stays. Both results are lazy and
    parse for themselves; where both are needed, write ``parse_messages`` out
    first and split what was written.
    """
    if max_mails:
        files = sampling.sample_cap(files, max_mails, key="path")
    mail, rejects = messages.split_rejects(messages.parse_messages(files, root))
    table = quality.keep_first(label_and_measure(mail, book), "message_id", "path")
    return table.select(*MAIL.fieldNames()), rejects


def ingest_folder(spark: SparkSession, root: str, max_mails: int | None = None):
    """:func:`ingest` over a tree of message files, those whose names begin with ``_`` included."""
    return ingest(folder.read_folder(spark, root), root, max_mails)

"""Row gates, defaults, keep-first dedup and deletes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates
from ..functions import mail as M
from ..schema import LABELS

TEXT_COLUMNS = ("sender", "recipients", "subject", "body", "cc", "bcc", "folder")


def with_origin(df: DataFrame) -> DataFrame:
    """Keep mail that has a sender or a subject."""
    return df.filter((M.text("sender") != "") | (M.text("subject") != ""))


def payload_error() -> Column:
    """Why a request cannot be scored, or null when it can."""
    missing = (M.text("subject") == "") & (M.text("body") == "")
    return F.when(missing, F.lit("At least one of 'subject' or 'body' is required."))


def split_payloads(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(valid, errors)``; the error rows carry ``error``."""
    checked = df.withColumn("error", payload_error())
    return checked.filter("error IS NULL").drop("error"), checked.filter("error IS NOT NULL")


def store_ready() -> Column:
    """Sender, subject and body are filled; the priority is a known one or null."""
    filled = [M.strip(M.text(c)) != "" for c in ("sender", "subject", "body")]
    known = F.col("priority").isNull() | F.col("priority").isin(*LABELS)
    return filled[0] & filled[1] & filled[2] & known


def split_store_quality(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    ready = store_ready()
    return df.filter(ready), df.filter(~ready)


def with_priority(df: DataFrame, priority: str) -> DataFrame:
    """The rows of one priority."""
    if priority not in LABELS:
        raise ValueError(f"unknown priority {priority!r}; expected one of {LABELS}")
    return df.filter(F.col("priority") == priority)


def with_defaults(df: DataFrame) -> DataFrame:
    """Add what a sparse mail table lacks: empty texts, counts, flags, hour and weekday.

    Columns that are present win; nulls in them read as empty.
    """
    have = set(df.columns)
    out = df.withColumns({c: M.text(c) if c in have else F.lit("") for c in TEXT_COLUMNS})
    moment = F.lit(None).cast("timestamp_ntz")
    if "date" in have:
        is_text = dict(df.dtypes)["date"] == "string"
        moment = dates.local_time(F.col("date")) if is_text else F.col("date")
    derived = {
        "hour_of_day": dates.hour_of_day(moment),
        "day_of_week": dates.day_of_week(moment),
        "recipient_count": M.recipient_count(F.col("recipients")),
        "has_cc": M.is_filled(F.col("cc")),
        "has_bcc": M.is_filled(F.col("bcc")),
        "subject_has_re": M.has_reply_prefix(F.col("subject")),
        "subject_has_fw": M.has_forward_prefix(F.col("subject")),
    }
    unknown = {"hour_of_day": -1, "day_of_week": -1}
    return out.withColumns(
        {
            name: F.coalesce(F.col(name).try_cast("int"), F.lit(unknown.get(name, 0)))
            if name in have
            else value
            for name, value in derived.items()
        }
    )


def keep_first(df: DataFrame, key: str = "message_id", order: str = "path") -> DataFrame:
    """The first row per key in the given order.

    The rank filter is applied before the shuffle as well, so a key that holds a
    large part of all rows reaches its reducer as one row per input task.
    """
    window = Window.partitionBy(key).orderBy(order)
    return (
        df.withColumn("_rank", F.row_number().over(window)).filter("_rank = 1").drop("_rank")
    )


def without_deleted(results: DataFrame, deletes: DataFrame, key: str = "id") -> DataFrame:
    """Results less the deleted ids."""
    return results.join(deletes.select(key), key, "left_anti")

"""Mail tables as CSV and Parquet.

CSV is here for exchange; bodies hold line breaks, and :mod:`.quoted` splits the files all the
same. Parquet is the working format.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..schema import MAIL, RAW_COLUMNS
from . import quoted

_QUOTED = {
    "quote": '"', "escape": '"', "header": True,
    "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False,
}


def read_csv(spark: SparkSession, path: str, schema=MAIL) -> DataFrame:
    """A quoted mail CSV with bodies over several lines; empty cells are empty strings."""
    return quoted.read(spark, path, schema)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).options(quoteAll=True, **_QUOTED).csv(path)


def raw_projection(df: DataFrame) -> DataFrame:
    """The nine raw columns, without labels."""
    return df.select(*RAW_COLUMNS)


def read_mail(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_mail(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).parquet(path)

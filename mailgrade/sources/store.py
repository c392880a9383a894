"""The result store: append-only Parquet, partitioned by day of ingest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.quality import split_store_quality
from ..schema import RESULT_COLUMNS
from ..session import staging_path

_DAY, _BATCH = "ingest_date", "batch_id"


def to_results(scored: DataFrame, created_at: str = "created_at") -> DataFrame:
    """Scored mail in the column order of the store."""
    return scored.withColumns({"created_at": F.col(created_at), "updated_at": F.col(created_at)}).select(*RESULT_COLUMNS)


def _write(results: DataFrame, path: str, mode: str) -> None:
    """Rows of a day are brought together, so that a day is a few files and not one per task.

    ``rebalance`` lets adaptive execution split a heavy day among several tasks.
    """
    (
        results.hint("rebalance", F.col(_DAY))
        .write.mode(mode)
        .partitionBy(_DAY)
        .parquet(path)
    )


def append(results: DataFrame, path: str, rejects: str | None = None, batch_id: int | None = None) -> None:
    """Append the rows that are fit to be stored; with ``rejects``, the others go there with their reason.

    A batch with an id is written to a folder of that id, which a replay replaces, so no row
    comes twice.
    """
    good, bad = split_store_quality(results)
    mode = "append" if batch_id is None else "overwrite"
    under = "" if batch_id is None else f"/{_BATCH}={batch_id}"
    _write(good.withColumn(_DAY, F.to_date("created_at")), path + under, mode)
    if rejects:
        reason = F.when(F.trim(F.coalesce("sender", F.lit(""))) == "", "no sender").otherwise("not fit for the store")
        bad.withColumn("reject_reason", reason).write.mode(mode).parquet(rejects + under)


def _marks(path: str) -> str:
    return f"{path.rstrip('/')}.deletes"


def _there(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def _rows(spark: SparkSession, path: str) -> DataFrame:
    """All rows that were ever appended, with the time of the file that holds them."""
    return spark.read.parquet(path).withColumn("_written", F.col("_metadata.file_modification_time"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the store without those that a later delete names."""
    if not _there(spark, _marks(path)):
        return spark.read.parquet(path)
    # The last mark of an id; a mail of the same id that was appended after it counts again.
    marks = spark.read.parquet(_marks(path)).groupBy(F.col("id").alias("_marked")).agg(F.max("until").alias("_until"))
    gone = (F.col("id") == F.col("_marked")) & (F.col("_written") <= F.col("_until"))
    return _rows(spark, path).join(marks, gone, "left_anti").drop("_written")


def find(results: DataFrame, record_id) -> DataFrame:
    """One record by id; the filter reaches the Parquet scan."""
    return results.filter(F.col("id") == F.lit(record_id))


def delete(spark: SparkSession, path: str, deletes: DataFrame) -> None:
    """Mark ids as deleted; no row of the store is read or rewritten.

    A mark is the id and the time of the newest file in the store, as the store's own file
    system tells it. Marks stand beside the store and are applied by :func:`read`; they are
    written whole or not at all. :func:`compact` removes the rows.
    """
    if not _there(spark, path):
        return
    until = _rows(spark, path).agg(F.max("_written").alias("until"))  # one row, from file listings
    deletes.select("id").distinct().crossJoin(until).filter("until IS NOT NULL").write.mode("append").parquet(_marks(path))


def compact(spark: SparkSession, path: str) -> None:
    """Rewrite the days that hold marked rows without them, then drop the marks.

    The days are written beside the store first and then replace their partitions; a job that
    fails half-way leaves rows and marks, and can be run again.
    """
    if not _there(spark, _marks(path)):
        return
    stored_rows = spark.read.parquet(path)
    parts = [c for c in (_BATCH, _DAY) if c in stored_rows.columns]
    kept = read(spark, path)
    before = stored_rows.groupBy(*parts).agg(F.count("*").alias("n"))
    after = kept.groupBy(*parts).agg(F.count("*").alias("left"))
    days = before.join(after, parts, "left").withColumn("left", F.coalesce("left", F.lit(0))).filter("left < n").collect()  # a row for each day
    touched = [r for r in days if r["left"]]
    if touched:
        beside = staging_path(spark, "store-compact")
        names = spark.createDataFrame([tuple(r[c] for c in parts) for r in touched], stored_rows.select(*parts).schema)
        kept.join(F.broadcast(names), parts, "left_semi").write.partitionBy(*parts).parquet(beside)
        (
            spark.read.schema(kept.schema).parquet(beside).hint("rebalance", F.col(_DAY))
            .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(path)
        )
    for row in days:
        if not row["left"]:
            _drop_folder(spark, "/".join([path, *(f"{c}={row[c]}" for c in parts)]))
    _drop_folder(spark, _marks(path))


def _drop_folder(spark: SparkSession, path: str) -> None:
    """Remove a day of which nothing is left, in whatever file system the store is in."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)

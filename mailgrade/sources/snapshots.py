"""Small results that are replaced whole while others read them.

Each version is a folder of its own. A version counts once Spark has written its success file,
which is the last thing a job writes, so a reader sees the newest complete version at any moment;
a replace that fails leaves the one before. The version before the newest stays for those who
are still reading it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_VERSION = "version="
KEPT = 2


def _versions(spark: SparkSession, path: str) -> list[tuple[int, bool]]:
    """(number, whether it is complete) of the versions, newest first."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    place = hadoop.Path(path)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(place):
        return []
    names = [s.getPath().getName() for s in system.listStatus(place) if s.isDirectory()]
    numbers = [int(n.removeprefix(_VERSION)) for n in names if n.startswith(_VERSION)]
    done = lambda v: system.exists(hadoop.Path(f"{path}/{_VERSION}{v}/_SUCCESS"))
    return [(v, done(v)) for v in sorted(numbers, reverse=True)]


def write(rows: DataFrame, path: str, version: int) -> None:
    """Write ``rows`` as a version; a version that is written again replaces itself."""
    spark, path = rows.sparkSession, path.rstrip("/")
    rows.write.mode("overwrite").parquet(f"{path}/{_VERSION}{version}")
    hadoop = spark._jvm.org.apache.hadoop.fs
    complete = [v for v, done in _versions(spark, path) if done]
    for old in complete[KEPT:]:
        place = hadoop.Path(f"{path}/{_VERSION}{old}")
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The newest complete version."""
    path = path.rstrip("/")
    newest = next((v for v, done in _versions(spark, path) if done), None)
    if newest is None:
        raise FileNotFoundError(f"no complete version in {path}")
    return spark.read.parquet(f"{path}/{_VERSION}{newest}")

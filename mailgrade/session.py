"""Session helpers: a local session for tests and benches, and shared staging."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", name: str = "mailgrade", **conf) -> SparkSession:
    """A ``local[n]`` session. On a cluster, use the session it gives you."""
    parallel = 8 if cpus == "*" else int(cpus)
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(parallel))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config(READ_PARTITIONS, str(parallel))
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def staging_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local master may fall back to a folder of its own, because there
    driver and executors are one process on one machine.
    """
    sc = spark.sparkContext
    root = (
        spark.conf.get("spark.checkpoint.dir", None)
        or sc.getConf().get("spark.checkpoint.dir")
        or sc.getCheckpointDir()
    )
    if root is None:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        root = tempfile.mkdtemp(prefix="mailgrade-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(root)
    return root


def staging_path(spark: SparkSession, name: str) -> str:
    """A fresh path below :func:`staging_dir`."""
    return f"{staging_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and read it back.

    Used where several passes follow, so that a lost executor costs a re-read and not a
    re-computation. The folder is the cluster's to clear.
    """
    path = staging_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialise(df: DataFrame) -> DataFrame:
    """:func:`stored` under a common name."""
    return stored(df, "rows")


READ_PARTITIONS = "mailgrade.read.partitions"


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows to as many tasks as the session asks for; untouched where it asks for nothing.

    Text rules are heavy per row, and a file of one row group is one task however many cores
    there are. A session over such files sets ``mailgrade.read.partitions``; a large input
    needs no setting, and the plan never depends on its size.
    """
    wanted = df.sparkSession.conf.get(READ_PARTITIONS, None)
    return df.repartition(int(wanted)) if wanted else df

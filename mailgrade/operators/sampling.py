"""Exact, repeatable samples, splits and folds without sorting whole classes.

Rows are ranked by a hash of their id. Ranking every row of a class in one
window would put the class into one task, so only the *cut points* are ranked:
rows are counted per hash bucket, the bucket that holds a cut is found from the
running counts, and just that bucket (about 1/65536 of a class) is ordered. The
split itself is then a comparison with a handful of broadcast hash values; the
data is never shuffled. Rows with the same id always fall on the same side, so
sizes are exact where ids are unique.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.matching import let
from ..schema import FOLDS, SAMPLE_CAP, SEED, TEST_SHARE

_BUCKET_DIGITS = 4


def hash_key(key: str | Column, seed: int = SEED) -> Column:
    column = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(column.cast("string"), F.lit(f"|{seed}")))


def rank_cuts(
    df: DataFrame, order: Column, by: Sequence[str], ranks: Callable[[Column], Column]
) -> DataFrame:
    """The order keys that stand at given ranks.

    ``ranks`` maps the group size to an array of 1-based ranks. Returns
    ``(*by, cuts)`` with ``cuts`` an array of order keys in the order of the
    ranks; a rank below 1 or above the group size gives no cut.
    """
    by = list(by)
    keyed = df.select(*by, order.alias("_key")).withColumn(
        "_bucket", F.substring("_key", 1, _BUCKET_DIGITS)
    )
    counts = keyed.groupBy(*by, "_bucket").agg(F.count("*").alias("_n"))
    # At most 16 ** _BUCKET_DIGITS rows per group from here on.
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    running = group.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    targets = (
        counts.withColumns(
            {"_upto": F.sum("_n").over(running), "_size": F.sum("_n").over(group)}
        )
        .select(*by, "_bucket", "_n", "_upto", F.posexplode(ranks(F.col("_size"))).alias("_i", "_r"))
        .filter((F.col("_r") <= F.col("_upto")) & (F.col("_r") > F.col("_upto") - F.col("_n")))
        .select(*by, "_bucket", "_i", (F.col("_r") - F.col("_upto") + F.col("_n")).alias("_within"))
    )
    # Equal keys (repeated ids) are merged before they are ordered, so they cost one row.
    inside = (
        Window.partitionBy(*by, "_bucket", "_i").orderBy("_key")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        keyed.join(F.broadcast(targets), [*by, "_bucket"])
        .groupBy(*by, "_bucket", "_i", "_within", "_key")
        .agg(F.count("*").alias("_n"))
        .withColumn("_place", F.sum("_n").over(inside))
        .filter((F.col("_place") >= F.col("_within"))
                & (F.col("_place") - F.col("_n") < F.col("_within")))
        .groupBy(*by)
        .agg(F.sort_array(F.collect_list(F.struct("_i", "_key"))).alias("_cuts"))
        .select(*by, F.col("_cuts._key").alias("cuts"))
    )


def _with_cuts(df: DataFrame, cuts: DataFrame, by: Sequence[str]) -> DataFrame:
    """Attach the cut keys: one short row per group, so broadcasting is safe."""
    if by:
        return df.join(F.broadcast(cuts), list(by), "left")
    marked = cuts.withColumn("_one", F.lit(1))
    return df.withColumn("_one", F.lit(1)).join(F.broadcast(marked), "_one", "left").drop("_one")


def sample_cap(df: DataFrame, n: int = SAMPLE_CAP, key: str = "id", seed: int = SEED) -> DataFrame:
    """Keep exactly ``n`` rows, chosen by hash; all of them when there are fewer."""
    order = hash_key(key, seed)
    cuts = rank_cuts(df, order, [], lambda size: F.array(F.least(size, F.lit(n))))
    return (
        _with_cuts(df, cuts, [])
        .filter(order <= F.get("cuts", F.lit(0)))
        .drop("cuts")
    )


def stratified_split(
    df: DataFrame, label: str = "priority", key: str = "id", share: float = TEST_SHARE,
    seed: int = SEED,
) -> DataFrame:
    """Add ``is_test``: a share of every class, rounded to whole rows."""
    order = hash_key(key, seed)
    wanted = lambda size: F.array(F.floor(size * F.lit(share) + F.lit(0.5)))
    cuts = rank_cuts(df, order, [label], wanted)
    return (
        _with_cuts(df, cuts, [label])
        .withColumn("is_test", F.coalesce(order <= F.get("cuts", F.lit(0)), F.lit(False)))
        .drop("cuts")
    )


def stratified_folds(
    df: DataFrame, label: str = "priority", key: str = "id", k: int = FOLDS, seed: int = SEED
) -> DataFrame:
    """Add ``fold`` (0..k-1); the folds of a class differ by at most one row."""
    order = hash_key(key, seed)

    def wanted(size: Column) -> Column:
        whole = F.floor(size / F.lit(k))
        return F.array(*(whole * i + F.least(size % k, F.lit(i)) for i in range(1, k)))

    cuts = rank_cuts(df, order, [label], wanted)
    return (
        _with_cuts(df, cuts, [label])
        .withColumn(
            "fold",
            F.coalesce(
                let(
                    order,
                    lambda key: F.aggregate(
                        "cuts", F.lit(0), lambda acc, cut: acc + (key > cut).cast("int")
                    ),
                ),
                F.lit(0),
            ),
        )
        .drop("cuts")
    )


def class_weights(df: DataFrame, label: str = "priority") -> DataFrame:
    """``(label, n, weight)`` with weight = rows / (classes * rows of the class)."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    every = Window.partitionBy(F.lit(1))  # one row per class
    return counts.withColumn(
        "weight", F.sum("n").over(every) / (F.count("*").over(every) * F.col("n"))
    )


def with_class_weight(df: DataFrame, label: str = "priority", out: str = "weight") -> DataFrame:
    weights = class_weights(df, label).select(label, F.col("weight").alias(out))
    return df.join(F.broadcast(weights), label)

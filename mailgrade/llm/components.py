"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailgrade.llm.common import stored


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the least node next to it."""
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m"))
    return both.join(least, F.col("a") == F.col("n")).filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.least("n", "m").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    """The smaller neighbours of a node and the node itself are tied to the least of them."""
    least = links.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m"))
    tied = links.join(least, F.col("a") == F.col("n")).filter(F.col("b") != F.col("m"))
    return tied.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("n", "m"))


def _mark(links: DataFrame) -> tuple:
    row = links.agg(
        F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")
    ).first()
    return row["n"], row["h"]


def components(links: DataFrame) -> DataFrame:
    """(a, b) with a > b, a comparable type; returns (node, root), the least node that each linked node reaches.

    A round is two joins on the node; a node with very many links is a skewed join key, which
    Spark splits. Each round is written to the shared folder. The number of rounds grows with
    the logarithm of the longest chain. Roots themselves are among the nodes.
    """
    now = stored(links.select("a", "b").filter(F.col("a") > F.col("b")).distinct(), "links")
    mark = _mark(now)
    while mark[0]:
        now = stored(_small_star(_large_star(now)).filter(F.col("a") != F.col("b")).distinct(), "links")
        before, mark = mark, _mark(now)
        if mark == before:
            break
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())

"""Connected components of a distributed edge table, by alternating large-star and small-star steps.

Edges stay in tables in the shared folder; only a count and a sum come to the driver after each round.
A hub's edges are never gathered in one task: minima are partial aggregates, and the join back to the
edges is a merge join, which adaptive execution splits where a key is large and which, unlike a broadcast, leaves nothing
with the driver: a round's tables would be built there and stay until its garbage is collected, round after round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remove, stored


def _to_minimum(directed: DataFrame) -> DataFrame:
    """Each edge (a, b) with the least b of a."""
    least = directed.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "a2")
    return directed.join(least.hint("merge"), F.col("a") == F.col("a2")).select("a", "b", "m")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = _to_minimum(both).where(F.col("b") > F.col("a"))
    return near.select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    near = _to_minimum(down)
    own = near.select("a", F.col("m").alias("b"))
    moved = near.where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return own.unionByName(moved).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b): root is the least node of its component.

    Loops and repeated edges are allowed; nodes must be longs and not null."""
    spark = edges.sparkSession
    now, path = stored(edges.where(F.col("a") != F.col("b")).select("a", "b").distinct(), "edges")
    sign = lambda df: tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    before = None
    while (mark := sign(now)) != before:
        before = mark
        after, new_path = stored(_small_star(_large_star(now)), "edges")
        remove(spark, path)
        now, path = after, new_path
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)

"""Connected components by alternating large-star and small-star steps.

Every step is an aggregate and an equi-join over edges; no neighbour list is ever gathered, and each
round is written to the shared folder, so lost executors cost one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import written


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def _is_star_forest(edges: DataFrame) -> bool:
    """Whether every node hangs on one least node, which hangs on none; then a further step changes nothing."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("b", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up + down > 1").isEmpty()


def connected(edges: DataFrame) -> DataFrame:
    """(node, comp) of every node with an edge (a, b); comp is the component's least node. Edges: longs, not null."""
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc")
    while not _is_star_forest(now):
        now = written(_small_star(_large_star(now)), "cc")
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("comp"))
    return stars.union(now.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct())

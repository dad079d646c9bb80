"""Results of message exchanges among processing elements 0..n-1, as relational queries.

A queue, mailbox or ring is a shuffle by the receiver; back-pressure is the engine's. The inputs
are bounded (each sender states its messages), so none of this needs streaming state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def elements(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("pe"))


def ring_shift(spark: SparkSession, n: int) -> DataFrame:
    """(pe, received): each sends its rank to the next."""
    return elements(spark, n).select(((F.col("pe") + 1) % n).alias("pe"), F.col("pe").alias("received"))


def ring_reduce(spark: SparkSession, n: int) -> DataFrame:
    """(pe, target): the sum of all ranks less one's own."""
    total = elements(spark, n).agg(F.sum("pe").alias("t"))
    return elements(spark, n).join(total).select("pe", (F.col("t") - F.col("pe")).alias("target"))


def ring_broadcast(spark: SparkSession, n: int, size: int = 32) -> DataFrame:
    """(pe, i, data): the root's array on every element."""
    return elements(spark, n).select("pe", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(size - 1).cast("long"))).alias("i")).withColumn("data", F.col("i"))


def all_to_all(spark: SparkSession, n: int, size: int = 4) -> DataFrame:
    """(pe, src, total): sums of what each source sent to each element."""
    sent = elements(spark, n).withColumnRenamed("pe", "src").withColumn("pe", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(size - 1))))
    return sent.groupBy(F.col("pe").cast("long").alias("pe"), "src").agg(F.sum(F.col("src") + F.col("i")).alias("total"))


def queue_sum(spark: SparkSession, n: int, warps: int, size: int) -> DataFrame:
    """(pe, total): every warp of every other element sends 0..size-1 to each; the queues are drained."""
    sent = elements(spark, n).withColumnRenamed("pe", "src").withColumn("pe", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))).where("src <> pe")
    sent = sent.withColumn("w", F.explode(F.sequence(F.lit(1), F.lit(warps)))).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(size - 1))))
    return sent.groupBy("pe").agg(F.sum("x").cast("long").alias("total"))


def stop_flag(spark: SparkSession, n: int) -> DataFrame:
    """(pe, stop): all but element 0 see the flag that it sets."""
    return elements(spark, n).select("pe", (F.col("pe") != 0).cast("int").alias("stop"))


def ring_copy(message: DataFrame, n: int) -> DataFrame:
    """``message`` with (hop, holder): copied from element 0 to n - 1, one hop each, and back to the host (-1)."""
    hop = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n).cast("long"))).alias("hop")
    return message.select(hop, "*").select("hop", F.when(F.col("hop") < n, F.col("hop")).otherwise(-1).cast("long").alias("holder"), *message.columns)


def _sequence(column, name: str):
    """A row for each of 0..column-1."""
    return F.explode(F.when(column > 0, F.sequence(F.lit(0).cast("long"), (column - 1).cast("long")))).alias(name)


def mailbox_checksum(spark: SparkSession, dests: int, warps: int, rounds: int, own: int = 2) -> DataFrame:
    """(checksum): what the receivers of a block's mailboxes add up.

    In every round a warp sends ``degree`` values to each element but ``own``: degree + dest - i.
    """
    sent = spark.range(warps).withColumnRenamed("id", "warp").select("warp", _sequence(F.lit(rounds), "round"))
    sent = sent.select(((F.col("warp") * 1379 + F.col("round")) % 512).alias("degree")).select("degree", _sequence(F.lit(dests), "dest")).where(F.col("dest") != own)
    values = sent.select("degree", "dest", _sequence(F.col("degree"), "i"))
    return values.agg(F.sum(F.col("degree") + F.col("dest") - F.col("i")).alias("checksum"))


def mailbox_totals(spark: SparkSession, n: int, rounds: int = 8, slot: int = 16) -> DataFrame:
    """(pe, sent, received): sums of the slots that elements fill for each other, degree - i in each round."""
    sent = elements(spark, n).select(F.col("pe").alias("src"), _sequence(F.lit(n), "dest")).where("src <> dest").select("src", "dest", _sequence(F.lit(rounds), "round"))
    sent = sent.withColumn("degree", ((F.col("round") + F.col("dest")) * 137) % slot).select("src", "dest", "degree", _sequence(F.col("degree"), "i"))
    both = sent.select(F.col("src").alias("pe"), (F.col("degree") - F.col("i")).alias("s"), F.lit(0).alias("r")).union(sent.select("dest", F.lit(0), F.col("degree") - F.col("i")))
    return both.groupBy("pe").agg(F.sum("s").alias("sent"), F.sum("r").alias("received"))


def thread_counters(spark: SparkSession, n: int) -> DataFrame:
    """(a, b): a counter that every element adds to, and one that a single element adds to."""
    return elements(spark, n).agg(F.count(F.lit(1)).alias("a"), F.count(F.when(F.col("pe") == 0, 1)).alias("b"))

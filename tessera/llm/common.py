"""Helpers shared by the operators: shared storage, intermediate tables, column access."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.storage import new_path, remove


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet to the shared folder and read it again.

    The shuffle files behind the table are of no use afterwards. Spark deletes them once the driver's
    garbage collector has found their plan unreachable, so it is asked to run.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    spark._jvm.System.gc()
    out = spark.read.schema(df.schema).parquet(path)
    out._tessera_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables made by ``written`` once all that is computed from them is written itself."""
    for df in tables:
        remove(df.sparkSession, df._tessera_path)


#: Rows up to which a table of ids or short arrays is broadcast.
MAX_BROADCAST_ROWS = 1 << 18


def checked(df: DataFrame, rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """``df``, written, with a broadcast hint only if it has at most ``rows`` rows; else its joins shuffle."""
    df = written(df, "side")
    return F.broadcast(df) if df.count() <= rows else df


#: Bits by which rows are sifted, 8 MB however many keys there are.
SIFT = 1 << 26


def sifted(rows: DataFrame, of: list, keys: DataFrame, by: list) -> DataFrame:
    """``rows`` without most of those whose columns ``of`` equal no ``by`` of ``keys``, so that a join shuffles few others.

    A bit stands for every hash of a key; all of them are sent to all tasks. ``keys`` should be written: it is read here too.
    """
    spot = lambda columns: F.pmod(F.xxhash64(*columns), F.lit(SIFT)) + 1
    bits = keys.select(spot(by).alias("_k")).groupBy(F.bitmap_bucket_number("_k").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_k")).alias("_bits"))
    known = rows.withColumn("_k", spot(of)).withColumn("_bucket", F.bitmap_bucket_number("_k")).join(F.broadcast(bits), "_bucket")
    one = F.expr("conv(hex(substring(_bits, cast(bitmap_bit_position(_k) div 8 as int) + 1, 1)), 16, 10)").cast("int")
    return known.where(one.bitwiseAND(F.expr("shiftleft(1, cast(bitmap_bit_position(_k) % 8 as int))")) != 0).select(*rows.columns)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(column):
    """Lower-case A-Z only."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

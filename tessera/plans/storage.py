"""Cutting lineage in iterative plans, and tables kept in the shared folder."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, which driver and executors share.

    Where it is unset a temporary folder is used in local mode (tests); on a cluster that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; removed when the driver ends, if not before."""
    path = f"{shared_dir(spark)}/tessera/{name}-{uuid.uuid4().hex}"
    _OWN.append((spark, path))
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path with the file system that Spark uses for it."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _clean() -> None:
    for spark, path in _OWN:
        try:
            remove(spark, path)
        except Exception:  # the JVM may have ended first; the folder's owner clears it then
            return


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder, so that later reads take only the columns they need.

    Plans on it start from the files' size; a checkpoint keeps the estimates of all plans before it, which multiply in loops.
    Shuffle files behind the table go once the driver's garbage collector has run, so it is asked to.
    """
    path = new_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    df.sparkSession._jvm.System.gc()
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._tessera_path = path
    return out

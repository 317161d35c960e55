"""Cuts lineage where a plan would otherwise hold the same subtree many times over."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where it is unset, a local session, as in tests, gets a temporary one and any other an error."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="checkpoints")
        sc.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """``df`` as stored by checkpoint() in the shared folder."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def stored(df: DataFrame, by: str | None = None) -> DataFrame:
    """``df`` as stored in the shared folder in compressed columns, for many rows: a checkpoint's are not compressed.

    With ``by`` they lie in buckets of that column, and joins, groups and windows on it need no shuffle. Files go when the JVM ends.
    """
    spark, name = df.sparkSession, f"stored_{uuid.uuid4().hex}"
    at = f"{shared_folder(spark)}/{name}"
    if by:
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        df.repartition(n, by).write.option("path", at).option("compression", "zstd").bucketBy(n, by).sortBy(by).saveAsTable(name)
    else:
        df.write.option("compression", "zstd").parquet(at)
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return spark.table(name) if by else spark.read.parquet(at)


def release(spark: SparkSession) -> None:
    """Deletes the files of shuffles that no frame needs any more: Spark's cleaner does so once the driver's garbage is collected."""
    gc.collect()
    spark.sparkContext._jvm.java.lang.System.gc()

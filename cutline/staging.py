"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or the checkpoint folder of the context. Where neither is set a folder of our own, in local mode only: a cluster must name one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        named = tempfile.mkdtemp(prefix="spark-cutline-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def temporary(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that is deleted when the application ends."""
    path = f"{shared_folder(spark)}/cutline-{name}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def staged(df: DataFrame, tag: str) -> DataFrame:
    """df written to the shared folder and read again."""
    path = temporary(df.sparkSession, f"{tag}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

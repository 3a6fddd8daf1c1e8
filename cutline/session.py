"""Session settings that results depend on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def sound_unions(spark: SparkSession) -> None:
    """Have unions claim no partitioning of their own.

    With Spark 4.1.2's default a union of branches that are hash-partitioned alike claims that partitioning, and an aggregation or join on top is
    planned without an exchange; adaptive execution may coalesce the branches' shuffle partitions differently, and keys then meet in the wrong partitions. Earlier versions don't know the setting and ignore it.
    """
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")

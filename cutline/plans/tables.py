"""The given tables as series: which columns play element, position and score."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LINE_ORDER = ["l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", "l_quantity"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as series by part: l_partkey, pos, l_quantity, l_discount, l_tax."""
    pos = F.row_number().over(Window.partitionBy("l_partkey").orderBy(*LINE_ORDER)) - 1
    return table(spark, sf_dir, "lineitem").select("l_partkey", pos.cast("long").alias("pos"), "l_quantity", "l_discount", "l_tax")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as series by user: user_id, pos, event_id, ts, event_type, value."""
    pos = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return table(spark, sf_dir, "events").select("user_id", pos.cast("long").alias("pos"), "event_id", "ts", "event_type", "value")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as series by label: label, pos, vec_id, embedding."""
    pos = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1
    return table(spark, sf_dir, "embeddings").select("label", pos.cast("long").alias("pos"), "vec_id", "embedding")


def brand_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Response curves by brand: p_brand, setting (a quantity), score (percentage of the brand's lines with that quantity or more).

    Counted by (brand, quantity) first; the running sum is over at most one row for each quantity.
    """
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    counts = table(spark, sf_dir, "lineitem").select("l_partkey", "l_quantity").join(parts, F.col("l_partkey") == F.col("p_partkey")).groupBy("p_brand", F.col("l_quantity").alias("setting")).agg(F.count(F.lit(1)).alias("n"))
    down = Window.partitionBy("p_brand").orderBy(F.desc("setting"))
    return counts.select("p_brand", "setting", (100.0 * F.sum("n").over(down) / F.sum("n").over(Window.partitionBy("p_brand"))).alias("score"))


#: The same in DuckDB SQL, as common table expressions.
LINES_SQL = "l AS (SELECT l_partkey, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey, l_extendedprice, l_quantity) - 1 AS pos, l_quantity, l_discount, l_tax FROM lineitem)"
EVENTS_SQL = "e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, event_id, ts, event_type, value FROM events)"
VECTORS_SQL = "v AS (SELECT label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS pos, vec_id, embedding FROM embeddings)"
CURVES_SQL = (
    "cc AS (SELECT p_brand, l_quantity AS setting, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL), "
    "c AS (SELECT p_brand, setting, 100.0::DOUBLE * sum(n) OVER (PARTITION BY p_brand ORDER BY setting DESC) / sum(n) OVER (PARTITION BY p_brand) AS score FROM cc)"
)

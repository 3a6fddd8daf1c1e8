"""Connected components of an edge table, by alternating large and small stars.

Every round each node hands its larger neighbours (large star), then its smaller ones (small star), to the smallest node it knows. The edges
end as stars around the smallest node of each component after about log n rounds. A round is two aggregations and joins on the
edges; its result is written to the shared folder, so the plan does not grow and a lost executor costs one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cutline.session import sound_unions

from .common import written


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    if larger:
        seen = edges.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.a", "e.b")
    else:
        seen = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = seen.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    joined = seen.join(least, "a")
    if larger:
        out = joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.filter("a != b").distinct()


def components(edges: DataFrame, tag: str = "components", rounds: int = 60) -> DataFrame:
    """(node, component) of every node of edges (a, b): component is the smallest node reachable."""
    sound_unions(edges.sparkSession)
    now = written(edges.select("a", "b").filter("a != b").distinct(), f"{tag}-edges")
    before = None
    for k in range(rounds):
        now = written(_star(_star(now, True), False), f"{tag}-{k}")
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    leaves = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return leaves.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())

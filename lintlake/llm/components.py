"""Connected components of a distributed edge list, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintlake.llm.storage import forget, kept


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Point each node's larger (large) or smaller (small) neighbours, and itself, to the least node around it."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near = both if large else both.where("v < u")
    least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    met = near.join(least, "u")
    if large:
        return met.where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    own = least.where("u <> m").select("u", F.col("m").alias("v"))
    return met.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(own).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges`` (columns u, v) but the roots; a root is its component's least node.

    Each round writes its edges to the shared folder; rounds are few, about the logarithm of the longest path.
    """
    spark = edges.sparkSession
    now = kept(edges.select("u", "v").where("u <> v").distinct(), "edges")
    state = None
    while True:
        after = kept(_star(_star(now, True), False), "edges")
        sign = tuple(after.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v") % (1 << 40)), F.lit(0))).first())
        forget(spark, now)
        now = after
        if sign == state or not sign[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = sign

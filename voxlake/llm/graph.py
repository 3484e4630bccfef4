"""Connected components of distributed edge lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import write_table


def components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """edges(a long, b long) -> node, component (the least node reachable), for nodes that have an edge.

    Alternating large-star and small-star steps: each reconnects a node's neighbours to its least one, so the
    edges shrink to stars in a number of rounds that grows with the logarithm of the longest chain. Least
    neighbours are partial aggregates and rejoined, so a hub is never gathered into one task; every round is
    written to the shared folder.
    """
    spark = edges.sparkSession
    edges = write_table(spark, edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name)
    seen = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, F.col("u") == F.col("c")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), "m")
        small = large.join(down, F.col("u") == F.col("c")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        edges = write_table(spark, small.union(down.select(F.col("c").alias("u"), F.col("m").alias("v"))).distinct(), name)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())

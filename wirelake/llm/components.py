"""Connected components of an edge table, on the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirelake.llm.common import stage


def components(edges: DataFrame) -> DataFrame:
    """(node, label): label is the smallest node of the component. edges has the columns a and b, in any order.

    Alternates large-star and small-star steps until the edges are stars: each moves nodes to the
    smallest neighbour, so a few rounds do even for long paths. Nothing but a count reaches the driver.
    """
    now = stage(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while not is_stars(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(down.withColumnRenamed("m", "v"))
        now = stage(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    label = now.groupBy("u").agg(F.min("v").alias("label")).withColumnRenamed("u", "node")
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("label"))
    return label.unionByName(roots)


def is_stars(edges: DataFrame) -> bool:
    """Does every node that has a smaller neighbour have that one neighbour only?"""
    sides = edges.select(F.col("u").alias("node"), F.lit(1).alias("downs"), F.lit(0).alias("ups")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("downs"), F.lit(1).alias("ups")))
    return sides.groupBy("node").agg(F.sum("downs").alias("downs"), F.sum("ups").alias("ups")).where("downs > 1 or downs = 1 and ups > 0").isEmpty()

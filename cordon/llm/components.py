"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def components(edges: DataFrame, scratch: Scratch, max_rounds: int = 60) -> DataFrame:
    """Smallest reachable node of every node that has an edge.

    :param edges: columns a, b (long); order, repeats and loops don't matter.
    :return: node, root; one row per node of an edge, the root is the smallest node of its component.

    Each round is two aggregations by node and ends in a written table; a hub's edges are
    reduced map-side to the minimum, so no node's neighbours meet in one group.
    """
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, before = scratch.keep(now), []
    for _ in range(max_rounds):
        # every node that is some edge's larger end and some other's smaller end still has to move
        if now.join(now.select(F.col("b").alias("a")).distinct(), "a", "left_semi").isEmpty():
            break
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        scratch.drop(*before)
        before = [now]
        now = scratch.keep(small.where("a <> b").distinct())
    else:
        raise RuntimeError("components did not settle")
    low = now.groupBy("a").agg(F.min("b").alias("root"))
    return scratch.keep(low.withColumnRenamed("a", "node").unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()))

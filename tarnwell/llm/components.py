"""Connected components of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwell.llm.common import Workspace


def components(links: DataFrame) -> DataFrame:
    """node, root (smallest node reachable) of all nodes that have a link. links: a, b.

    Each step is a minimum by node and a join back to it; the links are never gathered.
    Rounds end when the links no longer change: their number grows with the logarithm of
    the longest path. Links of a node to itself and repeated links do no harm.
    """
    work = Workspace(links.sparkSession)  # of its own: the result is read as long as it is needed
    edges = work.table(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), "links0")
    for turn in count(1):
        both = edges.union(edges.select("v", "u"))
        # minima are written before they are joined back: a join of two exchanges can split a node with many links
        least = work.table(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = work.table(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        low = work.table(large.where("u > v").groupBy("u").agg(F.min("v").alias("m")), "low")
        small = large.where("u > v").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = work.table(small.union(low).where("u > v").distinct(), f"links{turn}")
        work.free("least", "large", "low", f"links{turn - 1}")
        # done when the links are stars: no node has two targets, and no target has one
        forked = edges.groupBy("u").count().where("count > 1").select("u")
        deep = edges.join(edges.select(F.col("u").alias("w")).distinct(), F.col("v") == F.col("w"), "left_semi").select("u")
        if not forked.union(deep).take(1):
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())

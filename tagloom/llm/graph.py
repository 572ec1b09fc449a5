"""Connected components of a link table, by min-label stars, entirely in joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm.staging import staged


def _toward_min(links: DataFrame) -> DataFrame:
    """One large-star and one small-star step over ``a > b`` links; fewer and shorter links remain."""
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
    # larger neighbours move to the smallest of the neighbourhood
    large = (links.select(F.col("b").alias("a"), F.col("a").alias("c")).join(low, "a")
             .select(F.col("c").alias("a"), F.col("low").alias("b")))
    # a node and its smaller neighbours move to the smallest of them
    least = large.groupBy("a").agg(F.min("b").alias("low"))
    small = large.join(least, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("low").alias("b"))
    return small.where("a != b").distinct()


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``links`` (``a, b``); the root is the smallest node it reaches.

    The number of steps grows with the logarithm of the longest path.  Every step is written out, so a
    lost executor costs one step.  It ends when no node that links point to has a link of its own and no
    node has two.
    """
    now = staged(links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
    done = now.isEmpty()
    while not done:
        now = staged(_toward_min(now))
        ends = now.select(F.col("a").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")).union(
            now.select(F.col("b").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("into")))
        busy = ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
        done = busy.where("out > 1 or out = 1 and into = 1").isEmpty()
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)

"""Connected components of an edge table, by alternating large-star and small-star steps.

Every step is a grouped minimum (combined before the shuffle, so a node with very many
neighbours is no hot group) and a join.  Each round's edges are written to the shared
folder; nothing is collected but the count of edges that still moved.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framescore.llm.tables import dropped, stored


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """Each node's neighbours (small: the lesser ones; else the greater) to its minimum."""
    both = edges if small else edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    joined = both.join(least, "u")
    if small:      # u > v throughout: v and u itself go to the minimum
        to = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v")))
    else:
        to = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return to.filter("u > v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, comp (its least reachable node) for every node of ``edges`` (a, b)."""
    now = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                 .filter("u > v").distinct(), "cc")

    def state(e: DataFrame):
        r = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        return r["n"], r["h"]

    before = state(now)
    while before[0]:
        following = stored(_star(_star(now, small=False), small=True), "cc")
        after = state(following)
        dropped(now)
        now = following
        if after == before:
            break
        before = after
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("comp"))
    return nodes.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("comp"))).distinct()

"""Connected components of a table of links, by alternating large-star and small-star steps.

Each step is an aggregation and a join over the links, written to the shared folder, so that lost executors cost a step
at most. The links end as stars around each component's smallest node; the number of rounds grows with the logarithm of
the longest path. No node's links are ever gathered in one place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varstrata.llm.common import stash


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component): every node that has a link to another node, and the smallest node of its component.

    links has columns a and b; direction, repeated links and links to oneself don't matter, null ends are ignored.
    """
    now = stash(links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before, state = None, _state(now)
    while state != before:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        down = stash(large.where(F.col("a") != F.col("b")).distinct(), "large-star")
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        now = stash(small.where(F.col("a") != F.col("b")).distinct(), "small-star")
        before, state = state, _state(now)
    ends = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return ends.unionByName(ends.select(F.col("component").alias("node"), "component").distinct())

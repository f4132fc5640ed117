"""Connected components of a table of links, by alternating large-star and small-star steps.

Each step hangs the neighbours of a node on the smallest of them (and itself): large-star the
larger neighbours, small-star the smaller ones. Links only shrink; the loop ends when a
round changes nothing, after a number of rounds logarithmic in the links. Steps are
a map-side minimum and an equi-join, so a node with very many links is split like any
skewed join and never collected. Lineage is cut by a checkpoint each round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from answerscope.session import checkpointed


def _both_ways(links: DataFrame) -> DataFrame:
    ends = F.explode(F.array(F.struct(F.col("a").alias("n"), F.col("b").alias("m")), F.struct(F.col("b").alias("n"), F.col("a").alias("m"))))
    return links.select(ends.alias("e")).select("e.n", "e.m")


def _hung(near: DataFrame, keep) -> DataFrame:
    """Every kept neighbour m of n linked to the smallest of n and its neighbours."""
    least = near.groupBy("n").agg(F.min("m").alias("least")).withColumn("least", F.least("least", "n"))
    return near.filter(keep).join(least, "n").select(F.col("least").alias("a"), F.col("m").alias("b"))


def components(links: DataFrame) -> DataFrame:
    """(node, component): every node of ``links`` (a, b) and the smallest node it reaches."""
    now = checkpointed(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct())
    while True:
        before = now
        large = _hung(_both_ways(now), F.col("m") > F.col("n")).filter("a < b").distinct()
        # small-star: n's smaller neighbours and n itself hang on the smallest of them
        down = large.select(F.col("b").alias("n"), F.col("a").alias("m"))
        least = down.groupBy("n").agg(F.min("m").alias("least"))
        moved = down.join(least, "n").select(F.col("least").alias("a"), F.col("m").alias("b"))
        own = least.select(F.col("least").alias("a"), F.col("n").alias("b"))
        now = checkpointed(moved.unionByName(own).filter("a < b").distinct())
        if now.exceptAll(before).isEmpty() and before.exceptAll(now).isEmpty():
            break
    roots = now.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    return now.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(roots)

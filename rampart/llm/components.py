"""Connected components by alternating large-star and small-star steps over a table of links.

Each step is a grouped minimum and a join, so no node's links meet in one group,
and its links are written to the shared folder. The number of steps grows with
the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def _large(links: DataFrame) -> DataFrame:
    both = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = down.groupBy("a").agg(F.min("b").alias("m"))
    return down.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(low.select("a", F.col("m").alias("b")))


def components(links: DataFrame) -> DataFrame:
    """node and component (the smallest node reachable) of every node of links (a, b)."""
    clean = lambda df: df.where("a <> b").distinct()
    held = materialise(clean(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))), "links")
    seen = None
    while True:
        held = materialise(clean(_small(clean(_large(held)))), "links")
        now = held.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            return held.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(held.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
        seen = now

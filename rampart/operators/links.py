"""Sources that names link, of events with any number of sources: components by star contraction, without pairs.

A name of k sources links each of them to its first, which makes k - 1 edges. Large-star and small-star steps turn the
edges into stars; each is a grouped minimum and a join, and no source's edges meet in one group. Edges are written to
the shared folder after each round, and rounds grow with the logarithm of the longest path.

Defined cases: a source without names is a component of its own; repeated rows count once; a null source or name links
nothing, and a null event has its own sources; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import materialised


def name_edges(names: DataFrame, key: list[str], source: str, name: str) -> DataFrame:
    """key, a, b: each source with a name to the first source with it. names: key, source, name."""
    held = names.where(F.col(source).isNotNull() & F.col(name).isNotNull()).select(*key, F.col(source).alias("b"), F.col(name).alias("_name")).distinct()
    first = held.groupBy(*key, "_name").agg(F.min("b").alias("a"), F.max("b").alias("_last")).where("a < _last").drop("_last")
    keyed = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in (*key, "_name")]
    met = held.alias("l").join(first.alias("r"), keyed)
    return met.where("b > a").select(*(F.col(f"l.{k}").alias(k) for k in key), "a", "b").distinct()


def _joined(edges: DataFrame, low: DataFrame, key: list[str]) -> DataFrame:
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in (*key, "a")]
    return edges.alias("l").join(low.alias("r"), same).select(*(F.col(f"l.{k}").alias(k) for k in key), F.col("l.b").alias("b"), F.col("m"))


def _round(edges: DataFrame, key: list[str]) -> DataFrame:
    """One large-star and one small-star step of edges (key, a < b)."""
    turned = edges.select(*key, F.col("b").alias("a"), F.col("a").alias("b"))
    both = edges.unionByName(turned)
    low = both.groupBy(*key, "a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    large = _joined(both.where("b > a"), low, key).select(*key, F.col("m").alias("a"), "b").where("a < b").distinct()
    # From each node to its least neighbour, and of its other lesser ones to that.
    down = large.select(*key, F.col("b").alias("a"), F.col("a").alias("b"))
    least = down.groupBy(*key, "a").agg(F.min("b").alias("m"))
    small = _joined(down, least, key).select(*key, F.col("m").alias("a"), "b").where("a < b")
    return small.unionByName(least.select(*key, F.col("m").alias("a"), F.col("a").alias("b"))).distinct()


def components(edges: DataFrame, key: list[str]) -> DataFrame:
    """key, node, root: the least node of each edge's component. edges: key, a < b."""
    held = materialised(edges, "edges")
    seen = None
    while True:
        now = tuple(held.agg(F.count("*"), F.sum(F.xxhash64(*key, "a", "b").cast("decimal(38,0)"))).first())
        if now == seen or not now[0]:
            break
        seen, held = now, materialised(_round(held, key), "edges")
    ends = held.select(*key, F.col("b").alias("node"), F.col("a").alias("root"))
    return ends.unionByName(held.select(*key, F.col("a").alias("node"), F.col("a").alias("root")).distinct())


def largest_linked(sources: DataFrame, names: DataFrame, key: list[str], source: str, name: str) -> DataFrame:
    """key, sources (how many) and largest (how many are in the largest group that names link) of each event."""
    roots = components(name_edges(names, key, source, name), key)
    sizes = roots.groupBy(*key, "root").agg(F.count("*").alias("_k")).groupBy(*key).agg(F.max("_k").alias("_k"))
    own = sources.where(F.col(source).isNotNull()).select(*key, source).distinct().groupBy(*key).agg(F.count("*").alias("sources"))
    met = own.alias("l").join(sizes.alias("r"), [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in key], "left")
    return met.select(*(F.col(f"l.{k}").alias(k) for k in key), "sources", F.coalesce("_k", F.lit(1)).cast("long").alias("largest"))

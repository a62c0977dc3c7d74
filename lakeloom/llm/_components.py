"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._stage import Stage


def _stars(pairs: DataFrame) -> DataFrame:
    """pairs (u, v) with m, the least v of u."""
    return pairs.join(pairs.groupBy("u").agg(F.min("v").alias("m")), "u")


def _large(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _stars(both).filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    starred = _stars(edges)
    return starred.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(starred.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, stage: Stage) -> DataFrame:
    """(node, component) of every node in the edges (a, b); component is the least node reachable.

    Each round is written to the shared folder, so plans stay short. Rounds grow with the
    logarithm of the component size. Nodes without edges are not listed; null ends are dropped.
    """
    now = stage.keep(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = None
    while True:
        sums = now.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long")), F.sum(F.xxhash64("u", "v") % 1_000_000_007)).first()
        if sums == mark or not sums[0]:
            break
        mark = sums
        larger = stage.keep(_large(now))
        stage.drop(now)
        now = stage.keep(_small(larger))
        stage.drop(larger)
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()

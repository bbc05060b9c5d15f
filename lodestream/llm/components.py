"""Connected components of a link table by alternating large-star and small-star rounds.

Kiveris et al., 2014. Links never leave the cluster; each round is checkpointed, and the rounds end
when a round changes nothing. The number of rounds grows with the logarithm of a component's width.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

ROWS_PER_PART = 100_000


def _fingerprint(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum((F.xxhash64("u", "v") / 65536).cast("decimal(38,0)"))).first())


def _large_star(edges: DataFrame, parts: int) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).coalesce(parts)
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")).coalesce(parts)
    moved = both.filter(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.coalesce(parts).distinct().coalesce(parts)


def _small_star(edges: DataFrame, parts: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v")
    least = down.groupBy("u").agg(F.min("v").alias("m")).coalesce(parts)
    moved = down.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).coalesce(parts)
    return moved.union(least.select("u", F.col("m").alias("v"))).coalesce(parts).distinct().coalesce(parts)


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of ``links`` (u, v); component is the least node.

    The tables of a round get a partition for every ``ROWS_PER_PART`` links, so that few links don't
    leave a file in each of many shuffle partitions.
    """
    edges = checkpointed(links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = _fingerprint(edges)
    parts = before[0] // ROWS_PER_PART + 1
    edges = edges.coalesce(parts)
    while before[0]:
        edges = checkpointed(_small_star(_large_star(edges, parts), parts))
        after = _fingerprint(edges)
        if after == before:
            break
        before = after
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct().coalesce(parts)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots).coalesce(parts)

"""Connected components of links, in rounds that grow with the logarithm of the longest chain."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tasklode.session import cut

MOST_ROUNDS = 80


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node (long) that a link joins to another; root is the least node of its component.

    Alternating stars: every node hands its greater neighbours to the least of all, then its lesser ones and itself to
    the least of these. Each round is a checkpoint; only a count and a checksum of the links reach the driver. Links
    may repeat or point from a node to itself; such a node alone has no row.
    """
    x, y = F.col(a), F.col(b)
    edges = cut(links.filter(x != y).select(F.greatest(x, y).alias("high"), F.least(x, y).alias("low")).distinct())
    before = None
    for _ in range(MOST_ROUNDS):
        now = tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("high", "low"))).first())
        if now == before:
            return edges.select(F.col("high").alias("node"), F.col("low").alias("root")).unionByName(edges.select(F.col("low").alias("node"), F.col("low").alias("root")).distinct())
        before = now
        both = edges.unionByName(edges.select(F.col("low").alias("high"), F.col("high").alias("low")))
        least = both.groupBy("high").agg(F.least(F.min("low"), F.first("high")).alias("top")).withColumnRenamed("high", "hub")
        greater = both.filter("low > high").select(F.col("high").alias("hub"), F.col("low").alias("high"))
        large = greater.join(least, "hub").filter("high <> top").select("high", F.col("top").alias("low")).distinct()
        down = large.groupBy("high").agg(F.min("low").alias("top"))
        lesser = large.join(down, "high").filter("low <> top").select(F.col("low").alias("high"), F.col("top").alias("low"))
        edges = cut(lesser.unionByName(down.select("high", F.col("top").alias("low"))).distinct())
    raise RuntimeError(f"components didn't settle in {MOST_ROUNDS} rounds")

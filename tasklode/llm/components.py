"""Connected components of links, by alternating large and small stars.

Every round is written to the shared folder, which cuts the lineage; the driver only learns whether
a node with two roots is left. The rounds grow with the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tasklode.llm.common import dropped, written

MOST_ROUNDS = 60


def _pairs(first: tuple[str, str], second: tuple[str, str], names: tuple[str, str]):
    """Two rows of two columns, for each row."""
    return F.inline(F.array(*(F.struct(*(F.col(c).alias(n) for c, n in zip(x, names, strict=True))) for x in (first, second))))


def _least(edges: DataFrame) -> DataFrame:
    """(node, root, top): the least and the greatest of the lesser neighbours of each node; its own number, of one
    with greater ones, counts too. They differ unless all edges lead to nodes that have no lesser neighbour, one from each."""
    ends = edges.select(_pairs(("a", "b"), ("b", "b"), ("node", "root")))
    return written(ends.groupBy("node").agg(F.min("root").alias("root"), F.max("root").alias("top")), "roots")


def _stars(edges: DataFrame, least: DataFrame) -> DataFrame:
    """The edges (a, b), a >= b, after a large and a small star; they become no more, and may repeat."""
    # large star: greater neighbours move to the least neighbour
    moved = edges.join(least.select(F.col("node").alias("b"), "root"), "b").select("a", F.col("root").alias("b"))
    large = moved.repartition("a").distinct()
    # small star: lesser neighbours, and the node (in place of the least one), move to the least of them
    down = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u")
    small = large.join(down, F.col("a") == F.col("u"))
    return written(small.select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")), "stars")


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node that some link (a, b) has; root is the least node it can reach.

    The result is a written table. Links may repeat, be given in either direction or from a node to itself. No links, no rows.
    """
    given = links.filter("a IS NOT NULL AND b IS NOT NULL")
    edges = written(given.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), "edges")
    for _ in range(MOST_ROUNDS):
        least = _least(edges)
        if least.filter("root <> top").isEmpty():
            break
        last, edges = edges, _stars(edges, least)
        dropped(last, least)
    else:
        raise RuntimeError(f"components didn't settle in {MOST_ROUNDS} rounds")
    dropped(edges)
    out = least.select("node", "root")
    out.written_to = least.written_to
    return out

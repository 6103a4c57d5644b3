"""Connected components of a graph given by edges, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callweave.llm.support import save

MAX_ROUNDS = 60  # a guard against a fault; the number of rounds grows with the logarithm of the longest path


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``edges`` (``a, b``, both long): the smallest node reachable.

    Each step replaces a node's neighbours by links to the smallest of them, until every component is a star. Neighbours
    are reduced by partial aggregation before they are shuffled, and joined back by a join that Spark can split, so that
    a node with any number of neighbours is never gathered. Every round is written to the shared folder. Loops, repeated
    edges and an empty table are allowed; a row with a null is ignored.
    """
    links = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    links = save(links.distinct(), "links")
    before = _mark(links)
    for _ in range(MAX_ROUNDS):
        links = save(_small_star(_large_star(links)), "links")
        after = _mark(links)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    roots = links.select(F.col("v").alias("node")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component"))
    )


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    below = links.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return below.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _mark(links: DataFrame) -> tuple:
    """Count and order-free hash of the edges: equal marks mean that a round changed nothing."""
    row = links.agg(F.count("u"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first()
    return tuple(row)

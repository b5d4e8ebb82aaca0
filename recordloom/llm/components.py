"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.llm.tables import written

MAX_ROUNDS = 100


def _distinct_links(links: DataFrame) -> DataFrame:
    """Each link once, from the larger node to the smaller one."""
    return (
        links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .where(F.col("a") != F.col("b"))
        .distinct()
    )


def _to_least_neighbour(links: DataFrame, both_ways: bool) -> DataFrame:
    """Neighbours of a node are linked to the least of them (and the node) instead.

    With ``both_ways`` those larger than the node are, otherwise those smaller than it and the node itself: the large
    and small star operations of connected components in MapReduce. The least neighbour comes from a pre-aggregated
    minimum and is joined back, so that a node with very many links is never gathered.
    """
    if both_ways:
        around = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = around.groupBy("a").agg(F.min("b").alias("least")).select("a", F.least("a", "least").alias("least"))
        return around.where(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    least = links.groupBy("a").agg(F.min("b").alias("least"))
    return links.join(least, "a").select("b", "least").union(least.select("a", "least")).toDF("a", "b")


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``root``, the least node of its component, for every node that is not its own root.

    ``links`` has two columns ``a`` and ``b`` of one ordered type; direction, repeats and links of a node to itself
    don't matter. Every round is written to the shared folder, so that lost executors cost at most one round.
    """
    links = written(_distinct_links(links), "links")
    seen = None
    for _ in range(MAX_ROUNDS):
        state = tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a") % 1000003)).first())
        if state == seen or not state[0]:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = state
        large = _distinct_links(_to_least_neighbour(links, True))
        links = written(_distinct_links(_to_least_neighbour(large, False)), "links")
    raise RuntimeError(f"no fixed point after {MAX_ROUNDS} rounds")

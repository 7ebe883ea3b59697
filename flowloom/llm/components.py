"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.session import materialise


def _star(links: DataFrame) -> DataFrame:
    """Least neighbour of each node, itself included."""
    return links.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def _signature(links: DataFrame) -> tuple:
    """Equal for equal sets of links."""
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """``node, root`` for every node of ``edges``: root is the least node reachable.

    Each round is two joins on a node and its least neighbour; no neighbour list is ever gathered, so a hub costs rows,
    not memory. Rounds write their links to the shared folder; the driver sees a count and a sum of the links.
    """
    links = edges.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    links = materialise(links, "links")
    before = _signature(links)
    for _ in range(max_rounds):
        # Large star: every greater neighbour of a node goes to the node's least neighbour.
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_star(both), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialise(large.filter("u != v").distinct(), "large")
        # Small star: every lesser neighbour of a node, and the node, go to the least of them.
        least = _star(large)
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(least.select("u", F.col("m").alias("v")))
        links = materialise(small.filter("u != v").distinct(), "links")
        now = _signature(links)
        if now == before:
            return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        before = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")

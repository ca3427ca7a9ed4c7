"""Connected components of links between long ids, as a few rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlake.llm.common import forget, stored


def components(links: DataFrame, label: str) -> DataFrame:
    """(id, root) for every id in `links` (a, b); root is the smallest id of the component.

    Alternating stars: each id hands its larger neighbours to its smallest one, then its smaller
    neighbours. The links shrink to one star for each component; a round is two aggregates and two
    joins, and the number of rounds grows with the logarithm of the longest chain. Nothing but the
    size and a checksum of the links comes to the driver.
    """
    pairs = links.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).where("u < v").distinct()
    edges, seen = stored(pairs, label), None
    while (now := _checksum(edges)) != seen:
        seen = now
        both = edges.select(F.col("u").alias("x"), F.col("v").alias("y")).union(edges.select("v", "u"))
        least = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"))
        large = both.where("y > x").join(least, "x").select(F.col("m").alias("u"), F.col("y").alias("v")).distinct()
        smallest = large.groupBy("v").agg(F.min("u").alias("m"))
        inner = large.join(smallest, "v").where("u > m").select(F.col("m").alias("u"), F.col("u").alias("v"))
        after = stored(inner.union(smallest.select(F.col("m").alias("u"), "v")).distinct(), label)
        forget(edges)
        edges = after
    stars = edges.select(F.col("v").alias("id"), F.col("u").alias("root"))
    return stars.union(edges.select(F.col("u").alias("id"), F.col("u").alias("root")).distinct())


def _checksum(edges: DataFrame):
    return edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first()

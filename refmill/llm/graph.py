"""Connected components of an edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import drop, stored


def components(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """(id, component) of every end of ``edges`` (a, b): the smallest id that links reach.

    Each round hangs every node's larger neighbours, then its smaller ones, on the smallest it knows. Minima are
    aggregated before they are shuffled, and joins carry one row a node, so a hub's edges can be split. The number
    of rounds grows with the logarithm of the longest path; the first half of a round also sees whether all is done.
    Null ends and loops are left out; edges may repeat. ``rows``: about how many edges there are at most, if known.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u is not null and v is not null and u <> v")
    both_ways = 2 * rows if rows is not None else None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        seen = Observation()
        # Stars: no node that others hang on hangs itself, and none hangs on two.
        hung = both.join(low, "u").observe(seen, F.count_if(F.expr("(v > u and m < u) or (v < u and v <> m)")).alias("open"))
        large = stored(hung.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")), "large-star", both_ways)
        if not seen.get.get("open"):
            return _labels(large)
        drop(e)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        e = stored(small.unionByName(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct(), "small-star", both_ways)
        drop(large)


def _labels(stars: DataFrame) -> DataFrame:
    """Of stars, each node's centre, itself for a centre; stars may repeat an edge."""
    one = stars.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return one.unionByName(stars.select(F.col("v").alias("id"), F.col("v").alias("component"))).distinct()

"""Connected components of a link table, in rounds of joins with a checkpoint after each."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import cut


def _neighbours(e: DataFrame) -> DataFrame:
    return e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _stars(pairs: DataFrame, smallest: DataFrame) -> DataFrame:
    """Every right end of a pair linked to the smallest node around its left end."""
    near = pairs.join(smallest, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return near.filter("u <> v")


def components(links: DataFrame) -> DataFrame:
    """``node``, ``comp`` (the smallest node of its component) for all nodes of ``links`` (``a``, ``b``).

    Rounds of large and small stars: each node's larger neighbours, then its smaller ones, are linked to the smallest node around it.
    The rounds end when no link changes; their number grows with the logarithm of the longest chain. Minima are combined
    before the shuffle and joined back, so that a hub with a third of all links is split by adaptive execution.
    """
    e = links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    seen, e = None, cut(e)
    while True:
        state = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == seen:
            break
        seen = state
        both = _neighbours(e)
        smallest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = _stars(both.filter("v > u"), smallest).distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        e = cut(_stars(large, lower).union(lower.select("u", F.col("m").alias("v"))).distinct())
    return e.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(e.select(F.col("v").alias("node"), F.col("v").alias("comp"))).distinct()

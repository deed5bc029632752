"""Connected components of a graph given by its links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verseflux.lineage import cut_lineage
from verseflux.llm.common import release


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and ``component`` (smallest node reachable) of every node that has a link.

    Alternating stars: first every node hands its larger neighbours to its smallest one, then
    its smaller neighbours and itself; both keep components and shorten paths, until every node
    is linked with the smallest one alone. Each step is an aggregation to one row per node and
    a join, so that a hub needs no group of its own; the number of steps grows with the
    logarithm of the longest path.
    """
    links = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    links = cut_lineage(links)
    before = None
    while True:
        both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        least = least.select(F.col("u").alias("w"), "m")
        large = both.join(least, F.col("u") == F.col("w")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = cut_lineage(large.where("u <> v").distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), "m")
        met = large.join(least, F.col("u") == F.col("w"))
        small = met.select(F.col("v").alias("u"), F.col("m").alias("v")).union(met.select("u", F.col("m").alias("v")))
        links = cut_lineage(small.where("u <> v").distinct())
        state = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        release(links.sparkSession)  # of every step the plans and shuffle files are garbage now
        if state == before:
            break
        before = state
    leaves = links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return leaves.union(roots)

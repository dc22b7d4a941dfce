"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qualframe.llm.common import stored


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``id`` and ``component`` (the smallest id reachable) of every id that has a link to another one.

    Each round first points the larger neighbours of an id to its smallest neighbour, then an id and its smaller neighbours
    to the smallest of them; after a number of rounds that grows with the logarithm of the longest chain only
    stars are left. Smallest neighbours come from a grouped minimum, combined before the shuffle, and a join,
    whose skewed keys Spark splits; no id gathers its neighbours in one place. Each round is written and read again.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    edges, before = stored(edges, "links"), None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(
                edges.select("v", "v").distinct())
        before = state
        both = edges.union(edges.select("v", "u"))
        smallest = both.groupBy(F.col("u").alias("s")).agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(smallest, F.col("u") == F.col("s")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy(F.col("u").alias("s")).agg(F.min("v").alias("m"))
        small = large.join(least, F.col("u") == F.col("s")).select("u", "v", "m")
        edges = stored(small.select("u", F.col("m").alias("v")).union(small.where("v <> m").select("v", "m")).distinct(), "links")

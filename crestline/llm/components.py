"""Connected components of a table of links."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .storage import written


def connected_components(links: DataFrame) -> DataFrame:
    """(id, component) for every end of ``links`` (a, b): component is the smallest id that links reach.

    Alternates two steps until nothing changes: every larger neighbour of a node is linked to the node's smallest
    neighbour, then every smaller one is. Links turn into stars around the smallest ids in a number of rounds that grows
    with the logarithm of the number of nodes. Minima are pre-aggregated; each round is written to the shared folder.
    Links with a null end are left out, links of a node with itself give it its own id at least.
    """
    ends = links.select(F.col("a").alias("u"), F.col("b").alias("v")).where("u IS NOT NULL AND v IS NOT NULL")
    edges = written(ends.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u")
        edges = written(small.select("u", F.col("m").alias("v")).unionByName(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct(), "links")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    found = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    roots = found.select(F.col("component").alias("id"), "component").distinct()
    alone = ends.where("u = v").select(F.col("u").alias("id"), F.col("u").alias("component"))
    return found.unionByName(roots).unionByName(alone).groupBy("id").agg(F.min("component").alias("component"))

"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coordlytics.llm.store import stored


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id that each node with an edge reaches. ``edges`` has columns a and b.

    Every step is a minimum per node (summed map-side) and a join, so a node with any number of edges
    is no group in one task. Nodes without an edge do not appear; an edge with a null or to
    itself links nothing.
    """
    a, b = F.col("a"), F.col("b")
    links = stored(
        edges.filter(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), "links")
    while not _is_stars(links):
        both = links.unionByName(links.select(b.alias("a"), a.alias("b")))
        lowest = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"))
        large = both.join(lowest, "a").filter(b > a).select(b.alias("a"), F.col("low").alias("b"))
        lowest = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(lowest, "a").filter(b != F.col("low")).select(b.alias("a"), F.col("low").alias("b"))
        links = stored(small.unionByName(lowest.withColumnRenamed("low", "b")).distinct(), "links")
    stars = links.withColumnsRenamed({"a": "id", "b": "component"})
    return stars.unionByName(stars.select(F.col("component").alias("id"), "component").distinct())


def _is_stars(links: DataFrame) -> bool:
    """Every node points to one other at most, and none that is pointed to points on."""
    ends = links.select(F.col("a").alias("id"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(
        links.select(F.col("b").alias("id"), F.lit(0).alias("out"), F.lit(1).alias("into")))
    odd = ends.groupBy("id").agg(F.sum("out").alias("out"), F.max("into").alias("into")).filter("out + into > 1")
    return odd.isEmpty()

"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(links: DataFrame) -> DataFrame:
    """(key, component) of every key in links (a, b); a component's name is its smallest key.

    Alternates the large-star and small-star steps until every key has one link, to a key without links of its own; each step is
    grouped and joined by key, and a table is written after each round. Both steps only take minima, so a hub of many links needs no list of them.
    """
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    while not _stars(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        near = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        edges = written(near.where("u <> v").distinct(), "edges")
    return edges.select(F.col("u").alias("key"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("key"), F.col("v").alias("component")).distinct())


def _stars(edges: DataFrame) -> bool:
    ends = edges.select(F.col("u").alias("k"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("k"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    per = ends.groupBy("k").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return not per.where("up > 1 or (up = 1 and down = 1)").limit(1).count()

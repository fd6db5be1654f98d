"""Connected components by alternating large-star and small-star rounds, each staged in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, staged


def connected_components(edges: DataFrame, tag: str = "cc") -> DataFrame:
    """edges(a long, b long) -> (node, component): every node of an edge that links different nodes, and the smallest
    node that it reaches. Null ends and loops are ignored; an empty table gives an empty one.
    """
    links = edges.where("a is not null and b is not null and a <> b")
    links = staged(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), tag)
    while True:
        if _is_star_forest(links):
            break
        before, links = links, staged(_small_star(_large_star(links)), tag)
        discard(before)
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).union(links.select("v", "v").distinct())


def _is_star_forest(links: DataFrame) -> bool:
    """Each u > v has one v, and no v is a u."""
    sides = links.select(F.col("u").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(links.select("v", F.lit(0), F.lit(1)))
    bad = sides.groupBy("n").agg(F.sum("up").alias("ups"), F.max("down").alias("down")).where("ups > 1 or (ups = 1 and down = 1)")
    return bad.limit(1).count() == 0


def _large_star(links: DataFrame) -> DataFrame:
    both = links.union(links.select("v", "u"))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    joined = links.join(least, "u")
    moved = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()

"""Connected components by alternating large and small stars, as Spark joins over written edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxsift.llm.common import written


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of edges (a, b): root is the smallest node that links reach.

    Each round points nodes at smaller neighbours; the number of rounds grows with the logarithm of the longest chain.
    A node with very many links is summed map-side and joined between written tables, where Spark splits large keys.
    """
    stars = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    n = 2 * stars.count()  # no later table has more rows
    while not _settled(stars):
        both = stars.union(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "star-low", n)
        large = both.join(low, "u").where("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = written(large.distinct(), "star-large", n)
        least = written(large.groupBy("u").agg(F.min("v").alias("m")), "star-least", n)
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        stars = written(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "star-small", n)
    roots = stars.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return written(roots.union(stars.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct(), "roots", n)


def _settled(stars: DataFrame) -> bool:
    """Every node points at one other, and nothing points at a node that points further."""
    roots = stars.select(F.col("v").alias("u")).distinct()
    twice = stars.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").select("u")
    return stars.select("u").join(roots, "u", "left_semi").union(twice).isEmpty()

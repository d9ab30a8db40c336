"""Connected components of a link table by repeated star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.session import stored


def _settled(pairs: DataFrame) -> bool:
    """Whether the links (a, b) are stars: every a has one b, and no b is an a."""
    ends = pairs.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(pairs.select("b", F.lit(0), F.lit(1)))
    nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return nodes.agg(F.count_if((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0)))).first()[0] == 0


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b); the component is its smallest node.

    Alternates large-star and small-star steps (each keeps connectivity and moves
    links towards the smallest node) until all links are stars around smallest nodes:
    a number of rounds that grows as the logarithm of the nodes.  Each step groups by a
    node with ``min`` alone, which combines before the shuffle, and joins back, so
    a node with very many links is split by the skewed join.  Every round is
    stored: read again in a few tasks, however many wrote it.
    """
    pairs = stored(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while not _settled(pairs):
        # large star: every larger neighbour of a node goes to the smallest one around it
        both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        pairs = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        # small star: every smaller neighbour of a node, and itself, to the smallest one
        low = pairs.groupBy("a").agg(F.min("b").alias("low"))
        joined = pairs.join(low, "a")
        pairs = stored(joined.select(F.col("b").alias("a"), F.col("low").alias("b")).union(low.select("a", F.col("low").alias("b")))
                            .where("a <> b").distinct())
    star = pairs.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return star.union(pairs.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())

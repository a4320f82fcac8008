"""Connected components of a link table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.session import cut_lineage


def _stars(links: DataFrame, larger: bool) -> DataFrame:
    """One step over links (a, b), a > b: every node's neighbours are linked to the smallest of them and itself.

    ``larger`` relinks the neighbours above each node, else those below it and the node.
    """
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))) if larger else links
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    joined = both.join(least, "a")
    if larger:
        moved = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return moved.where("a > b").distinct()


def _is_forest(links: DataFrame) -> bool:
    """Every node has one link down at most, and what it leads to has none: the links are stars."""
    ends = links.select(F.col("a").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(
        links.select(F.col("b").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    return ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up")).where("down + up > 1 and down > 0").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """node, root (the component's smallest node) of every linked node but the roots; links have columns a and b.

    The number of rounds grows with the logarithm of the longest chain. Each round is written to the shared folder.
    """
    links = cut_lineage(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct())
    while not _is_forest(links):
        links = cut_lineage(_stars(_stars(links, True), False))
    return links.select(F.col("a").alias("node"), F.col("b").alias("root"))

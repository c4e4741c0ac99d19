"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallygrid.llm.textkit import stored


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b): root is the smallest node it is connected with.

    Each step re-links neighbours to their smallest neighbour, so paths shrink by a constant factor; the links of a step are
    written out and read again. Nodes may be of any sortable type. No links give no rows.
    """
    now = stored(_pairs(links.select("a", "b")), "links")
    last = None
    while last != (state := _state(now)):
        last = state
        both = now.union(now.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        large = both.join(low, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("low").alias("b"))
        large = stored(_pairs(large), "links")
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a")
        now = stored(_pairs(small.select(F.col("b").alias("a"), F.col("low").alias("b")).union(low)), "links")
    roots = now.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())


def _pairs(links: DataFrame) -> DataFrame:
    """Distinct links from the larger to the smaller node, without loops."""
    return links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _state(links: DataFrame) -> tuple:
    row = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)

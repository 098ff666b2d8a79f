"""Connected components of a table of links, by alternating large and small stars (Kiveris et al. 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaytrail.llm.common import stored


def _hang(links: DataFrame, upward: bool) -> DataFrame:
    """Hangs neighbours on the smallest one. ``upward``: larger neighbours of each node, else smaller ones and the node."""
    if upward:
        both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
        root = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        return both.filter("v > u").join(root, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()
    # every link has a < b: b's smaller neighbours and b itself go to the smallest of them
    root = links.groupBy("b").agg(F.min("a").alias("m"))
    moved = links.join(root, "b").filter("a > m").select(F.col("m").alias("a"), F.col("a").alias("b"))
    return moved.union(root.select(F.col("m").alias("a"), "b")).distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node that can be reached, for every node of a link (a, b); one node alone has no row.

    Each round is written to the shared folder and compared with the one before by number and sum of hashes of its links.
    """
    now = stored(links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")

    def state(frame: DataFrame):
        return tuple(frame.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    before = state(now)
    while before[0]:
        now = stored(_hang(_hang(now, True), False), "links")
        after = state(now)
        if after == before:
            break
        before = after
    return now.select(F.col("b").alias("node"), F.col("a").alias("root")).union(now.select(F.col("a"), F.col("a")).distinct())

"""Connected components of a table of links, by alternating stars, in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modelloom.llm.common import dropped, released, saved


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Links each node's neighbours to the least of them and itself: those above the node, or those below and itself."""
    if large:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        met = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        met = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return met.filter("a != b").distinct()


def components(links: DataFrame) -> DataFrame:
    """links: a, b (64-bit nodes). One row for each node but the least of its component: node, root (that least node)."""
    now = saved(links.filter("a != b").select("a", "b").distinct(), "links")
    seen = None
    while True:
        nxt = saved(_star(_star(now, True), False), "links")
        dropped(now)
        now = nxt
        at = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        released(now.sparkSession)
        if at == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = at

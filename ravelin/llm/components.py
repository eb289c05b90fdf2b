"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravelin.llm.scratch import drop, table


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Hangs the neighbours of every node (large: the greater ones, else the smaller ones) on its least neighbour."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    if not large:
        both = both.where("b < a")
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    hung = both.join(least, "a")
    if large:
        out = hung.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = hung.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.select("a", F.col("m").alias("b"))
        )
    return out.where("a <> b").distinct()


def roots(links: DataFrame) -> DataFrame:
    """node and root for every node of links (a, b), root being the least node reachable.

    links: two columns a and b of one ordered type, in any direction, repeats
    and loops allowed. Nodes that only loop have no row. Each round's links
    are a table in the shared folder, and the table before goes; the rounds end when they stay the same,
    after about the logarithm of the longest chain.
    """
    now = table(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    seen = None
    while True:
        mark = now.select(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        seen, before = mark, now
        now = table(_star(_star(now, large=True), large=False), "links")
        drop(before)

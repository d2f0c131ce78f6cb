"""Connected components by alternating large-star and small-star rounds.

Each round is two aggregates and two joins over the remaining links, which are
written to the shared folder; a node with a third of all links is pre-aggregated
in the one and split by AQE in the other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import discard, join_even, materialize


def _star(links: DataFrame, small: bool) -> DataFrame:
    """One round over links (a, b): neighbours of each node move to the smallest of them."""
    if small:
        out = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    else:
        out = links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    low = out.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    both = join_even(out, low, ["u"])
    if small:  # also the node itself moves
        moved = both.select(F.col("v").alias("a"), F.col("m").alias("b")).union(low.select(F.col("u").alias("a"), F.col("m").alias("b")))
    else:
        moved = both.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return moved.filter("a <> b").distinct()


def _stars(links: DataFrame) -> bool:
    """Whether every node hangs on one node only, which hangs on none."""
    per = links.groupBy("a").agg(F.count("*").alias("n"))
    if not per.filter("n > 1").isEmpty():
        return False
    return join_even(links.select(F.col("b").alias("a")).distinct(), per, ["a"]).isEmpty()


def components(links: DataFrame) -> DataFrame:
    """Per node of the links (a, b): node and component, the smallest node reachable.

    Repeated links, both directions of one, and links of a node with itself
    change nothing; links with a null end are left out; without links there are
    no rows, and a node without links has none.
    """
    now = materialize(links.filter("a IS NOT NULL AND b IS NOT NULL").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "links")
    while not _stars(now):
        after = materialize(_star(_star(now, small=False), small=True), "links")
        discard(now)
        now = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b").distinct())

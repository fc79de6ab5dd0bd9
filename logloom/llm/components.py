"""Connected components of a link table, by alternating stars.

Links may be repeated, and in either direction; links of a node to itself, and links with a null end, are none. An empty
table has no components.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.session import settle


def star(links: DataFrame, large: bool) -> DataFrame:
    """Link each node's larger (or smaller) neighbours to the smallest node near it.

    The minimum is aggregated where links are read, and links come back to it by a join that
    can be split, so a node with a third of all links is no group in one task.
    """
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    near = both.join(least, "a")
    if large:
        out = near.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = near.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.where("a != b").distinct()


def components(links: DataFrame) -> DataFrame:
    """`node` and `root`, the smallest node of its component, of each node in `links` (a, b) that isn't its own root."""
    links = settle(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct())
    state = None
    while True:
        found = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(found) == state or not found[0]:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = tuple(found)
        links = settle(star(star(links, large=True), large=False))

"""Connected components of a link table, wholly distributed.

Alternates large-star and small-star steps (Kiveris et al., "Connected Components in MapReduce and Beyond", 2014).
Every step is an aggregation combined before its shuffle and a join with its result. That result, a row a node, is stored first, so both
sides of the join are plain exchanges and Spark may split a hub's partition; the rows of a hub stream through the join and are never held together.
Each round's links are written to the shared folder. Long texts play no part here: a node is a number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, stored


def _downwards(links: DataFrame) -> DataFrame:
    return links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _large_star(links: DataFrame, rows: int) -> DataFrame:
    both = links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = stored(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least", rows)
    return _downwards(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")))


def _small_star(links: DataFrame, rows: int) -> DataFrame:
    least = stored(links.groupBy("a").agg(F.min("b").alias("m")), "least", rows)
    moved = links.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return _downwards(moved.unionAll(least.select("a", F.col("m").alias("b"))))


def components(links: DataFrame, rows: int | None = None) -> DataFrame:
    """``(node, root)`` of each node of ``links(a, b)`` that is not the smallest of its component; root is the smallest. ``rows``: about how many links there are, if known.

    No links give an empty table; loops and repeats change nothing; links with a null end are dropped.
    """
    now = stored(_downwards(links.na.drop()), "links", rows)
    state = None
    while True:
        found = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if found == state or not found[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = found
        up = stored(_large_star(now, found[0]), "links", found[0])
        drop_stored(now)
        now = stored(_small_star(up, found[0]), "links", found[0])
        drop_stored(up)

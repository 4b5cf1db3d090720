"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldwright.llm import exchange as X

#: Rounds after which something must be wrong; the number needed grows with the logarithm of the longest chain.
ROUNDS = 60


def _tidy(links: DataFrame) -> DataFrame:
    return links.where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """links(a long, b long) -> (a, root): for each end of a link, the least node that it reaches.

    Links of a node to itself are ignored; an empty table gives an empty one. A node's neighbours are never gathered:
    each round takes minima by node and joins them back, so a node linked to a third of all others is only a long key.
    """
    now = X.keep(_tidy(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))), "links")
    seen = None
    for _ in range(ROUNDS):
        mark = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if mark["n"] == 0 or mark == seen:
            return now.select("a", F.col("b").alias("root")).union(now.select(F.col("b").alias("a"), F.col("b").alias("root"))).distinct()
        seen = mark
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = _tidy(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        large = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        last, now = now, X.keep(_tidy(small), "links")
        X.discard(last)
    raise RuntimeError(f"components did not settle in {ROUNDS} rounds")

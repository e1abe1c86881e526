"""Connected components of links, without collecting any of them: alternating large-star and small-star steps.

Every step groups links by node with partial aggregation and joins them to the group's smallest neighbour, so that a hub is
an ordinary skewed join, which Spark splits. Joins merge at any size: what grows with the input is never built as one table in the driver. Each
round is written to the shared folder. Works on nodes of any ordered type.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import discard, stored


def _to_least(links: DataFrame, own: str, other: str) -> DataFrame:
    """links with the least of ``own`` and all its ``other``."""
    least = links.groupBy(own).agg(F.min(other).alias("_m")).select(own, F.least(own, "_m").alias("least"))
    return links.join(least.hint("merge"), own)


def components(links: DataFrame) -> DataFrame:
    """links(a, b) to (node, component): the smallest node that can be reached, for every node that has a link."""
    now = stored(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    seen = None
    while True:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _to_least(both, "a", "b").where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b")).where("a <> b").distinct()
        small = _to_least(large, "a", "b")
        small = small.select(F.col("b").alias("a"), F.col("least").alias("b")).union(small.select("a", F.col("least").alias("b"))).where("a <> b").distinct()
        after = stored(small, "links")
        state = after.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        discard(now)
        now = after
        if state == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b"), F.col("b"))).distinct()
        seen = state

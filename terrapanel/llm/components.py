"""Connected components of a graph of integer nodes, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrapanel.session import checkpointed, release


def _round(edges: DataFrame) -> DataFrame:
    """One large star and one small star: every node moves towards the least it can see."""
    both = edges.unionByName(edges.select(F.col("low").alias("high"), F.col("high").alias("low")))
    both = both.select(F.col("high").alias("u"), F.col("low").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.filter("v > u").join(least, "u").select(F.col("v").alias("high"), F.col("m").alias("low")).distinct()
    below = large.filter("high != low")
    least = below.groupBy("high").agg(F.min("low").alias("m"))
    small = below.join(least, "high").select(F.col("low").alias("high"), F.col("m").alias("low"))
    return small.unionByName(least.select("high", F.col("m").alias("low"))).filter("high != low").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, component (its least node) of every node of ``edges`` (high, low).

    Rounds end when a round changes nothing; their number grows with the logarithm of the size.
    Loops and repeated edges do no harm; without edges the result is empty.
    """
    now = checkpointed(edges.filter("high != low").select(
        F.greatest("high", "low").alias("high"), F.least("high", "low").alias("low")).distinct())

    def state(t: DataFrame):
        return t.agg(F.count(F.lit(1)), F.sum(F.xxhash64("high", "low").cast("decimal(38,0)"))).first()

    before = state(now)
    while before[0]:
        after = checkpointed(_round(now))
        release(now)
        now, last, before = after, before, state(after)
        if last == before:
            break
    stars = now.select(F.col("high").alias("node"), F.col("low").alias("component"))
    return stars.unionByName(now.select(F.col("low").alias("node"), F.col("low").alias("component")).distinct())

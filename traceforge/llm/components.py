"""Connected components by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from traceforge.llm.common import release, settle


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, component`` (smallest node reachable) of ``a, b`` links, but for each component's smallest node.

    Each round links all larger neighbours of a node to its smallest one, then
    all smaller neighbours, until only stars are left; the rounds grow with the
    logarithm of the longest chain. Smallest neighbours come from a combined
    aggregate, so a node with very many links is no single task's work.
    """
    ordered = edges.where("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    )
    stars = settle(ordered.distinct())
    before = None
    while True:
        both = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = (
            both.where("b > a")
            .join(least, "a")
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .distinct()
        )
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        upper = F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b"))
        small = large.join(least, "a").select(upper.alias("a"), F.col("m").alias("b")).distinct()
        stars = settle(small)
        state = stars.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state == before:
            return stars.select(F.col("a").alias("node"), F.col("b").alias("component"))
        before = state
        del both, least, large, small
        release(stars.sparkSession)  # the rounds' shuffle files do not pile up

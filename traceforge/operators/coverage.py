"""Whether two tables have the same keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def key_coverage(left: DataFrame, right: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys found on one side only, with the side that lacks them.

    One aggregation instead of two anti-joins: repeated keys are combined before
    the shuffle, so a key may repeat on either side without limit.
    """
    key = list(key)
    sides = left.select(*key, F.lit(1).alias("_l"), F.lit(0).alias("_r")).unionByName(
        right.select(*key, F.lit(0).alias("_l"), F.lit(1).alias("_r"))
    )
    found = sides.groupBy(*key).agg(F.max("_l").alias("_l"), F.max("_r").alias("_r"))
    return found.where(F.col("_l") != F.col("_r")).select(
        *key, F.when(F.col("_l") == 0, "left").otherwise("right").alias("missing_from")
    )


def assert_key_coverage(left: DataFrame, right: DataFrame, key: Sequence[str]) -> None:
    """Raise with a few examples when the key sets differ."""
    examples = key_coverage(left, right, key).limit(5).collect()
    if examples:
        raise ValueError(f"keys differ, for example {[r.asDict() for r in examples]}")

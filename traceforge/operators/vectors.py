"""Weighted mean vectors and norms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F


def vector_mean(
    df: DataFrame,
    vector: str,
    weight: str | None = None,
    by: Sequence[str] = (),
    name: str = "mean",
) -> DataFrame:
    """Sum of ``weight * vector`` over sum of ``weight``, per group.

    Each task adds whole vectors into one buffer per group, so a group of any
    size sends one vector per task through the shuffle.
    """
    values = array_to_vector(F.col(vector).cast("array<double>"))
    weights = F.col(weight).cast("double") if weight else F.lit(1.0)
    mean = Summarizer.mean(values, weights)
    return (
        df.where(F.col(vector).isNotNull())
        .groupBy(*by)
        .agg(mean.alias("_mean"))
        .withColumn(name, vector_to_array("_mean"))
        .drop("_mean")
    )


def long_vector(df: DataFrame, vector: str, keys: Sequence[str] = ()) -> DataFrame:
    """One row per element: ``keys, dim, value``."""
    return df.select(*keys, F.posexplode(vector).alias("dim", "value"))


def long_mean(
    df: DataFrame, by: Sequence[str], value: str = "value", weight: str | None = None
) -> DataFrame:
    """Weighted mean of a long table, e.g. by parameter name and dimension."""
    weights = F.col(weight).cast("double") if weight else F.lit(1.0)
    return df.groupBy(*by).agg((F.sum(F.col(value) * weights) / F.sum(weights)).alias("mean"))


def square_sum(vector: Column) -> Column:
    return F.aggregate(
        vector, F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double")
    )


def vector_norms(df: DataFrame, vector: str, by: Sequence[str] | None = None) -> DataFrame:
    """Euclidean norm, root mean square and element count.

    Per row when ``by`` is None, else over all vectors of a group; an empty
    ``by`` takes the whole table as one long vector.
    """
    parts = df.withColumn("_squares", square_sum(F.col(vector))).withColumn(
        "elements", F.size(vector).cast("long")
    )
    if by is not None:
        parts = parts.groupBy(*by).agg(
            F.sum("_squares").alias("_squares"), F.sum("elements").alias("elements")
        )
    return (
        parts.withColumn("norm", F.sqrt("_squares"))
        .withColumn("rms", F.sqrt(F.try_divide(F.col("_squares"), F.col("elements"))))
        .drop("_squares")
    )

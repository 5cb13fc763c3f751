"""Joins against a table with unique keys, whatever the skew of the other side."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from traceforge.workspace import SMALL_BYTES, SMALL_ROWS, materialise, row_bytes, small_or_none

# Most rows of one key that a plain join leaves to one task.
KEY_ROWS = 100_000


def _heavy_cut(table: DataFrame, weight: str, head_rows: int, head_bytes: int) -> int | None:
    """Smallest weight ``c`` such that the rows heavier than ``c`` stay within
    ``head_rows`` and ``head_bytes``; None when all rows do.

    Read off a histogram of the weights. Distinct weights are few, and no more
    than ``head_rows + 1`` of them are collected.
    """
    top = (
        table.select(weight, row_bytes(table).alias("_bytes"))
        .groupBy(weight)
        .agg(F.count(F.lit(1)).alias("_rows"), F.sum("_bytes").alias("_bytes"))
        .orderBy(F.desc(weight))
        .limit(head_rows + 1)
        .toArrow()
    )
    fits = pc.and_(
        pc.less_equal(pc.cumulative_sum(top["_rows"]), head_rows),
        pc.less_equal(pc.cumulative_sum(top["_bytes"]), head_bytes),
    )
    beyond = top[weight].filter(pc.invert(fits))
    return beyond[0].as_py() if len(beyond) else None


def lookup(
    facts: DataFrame,
    table: DataFrame,
    on: Sequence[str],
    weight: str,
    head_rows: int = SMALL_ROWS,
    head_bytes: int = SMALL_BYTES,
) -> DataFrame:
    """Left-join ``table`` to ``facts`` on ``on``; ``weight`` counts facts per key.

    A table within ``head_rows`` and ``head_bytes`` is broadcast whole.
    Above that only its heaviest keys are, so their facts stay where they are;
    every other key holds a small share of the facts and is shuffled. ``table``
    is read several times and should be a written table.
    """
    on = list(on)
    cut = _heavy_cut(table, weight, head_rows, head_bytes)
    values = [c for c in table.columns if c not in on]
    if cut is None:
        return facts.join(F.broadcast(table), on, "left")
    head = table.where(F.col(weight) > cut).withColumn("_found", F.lit(True))
    tail = table.where(F.col(weight) <= cut)
    tried = facts.join(F.broadcast(head), on, "left")
    hits = tried.where("_found").drop("_found")
    misses = tried.where(F.col("_found").isNull()).drop("_found", *values)
    return hits.unionByName(misses.join(tail, on, "left"))


def skewed_lookup(
    facts: DataFrame, table: DataFrame, on: Sequence[str], head_rows: int = SMALL_ROWS, *, key_rows: int = KEY_ROWS
) -> DataFrame:
    """``lookup`` for a table that does not say how often its keys occur.

    The facts are counted by key first, combined before the shuffle. While no
    key has more than ``key_rows`` of them, one join does it. Otherwise, and
    when few keys occur, the table is cut down to the keys that occur. Keys it
    lacks are kept without values, so that a frequent one is not shuffled either.
    """
    on = list(on)
    small = small_or_none(table, head_rows)
    if small is not None:
        return facts.join(small, on, "left")
    counts = materialise(facts.groupBy(*on).agg(F.count(F.lit(1)).alias("_facts")), "lookup-keys")
    few = small_or_none(counts.select(*on), head_rows)
    if few is None and counts.agg(F.max("_facts")).first()[0] <= key_rows:
        return facts.join(table, on, "left")
    wanted = table if few is None else table.join(few, on)
    weighed = materialise(counts.join(wanted, on, "left"), "lookup")
    return lookup(facts, weighed, on, "_facts", head_rows).drop("_facts")


def attach_bounded(facts: DataFrame, table: DataFrame, on: Sequence[str]) -> DataFrame:
    """Inner-join a table that is usually small: broadcast only after counting it."""
    small = small_or_none(table)
    return facts.join(table if small is None else small, list(on))


def lookup_sums(
    facts: DataFrame,
    table: DataFrame,
    on: Sequence[str],
    weight: str,
    by: Sequence[str],
    values: Mapping[str, Column],
    counted: Column,
    head_rows: int = SMALL_ROWS,
    head_bytes: int = SMALL_BYTES,
) -> DataFrame:
    """``by``, the sum of each value over its ``counted`` facts, and their number ``facts``.

    As ``lookup``, followed by sums per ``by``, but the facts are read once and
    every one is looked up in one branch: those of the head are added up where
    they are, one row per ``by`` and task, and the rest become counts per ``by``
    and key before they are shuffled to the tail. ``values`` are expressions of
    the columns of ``table``, null where a fact's key is not there.
    """
    on, by, names = list(on), list(by), list(values)
    cut = _heavy_cut(table, weight, head_rows, head_bytes)
    number = F.count_if(counted)
    if cut is None:
        found = facts.join(F.broadcast(table), on, "left")
        sums = [F.sum(F.when(counted, values[n])).alias(n) for n in names]
        return found.groupBy(*by).agg(*sums, number.alias("facts"))
    head = table.where(F.col(weight) > cut).withColumn("_found", F.lit(True))
    tried = facts.join(F.broadcast(head), on, "left").withColumn("_miss", counted & F.col("_found").isNull())
    keys = [f"_key{i}" for i in range(len(on))]
    combined = (
        tried.withColumns({k: F.when(F.col("_miss"), F.col(c)) for k, c in zip(keys, on, strict=True)})
        .groupBy(*by, "_miss", *keys)
        .agg(number.alias("_n"), *[F.sum(F.when(counted & ~F.col("_miss"), values[n])).alias(f"_sum_{n}") for n in names])
        # what has no key left to look up is spread by its own row
        .withColumn("_spread", F.when(F.col("_miss"), F.lit(0).cast("long")).otherwise(F.xxhash64(*by)))
    )
    tail = table.where(F.col(weight) <= cut).withColumnsRenamed(dict(zip(on, keys, strict=True)))
    joined = combined.join(tail.withColumn("_spread", F.lit(0).cast("long")), ["_spread", *keys], "left")
    sums = [
        F.sum(F.when(F.col("_miss"), F.col("_n") * values[n]).otherwise(F.col(f"_sum_{n}"))).alias(n) for n in names
    ]
    return joined.groupBy(*by).agg(*sums, F.sum("_n").alias("facts"))


def skewed_lookup_sums(
    facts: DataFrame, table: DataFrame, on: Sequence[str], by: Sequence[str], values: Mapping[str, Column],
    counted: Column, head_rows: int = SMALL_ROWS,
) -> DataFrame:
    """``lookup_sums`` for a table that does not say how often its keys occur; see ``skewed_lookup``."""
    on = list(on)
    if small_or_none(table, head_rows) is not None:
        return lookup_sums(facts, table.withColumn("_facts", F.lit(1)), on, "_facts", by, values, counted, head_rows)
    counts = facts.groupBy(*on).agg(F.count(F.lit(1)).alias("_facts"))
    weighed = materialise(counts.join(table, on, "left"), "lookup")
    return lookup_sums(facts, weighed, on, "_facts", by, values, counted, head_rows)

"""Whole conversations as chat strings, whatever their length."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from traceforge.functions.text import CHATML, ChatTemplate
from traceforge.operators.grouped import GroupedRows

# Messages of a conversation that one task may sort, bytes that one task joins at once, and bytes of one chat string at most (but for a single longer message).
GROUP_ROWS, SEGMENT_BYTES, PART_BYTES = 10_000, 1 << 20, 1 << 29


def joined_in_order(
    df: DataFrame, group: Sequence[str], order: Sequence[str], text: str, name: str,
    segment_bytes: int = SEGMENT_BYTES, part_bytes: int = PART_BYTES, group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """``group, part, name, rows``: the texts of each group joined in order.

    A group of more than ``part_bytes`` comes in several rows, numbered by
    ``part``, each of whole texts; all others are one row, part 0. Equal places
    in the order are joined by their texts' hash. A null text adds nothing but
    counts as a row; rows of a null group are one group.

    Running byte counts cut a group into segments. Each segment is one joined
    string, and the segments of a part are joined again, so a task holds a
    segment's rows or a part's segments. Groups beyond ``group_rows`` rows are
    range-partitioned first and span many tasks; the others take one shuffle.
    """
    keys = list(group)
    texts = df.select(*keys, *order, F.coalesce(F.col(text), F.lit("")).alias("_text"))
    texts = texts.withColumn("_tie", F.xxhash64("_text"))
    place = [*order, "_tie"]
    size = F.octet_length("_text").cast("long")
    rows = GroupedRows(texts, keys, place, group_rows).running("_upto", size).result()
    before = F.col("_upto") - size
    per_part = max(1, part_bytes // segment_bytes)
    segment = F.floor(before / segment_bytes)

    def joined(column: str) -> Column:
        return F.array_join(F.transform(F.array_sort(column), lambda row: row["_text"]), "")

    segments = (
        rows.withColumn("_segment", segment)
        .groupBy(*keys, "_segment")
        .agg(F.collect_list(F.struct(*place, "_text")).alias("_listed"), F.count(F.lit(1)).alias("_rows"))
        .select(*keys, "_segment", joined("_listed").alias("_text"), "_rows")
    )
    return (
        segments.withColumn("part", F.floor(F.col("_segment") / per_part))
        .groupBy(*keys, "part")
        .agg(F.collect_list(F.struct("_segment", "_text")).alias("_listed"), F.sum("_rows").alias("rows"))
        .select(*keys, "part", joined("_listed").alias(name), "rows")
    )


def render_conversations(
    df: DataFrame, group: Sequence[str], order: Sequence[str], role: str = "role", content: str = "text",
    template: ChatTemplate = CHATML, system: str | None = None, name: str = "chat", **sizes: int,
) -> DataFrame:
    """``group, part, name, turns``: all messages of a conversation in order as one chat string.

    A ``system`` message opens every conversation and is no turn. A null role or
    content is empty. Messages of one place in the order follow by their hash.
    See ``joined_in_order`` for very long conversations.
    """
    empty = F.lit("")
    messages = df.withColumn(
        "_message", template.message(F.coalesce(F.col(role), empty), F.coalesce(F.col(content), empty))
    )
    joined = joined_in_order(messages, group, order, "_message", "_joined", **sizes)
    opening = template.message(F.lit("system"), F.lit(system)) if system is not None else empty
    start = F.when(F.col("part") == 0, F.concat(F.lit(template.prefix), opening)).otherwise(empty)
    return joined.select(*group, "part", F.concat(start, "_joined").alias(name), F.col("rows").alias("turns"))

"""Exact positions, splits, shards and batches over whole tables.

Nothing here runs an unpartitioned window over rows. A seeded order is cut into
buckets by hash prefix, a stored order into range slices; only the bucket or
slice sizes, whose number is fixed, are summed up in one place.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from traceforge.constants import GENERATION_BATCH, TRAIN_FRACTION
from traceforge.workspace import materialise

# 16 ** 4 buckets: about 15 million rows each at 10 ** 12 rows, and at most
# 65,536 rows in the broadcast table of bucket offsets.
PREFIX_DIGITS = 4
# Longest top-n that each task keeps and one task merges; beyond it rows are ranked.
TOP_ROWS = 10_000
# Shards whose edges are compared one by one, which Spark compiles.
FEW_SHARDS = 64
_ROW_BITS = 33  # monotonically_increasing_id keeps the row in the low 33 bits


def names(columns: str | Sequence[str]) -> list[str]:
    return [columns] if isinstance(columns, str) else list(columns)


def shuffle_hash(key: str | Sequence[str], seed: int | str) -> Column:
    """Hex hash that fixes a reproducible random order of the keys."""
    return F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in names(key)], F.lit(str(seed))))


def uniform(key: str | Sequence[str], seed: int | str) -> Column:
    """Reproducible number in [0, 1) from the first 52 bits of the hash."""
    leading = F.conv(F.substring(shuffle_hash(key, seed), 1, 13), 16, 10)
    return leading.cast("double") / F.lit(float(2**52))


def _offsets(sizes: DataFrame, bucket: str, count: str) -> DataFrame:
    """Rows before each bucket, and rows in all. ``sizes`` has a fixed number of rows."""
    before = Window.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(bucket).rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    return sizes.select(
        bucket,
        F.coalesce(F.sum(count).over(before), F.lit(0)).alias("_before"),
        F.sum(count).over(everything).alias("_total"),
    )


def shuffled_rank(
    df: DataFrame,
    key: str | Sequence[str],
    seed: int | str,
    name: str = "rank",
    total: str | None = None,
    prefix_digits: int = PREFIX_DIGITS,
) -> DataFrame:
    """Position 1..n of each row in the order of ``shuffle_hash``; ``key`` is unique."""
    hashed = df.withColumn("_hash", shuffle_hash(key, seed)).withColumn(
        "_bucket", F.substring("_hash", 1, prefix_digits)
    )
    sizes = hashed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_rows"))
    inside = Window.partitionBy("_bucket").orderBy("_hash", *names(key))
    ranked = hashed.join(F.broadcast(_offsets(sizes, "_bucket", "_rows")), "_bucket").withColumn(
        name, F.col("_before") + F.row_number().over(inside)
    )
    if total:
        ranked = ranked.withColumn(total, F.col("_total"))
    return ranked.drop("_hash", "_bucket", "_before", "_total")


def stored_rank(
    df: DataFrame,
    order: str | Column | Sequence[str | Column],
    name: str = "rank",
    total: str | None = None,
) -> DataFrame:
    """Position 1..n of each row in the natural order of ``order``, which is unique.

    Range slices are sorted on their own and written once, because the slice
    bounds come from a sample and must not be drawn twice.
    """
    order = [order] if isinstance(order, (str, Column)) else list(order)
    sliced = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_at", F.monotonically_increasing_id())
    )
    kept = materialise(sliced, "ranked").withColumn("_slice", F.shiftright("_at", _ROW_BITS))
    sizes = kept.groupBy("_slice").agg(F.count(F.lit(1)).alias("_rows"))
    in_slice = F.col("_at").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    ranked = kept.join(F.broadcast(_offsets(sizes, "_slice", "_rows")), "_slice").withColumn(
        name, F.col("_before") + in_slice + 1
    )
    if total:
        ranked = ranked.withColumn(total, F.col("_total"))
    return ranked.drop("_at", "_slice", "_before", "_total")


def global_rank(
    df: DataFrame,
    key: str | Sequence[str],
    seed: int | str | None = None,
    name: str = "rank",
    total: str | None = None,
) -> DataFrame:
    """``shuffled_rank`` when a seed is given, else ``stored_rank``."""
    if seed is None:
        return stored_rank(df, key, name, total)
    return shuffled_rank(df, key, seed, name, total)


def _train_edge_seeded(
    df: DataFrame, keys: list[str], seed: int | str, fraction: float, prefix_digits: int
) -> tuple | None:
    """Hash and key of the last training row in seeded order, None without one.

    Bucket sizes, a fixed number of them, tell which bucket holds the edge; only
    that bucket's keys are put in order.
    """
    hashed = df.select(shuffle_hash(keys, seed).alias("_hash"), *keys).withColumn(
        "_bucket", F.substring("_hash", 1, prefix_digits)
    )
    sizes = sorted(hashed.groupBy("_bucket").count().collect())
    left = int(sum(n for _, n in sizes) * fraction)
    if left == 0:
        return None
    for bucket, n in sizes:
        if left <= n:
            break
        left -= n
    place = F.row_number().over(Window.partitionBy("_bucket").orderBy("_hash", *keys))
    edge = hashed.where(F.col("_bucket") == bucket).withColumn("_place", place)
    return tuple(edge.where(F.col("_place") == left).select("_hash", *keys).first())


def _up_to(columns: list[Column], names_: list[str], edge: tuple, df: DataFrame) -> Column:
    """Whether the columns sort at or before ``edge``; a null comes first, and the answer is never null."""
    types = [df.select(c).schema[0].dataType for c in columns]
    values = [F.lit(v).cast(t) for v, t in zip(edge, types)]
    if len(columns) == 1:
        return columns[0].isNull() | F.coalesce(columns[0] <= values[0], F.lit(False))
    return F.struct(*[c.alias(n) for c, n in zip(columns, names_)]) <= F.struct(
        *[v.alias(n) for v, n in zip(values, names_)]
    )


def is_train(
    df: DataFrame,
    key: str | Sequence[str],
    seed: int | str | None = None,
    fraction: float = TRAIN_FRACTION,
    prefix_digits: int = PREFIX_DIGITS,
) -> Column:
    """Condition for the first ``int(n * fraction)`` rows in seeded or stored order.

    The product is taken in doubles: n = 90 gives 62, not 63. Only keys are
    ordered, to find the last training row; the rows themselves are compared
    with it where they are.
    """
    keys = names(key)
    columns = [F.col(k) for k in keys]
    labels = list(keys)
    if seed is not None:
        edge = _train_edge_seeded(df, keys, seed, fraction, prefix_digits)
        columns, labels = [shuffle_hash(keys, seed), *columns], ["_hash", *labels]
    else:
        ranked = stored_rank(df.select(*keys), keys, "_rank")
        at = int(ranked.count() * fraction)
        found = ranked.where(F.col("_rank") == at).select(*keys).first()
        edge = tuple(found) if found else None
    if edge is None:
        return F.lit(False)
    return _up_to(columns, labels, edge, df)


def with_split(
    df: DataFrame,
    key: str | Sequence[str],
    seed: int | str | None = None,
    fraction: float = TRAIN_FRACTION,
    name: str = "split",
) -> DataFrame:
    """Mark every row ``train`` or ``holdout``; see ``is_train``."""
    train = is_train(df, key, seed, fraction)
    return df.withColumn(name, F.when(train, F.lit("train")).otherwise(F.lit("holdout")))


def split(
    df: DataFrame,
    key: str | Sequence[str],
    part: str,
    seed: int | str | None = None,
    fraction: float = TRAIN_FRACTION,
) -> DataFrame:
    if part not in ("train", "holdout"):
        raise ValueError(f"part must be 'train' or 'holdout', not {part!r}")
    train = is_train(df, key, seed, fraction)
    return df.where(train if part == "train" else ~train)


def limit_n(df: DataFrame, order: str | Sequence[str], n: int | None) -> DataFrame:
    """The first ``min(n, rows)`` rows; all of them when ``n`` is None."""
    if n is None:
        return df
    if n <= TOP_ROWS:
        return df.orderBy(*names(order)).limit(n)
    return stored_rank(df, order, "_rank").where(F.col("_rank") <= n).drop("_rank")


def contiguous_shard(df: DataFrame, order: str | Sequence[str], shards: int) -> Column:
    """Contiguous shard number by the key columns, also for rows of another table; see ``with_shard``."""
    keys = names(order)
    ranked = stored_rank(df.select(*keys), keys, "_rank")
    base, larger = divmod(ranked.count(), shards)
    starts = [s * base + min(s, larger) + 1 for s in range(1, shards)]
    edges = ranked.where(F.col("_rank").isin(starts)).orderBy("_rank").select(*keys).collect()
    row = F.struct(*keys)
    if not edges:
        return F.lit(0)
    types = [df.schema[k].dataType for k in keys]
    if len(keys) == 1 and shards <= FEW_SHARDS:  # a null comes first
        reached = [F.lit(True) if e[0] is None else F.coalesce(F.col(keys[0]) >= F.lit(e[0]).cast(types[0]), F.lit(False)) for e in edges]
        return sum((r.cast("int") for r in reached), F.lit(0))
    listed = F.array(
        *[F.struct(*[F.lit(v).cast(t).alias(k) for v, t, k in zip(e, types, keys)]) for e in edges]
    )
    return F.size(F.filter(listed, lambda start: start <= row))


def with_shard(
    df: DataFrame,
    order: str | Sequence[str],
    shards: int,
    contiguous: bool = True,
    name: str = "shard",
) -> DataFrame:
    """Shard number 0..shards-1 per row.

    Contiguous shards differ by at most one row, the larger ones first: only
    keys are ordered, to find where each shard starts, and rows are compared
    with those edges where they are. Otherwise row i goes to shard
    ``i mod shards``, which needs every row's position.
    """
    keys = names(order)
    if not contiguous:
        ranked = stored_rank(df, keys, "_rank")
        return ranked.withColumn(name, ((F.col("_rank") - 1) % shards).cast("int")).drop("_rank")
    return df.withColumn(name, contiguous_shard(df, keys, shards))


def with_batch(
    df: DataFrame,
    order: str | Sequence[str],
    size: int = GENERATION_BATCH,
    name: str = "batch",
) -> DataFrame:
    """Zero-based batch number per row, in stored order."""
    return (
        stored_rank(df, order, "_rank")
        .withColumn(name, F.floor((F.col("_rank") - 1) / size))
        .drop("_rank")
    )


def batch_plan(
    df: DataFrame,
    order: str | Sequence[str],
    length: str,
    size: int = GENERATION_BATCH,
) -> DataFrame:
    """Per batch: rows, padded length, tokens, padding waste and whether it is full."""
    batches = with_batch(df.select(*names(order), length), order, size)
    return (
        batches.groupBy("batch")
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.max(length).alias("padded_length"),
            F.sum(length).alias("tokens"),
        )
        .withColumn("padding", F.col("rows") * F.col("padded_length") - F.col("tokens"))
        .withColumn("is_full", F.col("rows") == size)
    )


def example_rows(df: DataFrame, key: str | Sequence[str], n: int, seed: int | str) -> DataFrame:
    """A reproducible random handful of rows, as a top-n over the hash."""
    if n > TOP_ROWS:
        return shuffled_rank(df, key, seed, "_rank").where(F.col("_rank") <= n).drop("_rank")
    return (
        df.withColumn("_hash", shuffle_hash(key, seed))
        .orderBy("_hash", *names(key))
        .limit(n)
        .drop("_hash")
    )

"""Intervals of accuracies and of their differences, by a one-pass Poisson bootstrap."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from math import ceil, exp, factorial, floor

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from traceforge.functions.answers import bound
from traceforge.operators.ranking import names

REPLICATES, LEVEL = 200, 0.95
# A hash gives eight numbers of 16 bits; a row weighs as many as there are thresholds at or below its number.
PER_HASH, STEPS = 8, 1 << 16
THRESHOLDS = [floor(STEPS * sum(exp(-1) / factorial(i) for i in range(k + 1))) for k in range(8)]


def replicate_weights(key: str | Sequence[str], seed: int | str, replicates: int) -> Column:
    """Array of Poisson(1) weights of a row, one per replicate, from md5 hashes of its key.

    Equal keys weigh alike everywhere, so runs over the same problems are resampled in pairs.
    """
    text = F.concat_ws("|", *[F.col(k).cast("string") for k in names(key)], F.lit(str(seed)))

    def weight(number: Column) -> Column:
        return sum(((number >= t).cast("double") for t in THRESHOLDS), F.lit(0.0))

    def eight(block: Column) -> Column:
        return bound(
            F.md5(F.concat_ws("|", text, block.cast("string"))),
            lambda h: F.transform(
                F.sequence(F.lit(0), F.lit(PER_HASH - 1)),
                lambda i: bound(F.conv(F.substring(h, i * 4 + 1, F.lit(4)), 16, 10).cast("int"), weight),
            ),
        )

    blocks = F.transform(F.sequence(F.lit(0), F.lit(ceil(replicates / PER_HASH) - 1)), eight)
    return F.slice(F.flatten(blocks), 1, replicates)


def _weighed(rows: DataFrame, keys: Sequence[str], replicates: int) -> DataFrame:
    """``keys, traces, right, sums`` per batch and group of ``keys, _correct, _hashes`` rows: weights drawn, then those right."""
    weights = np.searchsorted(THRESHOLDS, np.arange(STEPS), "right").astype(np.float64)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            groups = batch.select(list(keys)).to_pandas().groupby(list(keys), dropna=False, sort=False).ngroup().to_numpy()
            order = np.argsort(groups, kind="stable")
            starts = np.flatnonzero(np.diff(groups[order], prepend=-1))
            numbers = np.frombuffer(b"".join(batch["_hashes"].to_pylist()), ">u2").reshape(batch.num_rows, -1)
            drawn, correct = weights[numbers[order, :replicates]], batch["_correct"].to_numpy()[order]
            sums = np.hstack([np.add.reduceat(x, starts) for x in (drawn, drawn * correct[:, None])])
            columns = [batch[k].take(pa.array(order[starts])) for k in keys]
            columns += [pa.array(np.diff(np.append(starts, len(order)))), pa.array(np.add.reduceat(correct, starts))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(list(sums))], [*keys, "traces", "right", "sums"])

    types = rows.select(*keys).schema.add("traces", "long").add("right", "double").add("sums", T.ArrayType(T.DoubleType()))
    return rows.mapInArrow(run, types)


def _between(values: Column, level: float, replicates: int) -> tuple[Column, Column]:
    """The values that leave half of the rest of ``level`` below and above them."""
    low = floor((1 - level) / 2 * replicates)
    ordered = F.array_sort(values)
    return F.get(ordered, F.lit(low)), F.get(ordered, F.lit(replicates - 1 - low))


def accuracy_intervals(
    df: DataFrame, correct: str, key: str | Sequence[str], run: str, baseline: str, by: Sequence[str] = (),
    seed: int | str = 42, replicates: int = REPLICATES, level: float = LEVEL,
) -> DataFrame:
    """``by, run, traces, accuracy, accuracy_low, accuracy_high, delta, delta_low, delta_high``.

    ``delta`` is the difference from the ``baseline`` run of the same ``by``
    group. Every row adds its replicate weights, and these times its verdict, to
    one vector per run, combined in each task before the shuffle: one pass,
    whatever the number of replicates. ``key`` names the problem; rows of equal
    key are drawn together. A null verdict takes no part. A replicate that draws
    no row of a run has no accuracy and sorts last. A group without its baseline,
    or with two, is an error.
    """
    text = F.concat_ws("|", *[F.col(k).cast("string") for k in names(key)], F.lit(str(seed)))
    hashes = [F.md5(F.concat_ws("|", text, F.lit(str(block)))) for block in range(ceil(replicates / PER_HASH))]
    rows = df.where(F.col(correct).isNotNull()).select(
        *by, run, F.col(correct).cast("double").alias("_correct"), F.unhex(F.concat(*hashes)).alias("_hashes")
    )
    sums = _weighed(rows, [*by, run], replicates).groupBy(*by, run).agg(
        F.sum("traces").alias("traces"), (F.sum("right") / F.sum("traces")).alias("accuracy"),
        vector_to_array(Summarizer.sum(array_to_vector("sums"))).alias("_sums"),
    )
    drawn, right = F.slice("_sums", 1, replicates), F.slice("_sums", replicates + 1, replicates)
    shares = sums.withColumn("_shares", F.zip_with(right, drawn, lambda r, d: F.try_divide(r, d)))
    of = Window.partitionBy(*(by or [F.lit(0)]))
    is_base = F.col(run) == baseline
    refused = F.raise_error(F.concat(F.lit(f"not one baseline {baseline!r} for "), F.to_json(F.struct(run, *by))))
    is_wrong = F.count_if(is_base).over(of) != 1
    base, base_shares = (F.max(F.when(is_base, F.col(c))).over(of) for c in ("accuracy", "_shares"))
    low, high = _between(F.col("_shares"), level, replicates)
    paired = shares.withColumn("_base", base_shares).withColumn(
        "delta", F.when(is_wrong, refused.cast("double")).otherwise(F.col("accuracy") - base)
    )
    differences = F.zip_with("_shares", "_base", lambda a, b: a - b)
    delta_low, delta_high = _between(differences, level, replicates)
    return paired.select(
        *by, run, "traces", "accuracy", low.alias("accuracy_low"), high.alias("accuracy_high"),
        "delta", delta_low.alias("delta_low"), delta_high.alias("delta_high"),
    )

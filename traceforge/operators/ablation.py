"""What a student learns from several selections of one corpus: its loss on a holdout."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from traceforge.operators.language_model import CONTEXT, WORD, listed_ngrams
from traceforge.operators.lookup import lookup
from traceforge.workspace import SMALL_ROWS, materialise


def student_loss(
    df: DataFrame,
    selections: Mapping[str, Column],
    holdout: Column,
    baseline: str,
    tokens: str = "tokens",
    order: int = 1,
    alpha: float = 1.0,
    head_rows: int = SMALL_ROWS,
) -> DataFrame:
    """``train_set, rows, loss, perplexity, loss_delta`` per selection.

    An add-alpha n-gram model is fitted on the rows of each selection; ``loss``
    is the mean negative log-probability of an n-gram of the ``holdout`` rows,
    ``loss_delta`` its difference from ``baseline``. Rows of the holdout are
    never learned from; a null condition is false. Selections may overlap. All
    models share the word types of all selections, else a model that knows fewer
    words would seem the better one.

    Equal n-grams have equal probability, so one count of the whole table by
    selection, combined before the shuffle, gives all models and all losses.
    """
    if baseline not in selections:
        raise ValueError(f"{baseline!r} is not a selection")
    held = F.coalesce(holdout, F.lit(False))
    names = list(selections)
    flags = {f"_s{i}": (F.coalesce(selections[n], F.lit(False)) & ~held).cast("long") for i, n in enumerate(names)}
    marked = df.select(held.cast("long").alias("_h"), *[c.alias(f) for f, c in flags.items()], tokens)
    columns = [WORD] if order == 1 else [CONTEXT, WORD]
    sums = [F.sum(f).alias(f) for f in flags]
    counts = materialise(
        listed_ngrams(marked, tokens, order, "_h", *flags)
        .groupBy(*columns)
        .agg(F.count(F.lit(1)).alias("_n"), F.sum("_h").alias("_h"), *sums),
        "student-counts",
    )
    rows = marked.agg(*sums).first()
    types = counts.where(F.greatest(*flags, F.lit(0)) > 0).select(WORD).distinct().count() + 1
    totals = counts.agg(*sums).first()
    if order == 1:
        given = {f: F.lit(float(totals[f] or 0)) for f in flags}
        scored = counts
    else:
        contexts = materialise(
            counts.groupBy(CONTEXT).agg(F.sum("_n").alias("_all"), *[F.sum(f).alias(f"{f}_given") for f in flags]),
            "student-contexts",
        )
        scored = lookup(counts, contexts, [CONTEXT], "_all", head_rows)
        given = {f: F.col(f"{f}_given") for f in flags}

    def loss(f: str) -> Column:
        chance = (F.col(f) + float(alpha)) / (given[f] + float(alpha) * types)
        return F.try_divide(F.sum(-F.log(chance) * F.col("_h")), F.sum("_h").cast("double")).alias(f)

    losses = scored.where("_h > 0").agg(*[loss(f) for f in flags])
    base = F.col(f"_s{names.index(baseline)}")
    each = [
        F.struct(
            F.lit(n).alias("train_set"), F.lit(rows[f] or 0).cast("long").alias("rows"),
            F.col(f).alias("loss"), F.exp(f).alias("perplexity"), (F.col(f) - base).alias("loss_delta"),
        )
        for n, f in zip(names, flags)
    ]
    return losses.select(F.inline(F.array(*each)))

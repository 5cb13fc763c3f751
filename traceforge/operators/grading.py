"""Grading traces, accuracies and run comparison."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from traceforge.functions.answers import (
    answer_variants,
    bound,
    extract_answer,
    plain_integer,
    same_answer,
    typed_answer,
)
from traceforge.functions.formulas import formula_keys
from traceforge.operators.lookup import skewed_lookup


def grade(df: DataFrame, trace: str, solution: str, name: str = "is_correct") -> DataFrame:
    """True where any reading of the trace gives the gold answer; never null.

    Whole numbers in one spelling are equal as texts, so rows that have no
    others are decided by that. In the rest each text is parsed once into a
    typed answer. Formulas are read, for their keys, only in rows where an
    answer of the trace is no plain number or the gold one is not, and their
    texts differ.
    """
    variants = answer_variants(F.col(trace))
    texts = F.concat(F.array(F.col(solution)), F.array(*variants))
    whole, others = plain_integer(F.col(solution)), [plain_integer(v) for v in variants]
    graded = df.withColumn("_whole", whole).withColumns({f"_whole_{i}": o for i, o in enumerate(others)})
    agrees = [F.col(f"_whole_{i}") == F.col("_whole") for i in range(len(others))]
    found = [F.col("_whole_0").isNotNull()] + [v.isNull() | F.col(f"_whole_{i}").isNotNull() for i, v in enumerate(variants) if i]
    hit = F.coalesce(agrees[0], F.lit(False)) | F.coalesce(agrees[1], F.lit(False)) | F.coalesce(agrees[2], F.lit(False))
    miss = F.col("_whole").isNotNull() & found[0] & found[1] & found[2]
    graded = graded.withColumn("_quick", F.when(hit, F.lit(True)).when(miss, F.lit(False)))
    graded = graded.drop("_whole", *[f"_whole_{i}" for i in range(len(others))])
    parsed = F.transform(texts, lambda t: bound(extract_answer(t), typed_answer))
    graded = graded.withColumn("_answers", F.when(F.col("_quick").isNull(), parsed))
    gold = F.get("_answers", F.lit(0))
    open_to_doubt = F.exists(
        F.slice("_answers", 2, 3),
        lambda a: (a["text"] != gold["text"]) & (a["value"].isNull() | gold["value"].isNull()),
    )
    formulas = F.when(open_to_doubt, F.transform("_answers", lambda a: a["text"]))
    graded = graded.withColumn("_keys", formula_keys(formulas))

    def matches(i: int) -> Column:
        other = F.get("_answers", F.lit(i))
        return same_answer(gold, other, F.get("_keys", F.lit(0)), F.get("_keys", F.lit(i)))

    correct = matches(1) | matches(2) | matches(3)
    return graded.withColumn(name, F.coalesce("_quick", correct, F.lit(False))).drop("_quick", "_answers", "_keys")


def grade_against(
    traces: DataFrame,
    solutions: DataFrame,
    key: Sequence[str],
    trace: str,
    solution: str = "solution",
    name: str = "is_correct",
) -> DataFrame:
    """``grade`` with the solutions in a table of their own, unique by ``key``.

    A problem may have any share of the traces. A trace without a solution is
    graded false.
    """
    joined = skewed_lookup(traces, solutions.select(*key, solution), key)
    return grade(joined, trace, solution, name)


def accuracy(
    df: DataFrame,
    by: Sequence[str] = (),
    raw: str = "is_raw_correct",
    forced: str | None = "is_af_correct",
) -> DataFrame:
    """Share of correct traces; the forced one is null when no answers were forced."""
    af = F.avg(F.col(forced).cast("double")) if forced else F.lit(None).cast("double")
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("traces"),
        F.avg(F.col(raw).cast("double")).alias("raw_accuracy"),
        af.alias("af_accuracy"),
    )


def compare_runs(
    runs: DataFrame,
    baseline: str,
    run: str = "run",
    metrics: Sequence[str] = ("raw_accuracy", "af_accuracy"),
    by: Sequence[str] = (),
) -> DataFrame:
    """Each run's metrics beside their difference from the baseline run, within each ``by``.

    One row per run. A ``by`` group in which the baseline is absent or stands
    more than once is an error.
    """
    of = Window.partitionBy(*(by or [F.lit(0)]))
    is_base = F.col(run) == baseline
    checked = F.when(
        F.count_if(is_base).over(of) != 1,
        F.raise_error(F.concat(F.lit(f"not one baseline {baseline!r} for "), F.to_json(F.struct(run, *by)))),
    ).otherwise(F.lit(0.0))
    deltas = {f"{m}_delta": F.col(m) - F.max(F.when(is_base, F.col(m))).over(of) + F.col("_ok") for m in metrics}
    return runs.withColumn("_ok", checked).withColumns(deltas).drop("_ok")

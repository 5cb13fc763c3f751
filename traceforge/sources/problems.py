"""Problem tables: named sources, their splits, and subset union."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from traceforge.constants import MATH_SUBJECTS
from traceforge.functions.text import format_mcq, mcq_solution
from traceforge.operators.ranking import split

KEY = "problem_id"
SPLITS = ("train", "holdout", "test")
SHUFFLE_SEED = 42


@dataclass(frozen=True)
class ProblemSource:
    """Readers of one source: ``problem_id, problem, solution`` and any other columns.

    ``shuffled`` sources are cut into train and holdout in seeded order, the
    others in stored order.
    """

    pool: Callable[[SparkSession], DataFrame]
    test: Callable[[SparkSession], DataFrame]
    shuffled: bool = False


def load_problems(
    spark: SparkSession,
    data_split: str,
    sources: Mapping[str, ProblemSource],
    seed: int | str = SHUFFLE_SEED,
) -> DataFrame:
    """Problems of e.g. ``gsm8k_holdout``.

    The first source whose name occurs in ``data_split`` is taken, in the order
    of ``sources``; the piece after the first underscore names the split.
    """
    name = next((n for n in sources if n in data_split), None)
    part = (data_split.split("_") + [""])[1]
    if name is None or part not in SPLITS:
        raise ValueError(f"unknown source or split: {data_split!r}")
    source = sources[name]
    if part == "test":
        return source.test(spark)
    return split(source.pool(spark), KEY, part, seed if source.shuffled else None)


def concat_subsets(subsets: Mapping[str, DataFrame], name: str = "subset") -> DataFrame:
    """All subsets below each other, each row marked with its subset."""
    marked = [df.withColumn(name, F.lit(label)) for label, df in subsets.items()]
    return reduce(lambda a, b: a.unionByName(b), marked)


def subsets_of(df: DataFrame, column: str, name: str = "subset") -> DataFrame:
    """As ``concat_subsets`` where one table holds all subsets: its ``column`` is the mark, and it is read once."""
    return df.withColumnRenamed(column, name)


def subject_subsets(read: Callable[[str], DataFrame]) -> DataFrame:
    """The competition-maths subjects, each read by name, in their fixed order."""
    return concat_subsets({subject: read(subject) for subject in MATH_SUBJECTS})


def as_problems(df: DataFrame, key: str, problem: str, solution: str, *others: str) -> DataFrame:
    """Rename a question/answer table and keep only ``others`` beside."""
    return df.select(
        F.col(key).alias(KEY), F.col(problem).alias("problem"), F.col(solution).alias("solution"), *others
    )


def mcq_as_problems(
    df: DataFrame, key: str, question: str = "question", choices: str = "choices",
    answer: str = "answer",
) -> DataFrame:
    """Multiple-choice rows as problems with a boxed letter for a solution."""
    return df.select(
        F.col(key).alias(KEY),
        format_mcq(F.col(question), F.col(choices)).alias("problem"),
        mcq_solution(F.col(answer)).alias("solution"),
    )


def exchanges(turns: DataFrame) -> DataFrame:
    """User turns with the assistant turn that directly follows.

    An equi-join on (conversation, turn), not a window per conversation, so one
    very long conversation is spread like any other rows.
    """
    asked = turns.where(F.col("role") == "user").select(
        "conv_id", "turn", F.col("text").alias("problem")
    )
    answered = turns.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("response")
    )
    return asked.join(answered, ["conv_id", "turn"])

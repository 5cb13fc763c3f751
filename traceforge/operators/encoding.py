"""Vocabulary tables, id encoding and training rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from traceforge.constants import TRAINING_MAX_LENGTH
from traceforge.functions.text import extract_response, render_chat
from traceforge.functions.tokens import (
    completion_mask,
    is_truncated,
    row_problem,
    strip_trailing,
    truncate,
    words,
)
from traceforge.operators.lookup import lookup, skewed_lookup
from traceforge.operators.ranking import stored_rank
from traceforge.workspace import SMALL_ROWS

UNKNOWN_ID = 0


def vocabulary(df: DataFrame, tokens: str) -> DataFrame:
    """``token, n, id``: ids 1, 2, … by descending count, then by token.

    The counts are written once in that order; reading the result only adds the
    offsets of their slices.
    """
    counts = df.select(F.explode(tokens).alias("token")).groupBy("token").agg(
        F.count(F.lit(1)).alias("n")
    )
    ranked = stored_rank(counts, [F.desc("n"), "token"], "id")
    return ranked.withColumn("id", F.col("id").cast("int"))


def encode(
    df: DataFrame,
    key: Sequence[str],
    tokens: str,
    vocab: DataFrame,
    name: str = "input_ids",
    head_rows: int = SMALL_ROWS,
    same_corpus: bool = True,
) -> DataFrame:
    """``key`` and the ids of each token array; ``key`` is unique.

    ``same_corpus`` says that ``vocab`` was counted on ``df`` itself. Words outside ``vocab`` get id 0. An empty array stays empty. A row's ids
    are gathered again inside that row's own key, so no list outgrows its row.
    """
    listed = df.select(*key, F.posexplode_outer(tokens).alias("_at", "_token"))
    ids = vocab.select(F.col("token").alias("_token"), F.col("n").alias("_n"), F.col("id").alias("_id"))
    if same_corpus:
        found = lookup(listed, ids, ["_token"], "_n", head_rows)
    else:
        found = skewed_lookup(listed, ids.drop("_n"), ["_token"], head_rows)
    entry = F.struct("_at", F.coalesce("_id", F.lit(UNKNOWN_ID)).alias("id"))
    gathered = F.array_sort(F.collect_list(F.when(F.col("_at").isNotNull(), entry)))
    return found.groupBy(*key).agg(F.transform(gathered, lambda e: e["id"]).alias(name))


def lookup_ids(vocab: DataFrame, tokens: Sequence[str]) -> list[int]:
    """Ids of a few given tokens, such as those of a response template; each must be in a ``vocab`` that has rows."""
    known = {r.token: r.id for r in vocab.where(F.col("token").isin(list(tokens))).collect()}
    missing = sorted(set(tokens) - set(known))
    if missing and not vocab.isEmpty():
        raise ValueError(f"not in the vocabulary: {', '.join(missing)}")
    return [known.get(t, UNKNOWN_ID) for t in tokens]


def split_responses(traces: DataFrame, trace: str, name: str = "response") -> tuple[DataFrame, DataFrame]:
    """Rows whose response was found, and the quarantined rest with a reason."""
    read = traces.withColumn(name, extract_response(F.col(trace)))
    good = read.where(F.col(name).isNotNull())
    reason = F.when(F.col(trace).isNull(), "no trace").otherwise("no response marker")
    return good, read.where(F.col(name).isNull()).drop(name).withColumn("reason", reason)


def chat_tokens(df: DataFrame, problem: str, response: str, name: str = "tokens") -> DataFrame:
    return df.withColumn(name, words(render_chat(F.col(problem), F.col(response))))


def training_rows(
    encoded: DataFrame,
    template: Sequence[int],
    eos: int,
    ids: str = "input_ids",
    max_length: int = TRAINING_MAX_LENGTH,
) -> DataFrame:
    """Strip trailing eos, cap the length, mask the prompt and note what is unusable."""
    stripped = strip_trailing(F.col(ids), eos)
    return (
        encoded.withColumn(ids, stripped)
        .withColumn("was_truncated", is_truncated(F.col(ids), max_length))
        .withColumn(ids, truncate(F.col(ids), max_length))
        .withColumn("labels", completion_mask(F.col(ids), template))
        .withColumn("problem_found", row_problem(F.col(ids), template))
    )


def validation_report(
    df: DataFrame, ids: str, template: Sequence[int] | Column, width: int | None = None
) -> DataFrame:
    """Rows per reason; usable rows count under ``ok``."""
    reason = F.coalesce(row_problem(F.col(ids), template, width), F.lit("ok"))
    return df.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("rows"))

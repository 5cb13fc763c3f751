"""From a trace table to masked training rows, and the averaged vector of a corpus."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from traceforge.constants import QWEN_TURN_END, TRAINING_MAX_LENGTH
from traceforge.operators.encoding import (
    chat_tokens,
    encode,
    lookup_ids,
    split_responses,
    training_rows,
    vocabulary,
)
from traceforge.operators.vectors import vector_mean, vector_norms
from traceforge.workspace import materialise

# The qwen response marker in word tokens.
TEMPLATE_TOKENS = ("<|im_start|>", "assistant")


def chat_training_rows(
    exchanges: DataFrame, key: Sequence[str], problem: str = "problem", response: str = "response",
    max_length: int = TRAINING_MAX_LENGTH, vocab: DataFrame | None = None,
) -> DataFrame:
    """Chat-format, tokenise, encode, strip, cap and mask every exchange."""
    tokens = materialise(chat_tokens(exchanges, problem, response).select(*key, "tokens"), "tokens")
    own = vocab is None
    vocab = vocabulary(tokens, "tokens") if own else vocab
    template = lookup_ids(vocab, TEMPLATE_TOKENS)
    eos = lookup_ids(vocab, [QWEN_TURN_END])[0]
    ids = encode(tokens, key, "tokens", vocab, same_corpus=own)
    return training_rows(ids, template, eos, max_length=max_length)


def trace_training_rows(traces: DataFrame, key: Sequence[str], trace: str = "trace", **options):
    """The same for raw traces; also returns the rows whose response was not found."""
    good, quarantined = split_responses(traces, trace)
    return chat_training_rows(good, key, **options), quarantined


def mean_vectors(df: DataFrame, vector: str, weight: str | None, by: Sequence[str]) -> DataFrame:
    """Weighted mean vector per name with its norms."""
    return vector_norms(vector_mean(df, vector, weight, by), "mean")

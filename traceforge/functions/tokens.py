"""Column expressions on token and id arrays."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, functions as F

from traceforge.constants import IGNORED_LABEL, TRAINING_MAX_LENGTH

# A chat marker such as <|im_start|> is one token, and so is a run of letters and
# digits; any other sign stands alone. Only blanks are no part of a token.
BLANKS = r"\x20\x09-\x0D"
# Words come first and name their commonest letters first, which saves the matcher a third of its time.
TOKEN_PATTERN = rf"[a-z0-9\p{{L}}\p{{N}}]++|<\|[a-z_]++\|>|[^{BLANKS}]"


def words(text: Column) -> Column:
    """Lower-cased tokens of the whole text, in order; joined they are the text without blanks."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN_PATTERN), F.lit(0))


def subword_ids(encode: Callable[[list[str]], list[list[int]]]) -> Callable[[Column], Column]:
    """Wrap a caller's batch tokenizer (texts to id lists) as an Arrow-batched column function."""

    @F.pandas_udf("array<int>")
    def ids(texts: pd.Series) -> pd.Series:
        return pd.Series(encode(texts.tolist()))

    return ids


def _literal(ids: Sequence[int]) -> Column:
    return F.array(*[F.lit(int(i)) for i in ids])


def strip_trailing(ids: Column, eos: Column | int) -> Column:
    """Drop eos ids from the end but keep at least one id."""
    eos = eos if isinstance(eos, Column) else F.lit(eos)
    trailing = F.aggregate(
        ids, F.lit(0), lambda run, i: F.when(i == eos, run + 1).otherwise(F.lit(0))
    )
    return F.slice(ids, F.lit(1), F.greatest(F.size(ids) - trailing, F.lit(1)))


def truncate(ids: Column, max_length: int = TRAINING_MAX_LENGTH) -> Column:
    return F.slice(ids, 1, max_length)


def is_truncated(ids: Column, max_length: int = TRAINING_MAX_LENGTH) -> Column:
    return F.size(ids) > max_length


def last_position(ids: Column, template: Sequence[int] | Column, width: int | None = None) -> Column:
    """1-based start of the last occurrence of ``template``, null when it is absent.

    The first id is compared before a slice is cut, so long rows stay cheap.
    ``width`` is only needed when the template is a column.
    """
    if not isinstance(template, Column):
        width = len(template)
        template = _literal(template)
    first = F.element_at(template, 1)
    starts = F.filter(
        F.sequence(F.lit(1), F.size(ids) - width + 1),
        lambda p: (F.element_at(ids, p) == first) & (F.slice(ids, p, F.lit(width)) == template),
    )
    return F.when(F.size(ids) >= width, F.try_element_at(starts, F.lit(-1)))


def completion_mask(
    ids: Column,
    template: Sequence[int] | Column,
    pad: int | None = None,
    width: int | None = None,
) -> Column:
    """Labels: ids after the last response template, the ignored label elsewhere."""
    if not isinstance(template, Column):
        width = len(template)
    prompt = F.coalesce(last_position(ids, template, width) + (width - 1), F.size(ids))
    ignored = F.lit(IGNORED_LABEL)
    # The search result is bound once as the only element of an array; named
    # twice, or inside a lambda over the ids, it would be searched for again.
    labels = F.get(
        F.transform(
            F.array(prompt),
            lambda n: F.concat(F.array_repeat(ignored, n), F.slice(ids, n + 1, F.size(ids))),
        ),
        F.lit(0),
    )
    if pad is None:
        return labels
    return F.transform(labels, lambda i: F.when(i == pad, ignored).otherwise(i))


def row_problem(ids: Column, template: Sequence[int] | Column, width: int | None = None) -> Column:
    """Why a training row cannot be used; null when it can."""
    return F.when(ids.isNull() | (F.size(ids) == 0), F.lit("empty")).when(
        last_position(ids, template, width).isNull(), F.lit("no template")
    )

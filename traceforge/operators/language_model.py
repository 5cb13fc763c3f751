"""Add-alpha n-gram language models fitted and applied as Spark jobs."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, functions as F

from traceforge.operators.lookup import lookup, lookup_sums, skewed_lookup, skewed_lookup_sums
from traceforge.operators.own_counts import WordTotals, bigram_sums, word_totals
from traceforge.workspace import SMALL_ROWS, materialise

CONTEXT, WORD = "w1", "w2"


def ngram_items(tokens: Column, order: int) -> Column:
    """The n-grams of one token array: structs of ``position``, for bigrams ``w1``, and
    ``w2``, the predicted word, whose zero-based position in the array it is."""
    if order not in (1, 2):
        raise ValueError("order must be 1 or 2")
    count = F.greatest(F.size(tokens) - (order - 1), F.lit(0))
    places = F.when(count > 0, F.sequence(F.lit(order - 1), count + (order - 2)))
    columns = [F.coalesce(places, F.array().cast("array<int>")).alias("position")]
    if order == 2:
        columns.append(F.slice(tokens, F.lit(1), count).alias(CONTEXT))
    columns.append(F.slice(tokens, F.lit(order), count).alias(WORD))
    return F.arrays_zip(*columns)


def _item_columns(order: int) -> list[str]:
    return [WORD] if order == 1 else [CONTEXT, WORD]


def _exploded(
    df: DataFrame, key: Sequence[str], tokens: str, order: int, first: Column | None = None, pad: str | None = None
) -> DataFrame:
    """One row per n-gram, from position ``first`` on and but for ``pad``; a row without any keeps one null row."""
    if order == 1 and first is None and pad is None:
        return df.select(*key, F.posexplode_outer(tokens).alias("position", WORD))
    items = ngram_items(F.col(tokens), order)
    if first is not None:
        items = F.filter(items, lambda item: item["position"] >= first)
    if pad is not None:
        items = F.filter(items, lambda item: item[WORD] != pad)
    return df.select(*key, F.inline_outer(items))


@dataclass(frozen=True)
class NgramModel:
    """Counts of one corpus.

    ``counts`` has the n-gram and ``n``, ``contexts`` the first words of bigrams
    with theirs. ``types`` counts predicted words plus one unseen word, so that
    the probabilities after any context sum to 1. ``grams`` lists ``counts``,
    which are written when first asked for; ``words`` are the totals of bigrams.
    """

    order: int
    alpha: float
    grams: DataFrame
    words: WordTotals | None
    total: int
    types: int

    @cached_property
    def counts(self) -> DataFrame:
        return self.grams if self.words is None else materialise(self.grams, "ngrams")

    @cached_property
    def contexts(self) -> DataFrame | None:
        if self.words is None:
            return None
        return self.words.table.where("c0 > 0").select(F.col("word").alias(CONTEXT), F.col("c0").alias("n"))

    @cached_property
    def counts_with_context(self) -> DataFrame:
        """``counts``, for bigrams with ``given``, the count of the first word; written when first asked for."""
        if self.contexts is None:
            return self.counts
        given = self.contexts.withColumnRenamed("n", "given")
        return materialise(lookup(self.counts, given, [CONTEXT], "given"), "ngrams-given")

    def log_probability(self, count: Column, context: Column | None = None) -> Column:
        given = F.lit(float(self.total)) if context is None else context
        return F.log((count + self.alpha) / (given + self.alpha * self.types))


def listed_ngrams(df: DataFrame, tokens: str, order: int, *others: str) -> DataFrame:
    """One row per n-gram beside ``others``; rows without any are left out.

    They are left out after the explosion: Spark would put a condition on the
    tokens before an inner one and so compute tokens that are not stored again.
    """
    return _exploded(df.select(*others, tokens), others, tokens, order).where(F.col("position").isNotNull()).drop("position")


def fit_ngram(
    df: DataFrame, tokens: str, order: int = 1, alpha: float = 1.0, weight: str | None = None
) -> NgramModel:
    """Count the n-grams of ``df``. Repeated words are combined before the shuffle.

    A row counts as often as its ``weight``, a whole number above 0, says.
    """
    columns = _item_columns(order)
    number = F.sum(weight) if weight else F.count(F.lit(1))
    counts = listed_ngrams(df, tokens, order, *filter(None, [weight])).groupBy(*columns).agg(number.alias("n"))
    if order == 1:
        counts, words = materialise(counts, "ngrams"), None
        types, total = counts.agg(F.count(F.lit(1)), F.sum("n")).first()
    else:
        words = word_totals(_weighted(df, tokens, [], _w=F.col(weight) if weight else F.lit(1)), tokens, ["_w"])
        types, total = words.types(), words.table.agg(F.sum("c0")).first()[0]
    return NgramModel(order, float(alpha), counts, words, int(total or 0), int(types) + 1)


def _weighted(df: DataFrame, tokens: str, key: Sequence[str], **weights: Column) -> DataFrame:
    return df.select(*key, *[F.coalesce(w, F.lit(0)).cast("long").alias(n) for n, w in weights.items()], tokens)


def token_logprobs(
    df: DataFrame,
    model: NgramModel,
    key: Sequence[str],
    tokens: str,
    head_rows: int = SMALL_ROWS,
    same_corpus: bool = True,
    pad: str | None = None,
    first: Column | None = None,
) -> DataFrame:
    """Long table ``key, position, logp``, with ``pad`` also ``is_pad``.

    Positions before ``first`` are left out before anything is looked up.

    ``same_corpus`` says that the model counts ``df`` itself, so that its counts
    tell the frequent words of the join; otherwise ``df`` is counted for that.
    """
    def attach(facts: DataFrame, table: DataFrame, on: list[str], count: str) -> DataFrame:
        table = table.withColumnRenamed("n", count)
        if same_corpus:
            return lookup(facts, table, on, count, head_rows)
        return skewed_lookup(facts, table, on, head_rows)

    items = _exploded(df, key, tokens, model.order, first)
    context = None
    if model.order == 1 or same_corpus:  # every n-gram of the corpus is in the table, with its context
        found = attach(items, model.counts_with_context, _item_columns(model.order), "_count")
        if model.order == 2:
            context = F.coalesce("given", F.lit(0))
    else:
        found = attach(items, model.counts, _item_columns(model.order), "_count")
        found = attach(found, model.contexts, [CONTEXT], "_given")
        context = F.coalesce("_given", F.lit(0))
    logp = model.log_probability(F.coalesce("_count", F.lit(0)), context)
    out = [*key, "position", F.when(F.col("position").isNotNull(), logp).alias("logp")]
    if pad is not None:
        out.append((F.col(WORD) == pad).alias("is_pad"))
    return found.select(*out)


def log_perplexity(
    logprobs: DataFrame,
    key: Sequence[str],
    prompt_length: Column | None = None,
    is_pad: Column | None = None,
    count_padding: bool = False,
    name: str = "logppl",
) -> DataFrame:
    """Mean negative log-probability of the completion of each trace.

    Only positions from ``prompt_length`` on count. Padding is left out unless
    ``count_padding``. A trace without completion tokens gets NaN, which no
    threshold accepts.
    """
    counted = F.lit(True) if prompt_length is None else F.col("position") >= prompt_length
    if is_pad is not None and not count_padding:
        counted = counted & ~is_pad
    mean = F.avg(F.when(counted, -F.col("logp")))
    return logprobs.groupBy(*key).agg(F.coalesce(mean, F.lit(float("nan"))).alias(name))


def score_ngram(
    df: DataFrame,
    model: NgramModel,
    key: Sequence[str],
    tokens: str,
    prompt_length: Column | None = None,
    name: str = "logppl",
    head_rows: int = SMALL_ROWS,
    same_corpus: bool = True,
    pad: str | None = None,
    own_rows: bool = False,
) -> DataFrame:
    """Log-perplexity of each token array under the model.

    ``prompt_length`` may be any expression of the columns of ``df``; tokens
    before it, and tokens equal to ``pad``, do not count. ``own_rows`` says that
    the model counts the rows of ``df``, all of them and once each: the counts of
    bigrams are then taken from the rows as they are scored.
    """
    if own_rows and model.order == 2 and model.alpha > 0 and prompt_length is None and pad is None:
        sums = bigram_sums(
            _weighted(df, tokens, key, _w=F.lit(1)), key, tokens, model.words,
            lambda n: -F.log(n + model.alpha), lambda given: F.log(given + model.alpha * model.types), name, head_rows,
        )
        mean = F.try_divide(F.col(name), F.col("facts"))
        return sums.select(*key, F.coalesce(mean, F.lit(float("nan"))).alias(name))
    if model.order == 2 and not same_corpus:  # a bigram that is not in the table may have a known first word
        logprobs = token_logprobs(df, model, key, tokens, head_rows, same_corpus, pad, prompt_length)
        is_pad = None if pad is None else F.coalesce("is_pad", F.lit(False))
        return log_perplexity(logprobs, key, None, is_pad, name=name)
    items, columns = _exploded(df, key, tokens, model.order, prompt_length, pad), _item_columns(model.order)
    context = F.coalesce("given", F.lit(0)) if model.order == 2 else None
    values = {"_loss": -model.log_probability(F.coalesce("n", F.lit(0)), context)}
    counted = F.col("position").isNotNull()
    if same_corpus:
        sums = lookup_sums(items, model.counts_with_context, columns, "n", key, values, counted, head_rows)
    else:
        sums = skewed_lookup_sums(items, model.counts, columns, key, values, counted, head_rows)
    mean = F.try_divide(F.col("_loss"), F.col("facts"))
    return sums.select(*key, F.coalesce(mean, F.lit(float("nan"))).alias(name))


def cross_entropy_difference(
    df: DataFrame,
    key: Sequence[str],
    tokens: str,
    is_plus: Column,
    is_minus: Column,
    order: int = 1,
    alpha: float = 1.0,
    name: str = "difference",
    head_rows: int = SMALL_ROWS,
) -> DataFrame:
    """Mean of ``log p_plus - log p_minus`` over the n-grams of each row.

    Both corpora are rows of ``df``, marked by the two conditions; every row is
    scored. One count over ``df`` gives both models and the weight of each
    n-gram in the scored rows; with bigrams they are counted and scored in one
    shuffle. Both models share one set of word types. A row without n-grams gets
    null.
    """
    if order == 2 and alpha > 0:
        marked = _weighted(df, tokens, key, _p=is_plus.cast("int"), _m=is_minus.cast("int"))
        words = word_totals(marked, tokens, ["_p", "_m"])
        unseen = float(alpha) * (words.types() + 1)
        sums = bigram_sums(
            marked, key, tokens, words,
            lambda plus, minus: F.log(plus + float(alpha)) - F.log(minus + float(alpha)),
            lambda plus, minus: F.log(minus + unseen) - F.log(plus + unseen), "_gap", head_rows,
        )
        return sums.select(*key, F.try_divide(F.col("_gap"), F.col("facts")).alias(name))
    columns = _item_columns(order)
    marked = df.select(
        F.coalesce(is_plus, F.lit(False)).cast("long").alias("_p"),
        F.coalesce(is_minus, F.lit(False)).cast("long").alias("_m"),
        tokens,
    )
    marked = listed_ngrams(marked, tokens, order, "_p", "_m")
    counts = materialise(
        marked.groupBy(*columns).agg(
            F.count(F.lit(1)).alias("_n"), F.sum("_p").alias("_plus"), F.sum("_m").alias("_minus")
        ),
        "ngram-pair",
    )
    in_models = counts.where((F.col("_plus") > 0) | (F.col("_minus") > 0))
    types = in_models.select(WORD).distinct().count() + 1
    if order == 1:
        totals = counts.agg(F.sum("_plus"), F.sum("_minus")).first()
        given = [F.lit(float(total or 0)) for total in totals]
    else:
        contexts = materialise(
            counts.groupBy(CONTEXT).agg(
                F.sum("_n").alias("_all"), F.sum("_plus").alias("_plus_1"), F.sum("_minus").alias("_minus_1")
            ),
            "ngram-pair-contexts",
        )
        # joined to the counts, so that the rows of ``df`` are looked up once
        counts = materialise(lookup(counts, contexts, [CONTEXT], "_all", head_rows), "ngram-pair-given")
        given = [F.col("_plus_1"), F.col("_minus_1")]

    def log_probability(count: str, total: Column) -> Column:
        return F.log((F.col(count) + float(alpha)) / (total + float(alpha) * types))

    gap = log_probability("_plus", given[0]) - log_probability("_minus", given[1])
    counts = counts.withColumnRenamed("_n", "_weight")
    sums = lookup_sums(
        _exploded(df, key, tokens, order), counts, columns, "_weight", key, {"_gap": gap},
        F.col("position").isNotNull(), head_rows,
    )
    return sums.select(*key, F.try_divide(F.col("_gap"), F.col("facts")).alias(name))


def cross_entropy_difference_of(
    df: DataFrame,
    plus_corpus: DataFrame,
    minus_corpus: DataFrame,
    key: Sequence[str],
    tokens: str,
    **options,
) -> DataFrame:
    """The same score with the corpora in tables of their own."""
    corpora = [
        corpus.select(*[F.lit(None).cast(df.schema[k].dataType).alias(k) for k in key], tokens,
                      F.lit(side).alias("_side"))
        for side, corpus in (("plus", plus_corpus), ("minus", minus_corpus))
    ]
    scored = df.select(*key, tokens, F.lit("scored").alias("_side"))
    together = scored.unionByName(corpora[0]).unionByName(corpora[1])
    out = cross_entropy_difference(
        together, [*key, "_side"], tokens,
        F.col("_side") == "plus", F.col("_side") == "minus", **options,
    )
    return out.where(F.col("_side") == "scored").drop("_side")

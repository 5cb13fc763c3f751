"""The registered queries: one per operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from traceforge.constants import REJECTION_TARGET, REJECTION_THRESHOLD, SYSTEM_PROMPT
from traceforge.functions import answers, text, tokens
from traceforge.operators import (
    ablation,
    bootstrap,
    candidates as choose,
    conversations,
    coverage,
    encoding,
    grading,
    language_model as lm,
    ranking,
    rejection,
    shifted,
    stats,
    vectors,
)
from traceforge.plans import fixtures as fx, traces, training
from traceforge.sources import problems, tables
from traceforge.workspace import materialise, scratch_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

SEED = 42
PRICE_THRESHOLD = 2.5
TRACE_THRESHOLD = 3.64
FLUENT = 7.9
TEMPLATE = [2, 3]  # id pair searched in the word-length arrays


def register(query: Query) -> Query:
    QUERIES[query.__name__] = query
    return query


def rounded(column: str | Column, name: str) -> Column:
    value = F.col(column) if isinstance(column, str) else column
    return F.round(value, 6).alias(name)


def joined(ids: str) -> Column:
    return F.array_join(F.transform(ids, lambda i: i.cast("string")), ",").alias(ids)


# --- sources and sinks ----------------------------------------------------


@register
def load_problems_train(spark, sf_dir):
    return problems.load_problems(spark, "gsm8k_train", fx.problem_sources(sf_dir))


@register
def load_problems_holdout(spark, sf_dir):
    return problems.load_problems(spark, "math_holdout", fx.problem_sources(sf_dir))


@register
def load_problems_choice(spark, sf_dir):
    return problems.load_problems(spark, "mmlu_test", fx.problem_sources(sf_dir))


@register
def load_problems_test(spark, sf_dir):
    return problems.load_problems(spark, "gsm8k_test", fx.problem_sources(sf_dir))


@register
def concat_subsets(spark, sf_dir):
    documents = fx.table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars", "lang")
    return problems.subsets_of(documents, "lang")


@register
def trace_round_trip(spark, sf_dir):
    path = scratch_path(spark, "traces")
    graded = traces.graded_traces(fx.graded_fixture(spark, sf_dir))
    tables.write_traces(graded, path, partition_by=["run"])
    columns = ["problem_id", "run", "trace_af", "is_raw_correct", "is_af_correct"]
    return tables.read_traces(spark, path, columns)


@register
def run_registry(spark, sf_dir):
    path = scratch_path(spark, "registry")
    tables.append_run(_nested_runs(spark, sf_dir), path)
    schema = (
        "run string, `settings.batch` int, `stats.raw_accuracy` double,"
        " `stats.lengths.count` long, `stats.lengths.max` int"
    )
    runs = tables.read_runs(spark, path, schema)
    return runs.withColumn("stats.raw_accuracy", F.round(F.col("`stats.raw_accuracy`"), 6))


# --- text -----------------------------------------------------------------


@register
def format_mcq(spark, sf_dir):
    return fx.problem_sources(sf_dir)["mmlu"].pool(spark)


@register
def render_prompt(spark, sf_dir):
    turns = fx.table(spark, sf_dir, "conversations").where(F.col("role") == "user")
    return turns.select("conv_id", "turn", text.render_prompt(F.col("text")).alias("prompt"))


@register
def render_chat(spark, sf_dir):
    chat = text.render_chat(F.col("problem"), F.col("response"))
    return fx.conversation_pairs(spark, sf_dir).select("conv_id", "turn", chat.alias("chat"))


@register
def render_conversations(spark, sf_dir):
    turns = fx.table(spark, sf_dir, "conversations").withColumn("text", text.strip(F.col("text")))
    return conversations.render_conversations(turns, ["conv_id"], ["turn"], system=SYSTEM_PROMPT)


@register
def conversation_parts(spark, sf_dir):
    # parts of about 600 bytes, as a conversation beyond the size of a string would be given
    turns = fx.table(spark, sf_dir, "conversations")
    return conversations.render_conversations(
        turns, ["conv_id"], ["turn"], segment_bytes=300, part_bytes=600, group_rows=3
    )


@register
def clean_trace(spark, sf_dir):
    padded = F.concat(F.lit("[PAD]<s>"), "text", F.lit("</s><s>[PAD]</s>[PAD]"))
    cleaned = text.clean_trace(padded, pad="[PAD]", bos="<s>", eos="</s>")
    return fx.table(spark, sf_dir, "documents").select("doc_id", cleaned.alias("trace"))


@register
def response_family(spark, sf_dir):
    family = text.response_family(F.col("trace")).alias("family")
    return fx.family_fixture(spark, sf_dir).select("doc_id", family)


@register
def extract_response(spark, sf_dir):
    good, _ = encoding.split_responses(fx.family_fixture(spark, sf_dir), "trace")
    return good.select("doc_id", "response")


@register
def quarantined_responses(spark, sf_dir):
    _, bad = encoding.split_responses(fx.family_fixture(spark, sf_dir), "trace")
    return bad.select("doc_id", "reason")


@register
def force_answer(spark, sf_dir):
    forced = text.force_answer_by_family(F.col("trace")).alias("trace_af")
    return fx.family_fixture(spark, sf_dir).select("doc_id", forced)


# --- tokens ---------------------------------------------------------------


@register
def tokenize(spark, sf_dir):
    return fx.document_tokens(spark, sf_dir).select(
        "doc_id", F.array_join("tokens", " ").alias("tokens"), F.size("tokens").alias("length")
    )


@register
def tokens_without_loss(spark, sf_dir):
    return fx.document_tokens(spark, sf_dir).select("doc_id", F.array_join("tokens", "").alias("joined"))


@register
def vocabulary(spark, sf_dir):
    return encoding.vocabulary(fx.document_tokens(spark, sf_dir), "tokens")


@register
def encode_tokens(spark, sf_dir):
    listed = _written_tokens(spark, sf_dir)
    vocab = encoding.vocabulary(listed, "tokens")
    ids = encoding.encode(listed, ["doc_id"], "tokens", vocab)
    return ids.select("doc_id", joined("input_ids"), F.size("input_ids").alias("length"))


@register
def strip_trailing(spark, sf_dir):
    ids = fx.document_ids(spark, sf_dir).withColumn("ids", F.concat("ids", F.array(F.lit(9), F.lit(9))))
    return ids.select("doc_id", tokens.strip_trailing(F.col("ids"), 9).alias("ids")).select(
        "doc_id", joined("ids"), F.size("ids").alias("length")
    )


@register
def truncate(spark, sf_dir):
    ids = fx.document_ids(spark, sf_dir)
    return ids.select(
        "doc_id",
        tokens.is_truncated(F.col("ids")).alias("was_truncated"),
        tokens.truncate(F.col("ids")).alias("ids"),
    ).withColumn("ids", joined("ids"))


@register
def completion_mask(spark, sf_dir):
    labels = tokens.completion_mask(F.col("ids"), TEMPLATE, pad=1).alias("labels")
    return fx.document_ids(spark, sf_dir).select("doc_id", labels).select("doc_id", joined("labels"))


@register
def validate_training_rows(spark, sf_dir):
    return encoding.validation_report(fx.document_ids(spark, sf_dir), "ids", TEMPLATE)


@register
def training_rows(spark, sf_dir):
    pairs = fx.conversation_pairs(spark, sf_dir)
    rows = training.chat_training_rows(pairs, ["conv_id", "turn"])
    return rows.select(
        "conv_id", "turn", joined("input_ids"), "was_truncated", joined("labels"), "problem_found"
    )


# --- grading --------------------------------------------------------------


@register
def extract_answers(spark, sf_dir):
    answer = answers.extract_answer(F.col("text"))
    return fx.answer_forms(spark, sf_dir).select(
        "problem_id",
        answer.alias("answer"),
        answers.normalise_answer(answer).alias("normal"),
        rounded(answers.numeric_answer(answers.normalise_answer(answer)), "value"),
    )


@register
def grade(spark, sf_dir):
    graded = grading.grade(fx.graded_fixture(spark, sf_dir), "trace", "solution")
    return graded.select("problem_id", "is_correct")


@register
def grade_against(spark, sf_dir):
    answer = (F.col("l_orderkey") + (F.col("l_linenumber") % 2)) % 97
    tried = fx.candidates(spark, sf_dir).select(*fx.LINE, fx.boxed(answer).alias("trace"))
    solutions = fx.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"), fx.boxed(F.col("o_orderkey") % 97).alias("solution")
    )
    graded = grading.grade_against(tried, solutions, ["l_orderkey"], "trace")
    return graded.select(*fx.LINE, "is_correct")


@register
def grade_edge_answers(spark, sf_dir):
    graded = grading.grade(fx.edge_answers(spark, sf_dir), "trace", "solution")
    return graded.select("problem_id", "is_correct")


def _written_tokens(spark, sf_dir):
    """Document tokens as a table, for queries that read them several times."""
    return materialise(fx.document_tokens(spark, sf_dir), "tokens")


def _accuracy_by_run(spark, sf_dir):
    return grading.accuracy(traces.graded_traces(fx.graded_fixture(spark, sf_dir)), ["run"])


@register
def graded_traces(spark, sf_dir):
    graded = traces.graded_traces(
        fx.graded_fixture(spark, sf_dir),
        fx.table(spark, sf_dir, "orders").select(
            F.col("o_orderkey").alias("problem_id"),
            F.concat((F.col("o_orderkey") % 97).cast("string"), F.lit("}\\]<|im_end|>")).alias("continuation"),
        ),
    )
    return graded.select("problem_id", "trace_af", "is_raw_correct", "is_af_correct")


def _built(spark, sf_dir):
    problems_ = fx.graded_fixture(spark, sf_dir).select("problem_id", "problem", "solution")
    return traces.build_traces(
        problems_, fx.candidate_traces(spark, sf_dir), shards=4, threshold=TRACE_THRESHOLD
    )


@register
def trace_dataset(spark, sf_dir):
    return _built(spark, sf_dir)[0].select(
        "problem_id", "candidate", "shard", "prompt", "solution", "trace",
        rounded("trace_logppl", "trace_logppl"), "accept_rank", "trace_af",
        "is_raw_correct", "is_af_correct",
    )


@register
def trace_dataset_report(spark, sf_dir):
    report = _built(spark, sf_dir)[1]
    return report.select("shard", "generated", "rejected", "accepted", "exhausted")


@register
def trace_dataset_plain(spark, sf_dir):
    built, _ = traces.build_traces(
        fx.plain_fixture(spark, sf_dir), fx.candidate_traces(spark, sf_dir), shards=4, threshold=None,
        continuations=fx.continuations(spark, sf_dir), prompt_in_score=True,
    )
    return built.select(
        "problem_id", "candidate", "shard", "prompt", rounded("trace_logppl", "trace_logppl"),
        "trace_af", "is_raw_correct", "is_af_correct",
    )


@register
def accuracy(spark, sf_dir):
    return _accuracy_by_run(spark, sf_dir).select(
        "run", "traces", rounded("raw_accuracy", "raw_accuracy"), rounded("af_accuracy", "af_accuracy")
    )


@register
def compare_runs(spark, sf_dir):
    compared = grading.compare_runs(_accuracy_by_run(spark, sf_dir), "1-URGENT")
    return compared.select(
        "run",
        rounded("raw_accuracy_delta", "raw_accuracy_delta"),
        rounded("af_accuracy_delta", "af_accuracy_delta"),
    )


@register
def accuracy_intervals(spark, sf_dir):
    # orders of one priority are a run; the forced answers put some of its traces right
    graded = fx.graded_fixture(spark, sf_dir).transform(grading.grade, "trace", "solution")
    out = bootstrap.accuracy_intervals(graded, "is_correct", "problem_id", "run", "1-URGENT", seed=SEED)
    return out.select("run", "traces", *[rounded(c, c) for c in out.columns[2:]])


@register
def defence_comparison(spark, sf_dir):
    # choose an answer per order with and without the shifted scores, grade, compare within a priority
    base = materialise(fx.candidates(spark, sf_dir), "candidates")
    sides = [base.select(*fx.LINE, F.col(side).alias("score")) for side in ("plus", "minus")]
    drawn = []
    for run, lam in (("clean", 0.0), ("defended", 0.1)):
        adjusted = materialise(choose.rescore(base, *sides, fx.LINE, lam=lam, eps=0.01), "adjusted")
        scored = choose.softmax_scores(adjusted, ["l_orderkey"], fx.CANDIDATE, "adjusted", tau=2.0)
        kept = choose.nucleus(scored, ["l_orderkey"], fx.CANDIDATE)
        drawn.append(choose.sample_one(kept, ["l_orderkey"], fx.CANDIDATE, SEED).withColumn("run", F.lit(run)))
    answer = fx.boxed((F.col("l_orderkey") + F.col("l_linenumber") % 2) % 97)
    solutions = fx.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"), fx.boxed(F.col("o_orderkey") % 97).alias("solution"),
        F.col("o_orderpriority").alias("split"),
    )
    tried = drawn[0].unionByName(drawn[1]).withColumn("trace", answer).join(solutions, "l_orderkey")
    graded = grading.grade(tried, "trace", "solution", "is_raw_correct")
    totals = materialise(grading.accuracy(graded, ["split", "run"], forced=None), "accuracies")
    compared = grading.compare_runs(totals, "clean", metrics=["raw_accuracy"], by=["split"])
    return compared.select(
        "split", "run", "traces", rounded("raw_accuracy", "raw_accuracy"),
        rounded("raw_accuracy_delta", "raw_accuracy_delta"),
    )


# --- ranks, splits, shards ------------------------------------------------


def _orders(spark, sf_dir):
    return fx.table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority")


@register
def global_rank(spark, sf_dir):
    return ranking.global_rank(_orders(spark, sf_dir), "o_orderkey", SEED)


@register
def stored_rank(spark, sf_dir):
    return ranking.stored_rank(_orders(spark, sf_dir), ["o_totalprice", "o_orderkey"])


@register
def split_seeded(spark, sf_dir):
    return ranking.with_split(_orders(spark, sf_dir), "o_orderkey", SEED)


@register
def limit_n(spark, sf_dir):
    return ranking.limit_n(_orders(spark, sf_dir), "o_orderkey", 500)


@register
def shard_contiguous(spark, sf_dir):
    return ranking.with_shard(_orders(spark, sf_dir), "o_orderkey", 7)


@register
def shard_strided(spark, sf_dir):
    return ranking.with_shard(_orders(spark, sf_dir), "o_orderkey", 7, contiguous=False)


@register
def batch_plan(spark, sf_dir):
    documents = fx.table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return ranking.batch_plan(documents, "doc_id", "n_chars", 64)


@register
def example_rows(spark, sf_dir):
    return ranking.example_rows(_orders(spark, sf_dir), "o_orderkey", 20, SEED)


# --- choosing candidates --------------------------------------------------


def _rejection_run(spark, sf_dir):
    return rejection.RejectionRun(
        fx.candidates(spark, sf_dir), fx.LINE, "price", SEED, shard="shard", cycle="l_linenumber",
        threshold=PRICE_THRESHOLD, target=2 * REJECTION_TARGET,
    )


@register
def rejection_sample(spark, sf_dir):
    accepted = _rejection_run(spark, sf_dir).accepted()
    return accepted.select(*fx.LINE, "shard", rounded("price", "price"), "accept_rank")


@register
def rejection_report(spark, sf_dir):
    report = _rejection_run(spark, sf_dir).report()
    return report.withColumns(
        {c: F.round(c, 6) for c in ("acceptance_rate", "max_accepted", "mean_accepted")}
    )


def _lazy_run(spark, sf_dir):
    # prices are looked up for tried candidates alone
    lines = materialise(fx.candidates(spark, sf_dir).select(*fx.LINE, "shard"), "candidates")

    def scorer(rows, columns):
        priced = fx.candidates(spark, sf_dir).select(*fx.LINE, "price")
        return rows.select(*columns).join(priced, fx.LINE)

    return rejection.RejectionRun(
        lines, fx.LINE, "price", SEED, shard="shard", threshold=PRICE_THRESHOLD, target=REJECTION_TARGET, scorer=scorer
    )


@register
def rejection_lazy(spark, sf_dir):
    accepted = _lazy_run(spark, sf_dir).accepted()
    return accepted.select(*fx.LINE, "shard", rounded("price", "price"), "accept_rank")


@register
def rejection_lazy_report(spark, sf_dir):
    return _lazy_run(spark, sf_dir).report().select("shard", "generated", "rejected", "accepted", "exhausted")


@register
def rejection_unplaced(spark, sf_dir):
    # orders that no shard was given
    lost = fx.candidates(spark, sf_dir).withColumn("shard", F.when(F.col("l_orderkey") % 11 > 0, F.col("shard")))
    run = rejection.RejectionRun(lost, fx.LINE, "price", SEED, shard="shard", threshold=PRICE_THRESHOLD)
    tried = run.report().where(F.col("shard").isNull()).select(
        F.lit("placed").alias("part"), F.col("accepted"), F.col("rejected")
    )
    none = F.lit(0).cast("long")
    rest = run.unplaced().agg(F.count(F.lit(1)).alias("rows"))
    return tried.unionByName(rest.select(F.lit("unplaced").alias("part"), none.alias("accepted"), F.col("rows").alias("rejected")))


@register
def softmax_scores(spark, sf_dir):
    scored = choose.softmax_scores(
        fx.candidates(spark, sf_dir), ["l_orderkey"], fx.CANDIDATE, tau=2.0
    )
    return scored.select(*fx.LINE, rounded("probability", "probability"))


@register
def softmax_greedy(spark, sf_dir):
    scored = choose.softmax_scores(fx.candidates(spark, sf_dir), ["l_orderkey"], fx.CANDIDATE, tau=0)
    return scored.select(*fx.LINE, rounded("probability", "probability"))


def _nucleus(spark, sf_dir):
    scored = choose.softmax_scores(
        fx.candidates(spark, sf_dir), ["l_orderkey"], fx.CANDIDATE, tau=2.0
    )
    return choose.nucleus(scored, ["l_orderkey"], fx.CANDIDATE)


@register
def nucleus(spark, sf_dir):
    return _nucleus(spark, sf_dir).select(*fx.LINE, rounded("probability", "probability"))


@register
def sample_one(spark, sf_dir):
    return choose.sample_one(_nucleus(spark, sf_dir), ["l_orderkey"], fx.CANDIDATE, SEED)


@register
def undecided_groups(spark, sf_dir):
    # every third order has scores that cannot be used, in part or throughout
    key = F.col("l_orderkey") % 9
    bad = F.when(key == 0, F.lit(None)).when(key == 3, float("nan")).when(
        (key == 6) & (F.col("l_linenumber") % 2 == 0), float("inf")
    ).otherwise(F.col("score"))
    scores = fx.candidates(spark, sf_dir).withColumn("score", bad)
    scored = choose.softmax_scores(scores, ["l_orderkey"], fx.CANDIDATE, tau=2.0)
    return choose.undecided(scored, ["l_orderkey"])


@register
def rescore(spark, sf_dir):
    base = fx.candidates(spark, sf_dir)
    sides = {
        side: base.select(*fx.LINE, F.col(side).alias("score")) for side in ("plus", "minus")
    }
    adjusted = choose.rescore(base, sides["plus"], sides["minus"], fx.LINE, lam=0.1, eps=0.01)
    return adjusted.select(*fx.LINE, rounded("adjusted", "adjusted"))


SHIFT = 0.5


def _shifted(spark, sf_dir):
    """Score tables of the candidate traces; the gradient is that of the traces of even line numbers, which are right."""
    key = ["problem_id", "candidate"]
    tried = fx.candidate_traces(spark, sf_dir).select(*key, tokens.words(F.col("trace")).alias("tokens"))
    tried = materialise(tried, "tokens")
    clean = tried.where(F.substring_index("candidate", "-", 1).cast("int") % 2 == 0)
    model = lm.fit_ngram(tried, "tokens", alpha=0.5)
    return shifted.shifted_scores(tried, clean, key, "tokens", SHIFT, model)


@register
def shifted_scores(spark, sf_dir):
    key = ["problem_id", "candidate"]
    scores = _shifted(spark, sf_dir).together.withColumnRenamed("base", "score")
    return scores.select(*key, *[rounded(c, c) for c in ("score", "plus", "minus")])


@register
def defence_comparison_shifted(spark, sf_dir):
    # as defence_comparison, with scores of the traces under the model and its shifted copies
    key = ["problem_id", "candidate"]
    together = _shifted(spark, sf_dir).together
    scores = together.select(*key, F.round("base", 9).alias("score"), *[F.round(side, 9).alias(side) for side in ("plus", "minus")])
    drawn = []
    for run, lam in (("clean", 0.0), ("defended", 40.0)):
        adjusted = choose.rescore(scores, "plus", "minus", key, lam=lam, eps=SHIFT).withColumn("adjusted", F.round("adjusted", 6))
        adjusted = materialise(adjusted, "adjusted")
        scored = choose.softmax_scores(adjusted, key[:1], key[1:], "adjusted", tau=0.25)
        kept = choose.nucleus(scored, key[:1], key[1:])
        drawn.append(choose.sample_one(kept, key[:1], key[1:], SEED).withColumn("run", F.lit(run)))
    tried = drawn[0].unionByName(drawn[1]).select(*key, "run").join(fx.candidate_traces(spark, sf_dir), key)
    solutions = fx.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("problem_id"), fx.boxed(F.col("o_orderkey") % 97).alias("solution")
    )
    graded = grading.grade_against(tried, solutions, ["problem_id"], "trace", name="is_raw_correct")
    totals = materialise(grading.accuracy(graded, ["run"], forced=None), "accuracies")
    compared = grading.compare_runs(totals, "clean", metrics=["raw_accuracy"])
    return compared.select(
        "run", "traces", rounded("raw_accuracy", "raw_accuracy"), rounded("raw_accuracy_delta", "raw_accuracy_delta")
    )


# --- language models and vectors ------------------------------------------


@register
def log_perplexity(spark, sf_dir):
    listed = _written_tokens(spark, sf_dir)
    model = lm.fit_ngram(listed, "tokens")
    scored = lm.score_ngram(listed, model, ["doc_id"], "tokens", prompt_length=F.lit(10))
    return scored.select("doc_id", F.round(F.nanvl("logppl", F.lit(-1.0)), 6).alias("logppl"))


@register
def fit_unigram(spark, sf_dir):
    model = lm.fit_ngram(fx.document_tokens(spark, sf_dir), "tokens", alpha=0.5)
    return model.counts.select("w2", "n", rounded(model.log_probability(F.col("n")), "logp"))


@register
def fit_bigram(spark, sf_dir):
    model = lm.fit_ngram(fx.document_tokens(spark, sf_dir), "tokens", order=2, alpha=0.5)
    return model.counts.select("w1", "w2", "n")


@register
def score_bigram(spark, sf_dir):
    listed = _written_tokens(spark, sf_dir)
    model = lm.fit_ngram(listed, "tokens", order=2, alpha=0.5)
    scored = lm.score_ngram(listed, model, ["doc_id"], "tokens", own_rows=True)
    return scored.select("doc_id", F.round(F.nanvl("logppl", F.lit(-1.0)), 6).alias("logppl"))


@register
def score_other_corpus(spark, sf_dir):
    # replies under a model of the documents
    model = lm.fit_ngram(fx.document_tokens(spark, sf_dir), "tokens")
    replies = fx.conversation_pairs(spark, sf_dir).select(
        "conv_id", "turn", tokens.words(F.col("response")).alias("tokens")
    )
    scored = lm.score_ngram(replies, model, ["conv_id", "turn"], "tokens", same_corpus=False)
    return scored.select("conv_id", "turn", F.round(F.nanvl("logppl", F.lit(-1.0)), 6).alias("logppl"))


def _difference(spark, sf_dir, order):
    labels = fx.table(spark, sf_dir, "labels").select("doc_id", "quality")
    listed = _written_tokens(spark, sf_dir).join(labels, "doc_id", "left")
    scored = lm.cross_entropy_difference(
        listed, ["doc_id"], "tokens", F.col("quality") == 1, F.col("quality") == 0, order
    )
    return scored.select("doc_id", rounded("difference", "difference"))


@register
def cross_entropy_difference(spark, sf_dir):
    return _difference(spark, sf_dir, 1)


@register
def cross_entropy_difference_bigram(spark, sf_dir):
    return _difference(spark, sf_dir, 2)


@register
def vector_mean(spark, sf_dir):
    weighted = fx.table(spark, sf_dir, "embeddings").withColumn("w", F.col("vec_id") % 5 + 1)
    mean = vectors.vector_mean(weighted, "embedding", "w", ["label"])
    return vectors.long_vector(mean, "mean", ["label"]).select(
        "label", "dim", rounded("value", "value")
    )


@register
def mean_vector_norms(spark, sf_dir):
    weighted = fx.table(spark, sf_dir, "embeddings").withColumn("w", F.col("vec_id") % 5 + 1)
    norms = training.mean_vectors(weighted, "embedding", "w", ["label"])
    return norms.select("label", rounded("norm", "norm"), rounded("rms", "rms"), "elements")


@register
def vector_norms(spark, sf_dir):
    norms = vectors.vector_norms(fx.table(spark, sf_dir, "embeddings"), "embedding")
    return norms.select("vec_id", rounded("norm", "norm"), rounded("rms", "rms"), "elements")


@register
def vector_norms_by_label(spark, sf_dir):
    norms = vectors.vector_norms(fx.table(spark, sf_dir, "embeddings"), "embedding", ["label"])
    return norms.select("label", rounded("norm", "norm"), rounded("rms", "rms"), "elements")


@register
def key_coverage(spark, sf_dir):
    lines = fx.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return coverage.key_coverage(lines, fx.table(spark, sf_dir, "orders"), ["o_orderkey"])


# --- reports --------------------------------------------------------------


def _rounded_statistics(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in stats.STATISTICS if c != "count"})


@register
def describe_lengths(spark, sf_dir):
    sized = fx.document_tokens(spark, sf_dir).select("lang", F.size("tokens").alias("length"))
    return _rounded_statistics(stats.describe(sized, "length", ["lang"]))


@register
def describe_all(spark, sf_dir):
    return _rounded_statistics(stats.describe(fx.table(spark, sf_dir, "lineitem"), "l_extendedprice"))


def _nested_runs(spark, sf_dir):
    graded = grading.grade(fx.graded_fixture(spark, sf_dir), "trace", "solution", "is_raw_correct")
    totals = graded.groupBy("run").agg(
        F.avg(F.col("is_raw_correct").cast("double")).alias("raw"),
        F.count(F.lit(1)).alias("count"),
        F.max(F.length("trace")).alias("max"),
    )
    return totals.select(
        "run",
        F.struct(F.lit(512).alias("batch"), F.struct().alias("empty")).alias("settings"),
        F.struct(
            F.col("raw").alias("raw_accuracy"), F.struct("count", "max").alias("lengths")
        ).alias("stats"),
    )


@register
def flatten_struct(spark, sf_dir):
    flat = stats.flatten_struct(_nested_runs(spark, sf_dir))
    return flat.withColumn("stats.raw_accuracy", F.round(F.col("`stats.raw_accuracy`"), 6))


def _run_record(spark, sf_dir):
    """The record of the run that builds ``trace_dataset``."""
    built, report = _built(spark, sf_dir)
    measured = materialise(
        built.select(
            "is_raw_correct", "is_af_correct", "trace_logppl",
            F.size(tokens.words(F.col("trace_af"))).alias("length"),
        ),
        "measured",
    )
    total = materialise(report.where(F.col("shard").isNull()).drop("shard"), "report")
    settings = {"data_split": "gsm8k_train", "tau": 2.0}
    return stats.run_record(measured, settings, "length", "trace_logppl", rejection=total)


@register
def run_record(spark, sf_dir):
    flat = stats.flatten_struct(_run_record(spark, sf_dir))
    doubles = [f.name for f in flat.schema if f.dataType.typeName() == "double"]
    return flat.select(
        [F.round(F.col(f"`{c}`"), 6).alias(c) if c in doubles else F.col(f"`{c}`") for c in flat.columns]
    )


@register
def stored_settings(spark, sf_dir):
    # the record appended and read again; what a later run does not set is taken from it
    path = scratch_path(spark, "registry")
    tables.append_run(_run_record(spark, sf_dir), path)
    schema = "data_split string, tau double, `stats.raw_accuracy` double, `stats.trace_len_stats.count` long"
    stored = tables.read_runs(spark, path, schema)
    used = stats.with_stored_settings({"tau": 0.5, "data_split": None}, stored)
    return used.withColumn("stats.raw_accuracy", F.round(F.col("`stats.raw_accuracy`"), 6))


def _student_loss(spark, sf_dir, order):
    listed = materialise(ranking.with_split(_written_tokens(spark, sf_dir), "doc_id", SEED), "ablation")
    train = listed.where("split = 'train'")
    perplexity = lm.score_ngram(train, lm.fit_ngram(train, "tokens"), ["doc_id"], "tokens")
    labels = fx.table(spark, sf_dir, "labels").select("doc_id", "quality")
    marked = listed.join(perplexity, "doc_id", "left").join(labels, "doc_id", "left")
    selections = {
        "all": F.lit(True), "fluent": F.col("logppl") <= FLUENT, "good": F.col("quality") == 1,
    }
    losses = ablation.student_loss(marked, selections, F.col("split") == "holdout", "all", order=order)
    return losses.select(
        "train_set", "rows", *[rounded(c, c) for c in ("loss", "perplexity", "loss_delta")]
    )


@register
def dataset_ablation(spark, sf_dir):
    return _student_loss(spark, sf_dir, 1)


@register
def dataset_ablation_bigram(spark, sf_dir):
    return _student_loss(spark, sf_dir, 2)


@register
def accepted_replies(spark, sf_dir):
    accepted = traces.accepted_replies(
        fx.table(spark, sf_dir, "conversations"), threshold=REJECTION_THRESHOLD, target=25, shards=4
    )
    return accepted.select(
        "conv_id", "turn", "shard", rounded("logppl", "logppl"), "accept_rank", "problem", "response"
    )

"""Inputs of the operators, derived by Spark from the given tables.

Each works on whole tables, so a query over it grows with them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from traceforge.constants import ANSWER_FORCE_STRING, R1_SENTENCE_END, RESPONSE_MARKERS
from traceforge.functions.tokens import words
from traceforge.sources.problems import (
    KEY,
    ProblemSource,
    as_problems,
    exchanges,
    mcq_as_problems,
)
from traceforge.workspace import SPREAD_ROWS, spread

# Gold answer, trace and whether the trace is right; # stands for the key.
EDGE_CASES = [
    ("\\boxed{#}", "\\boxed{#}", True),
    ("\\boxed{#}", "\\boxed{#1}", False),
    ("#### #", "\\boxed{# \\text{ dollars}}", True),
    ("\\boxed{#}", "\\boxed{#\\%}", True),
    ("\\boxed{\\frac{#}{7}}", "\\boxed{\\dfrac{#}{7}}", True),
    ("\\boxed{\\frac{#}{7}}", "\\boxed{\\frac{#}{9}}", False),
    ("\\boxed{\\frac{\\sqrt{\\frac{1}{#}}}{3}}", "\\boxed{\\frac{\\sqrt{\\frac{5}{#}}}{3}}", False),
    ("\\boxed{\\frac{\\sqrt{\\frac{1}{#}}}{3}}", "so \\boxed{ \\frac{\\sqrt{\\frac{1}{#}}}{3} }", True),
    ("\\boxed{#,5}", "\\boxed{(#,5)}", False),
    ("\\boxed{9007199254740992#}", "\\boxed{9007199254740993#}", False),
    ("\\boxed{1e999}", "\\boxed{2e999}", False),
    ("\\boxed{\\frac12}", "\\boxed{0.5}, not #", True),
    ("\\boxed{#}", "\\boxed{#.0000}", True),
    ("\\boxed{#}", "it is #, then \\boxed{open", True),
    ("\\boxed{#}", "no answer", False),
    ("\\boxed{x_{#}}", "\\boxed{1} or \\boxed{X_{#}}.", True),
    ("\\boxed{#\\frac{1}{2}}", "\\boxed{#.5}", True),
    ("\\boxed{#\\frac{1}{2}}", "\\boxed{#1/2}", False),
    ("\\boxed{#{,}000}", "\\boxed{#000}", True),
    ("\\boxed{\\text{(A)}}", "\\boxed{A}, not #", True),
    ("\\boxed{x=#}", "\\boxed{#}", True),
    ("\\boxed{x=#}", "\\boxed{y=#}", False),
    ("\\boxed{# \\text{ km}}", "\\boxed{# \\text{ m}}", False),
    ("\\boxed{# \\text{ km}}", "\\boxed{#\\,\\mathrm{km}}", True),
    ("\\boxed{\\{#, -1\\}}", "\\boxed{\\{-1, #\\}}", True),
    ("\\boxed{(#,-1)}", "\\boxed{(-1,#)}", False),
    ("\\boxed{[-1,#)}", "\\boxed{\\left[-1, #\\right)}", True),
    ("\\boxed{[-1,#)}", "\\boxed{[-1,#]}", False),
    ("\\boxed{(x+#)^2}", "\\boxed{x^2+2\\cdot #x+#^2}", True),
    ("\\boxed{(x+#)^2}", "\\boxed{x^2+#^2}", False),
    ("\\boxed{}", "\\boxed{} #", False),
]
CANDIDATE = ["l_linenumber", "l_partkey", "l_suppkey"]
LINE = ["l_orderkey", *CANDIDATE]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document texts, over all cores: what follows parses them."""
    texts = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return spread(texts, "doc_id", max_rows=SPREAD_ROWS)


def _text(value: Column) -> Column:
    return value.cast("string")


def boxed(value: Column) -> Column:
    return F.concat(F.lit("\\boxed{"), _text(value), F.lit("}"))


def graded_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as solved problems. The body is wrong for every fifth key; a forced
    answer puts every tenth right again."""
    key = F.col("o_orderkey")
    answer = F.when(key % 5 == 0, key + 1).otherwise(key) % 97
    forced = F.when(
        key % 10 == 0,
        F.concat(F.lit(ANSWER_FORCE_STRING), _text(key % 97), F.lit("}\\]")),
    ).otherwise("")
    trace = F.concat(
        F.lit("<|im_start|>user\nq "), _text(key),
        F.lit("<|im_end|>\n<|im_start|>assistant\nwork "), boxed(answer), F.lit("<|im_end|>"), forced,
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    return spread(orders, "o_orderkey").select(
        key.alias(KEY),
        F.col("o_orderpriority").alias("run"),
        F.concat(F.lit("q "), _text(key)).alias("problem"),
        boxed(key % 97).alias("solution"),
        trace.alias("trace"),
    )


def family_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document texts as responses of three model families, and some of none."""
    key, text = F.col("doc_id"), F.col("text")
    qwen = F.concat(F.lit(RESPONSE_MARKERS["qwen"]), text, F.lit("<|im_end|>\n<|im_end|>"))
    r1 = F.concat(F.lit(RESPONSE_MARKERS["r1"]), text, F.lit("</think>"), F.lit(R1_SENTENCE_END))
    llama = F.concat(F.lit(RESPONSE_MARKERS["llama"]), text)
    trace = F.when(key % 4 == 0, qwen).when(key % 4 == 1, r1).when(key % 4 == 2, llama)
    return documents(spark, sf_dir).select(
        "doc_id", F.concat(F.lit("<s>ask "), F.coalesce(trace, text)).alias("trace")
    )


def answer_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same order key as an answer in several spellings, beside a plain one."""
    key = F.col("o_orderkey")
    spelled = (
        F.when(key % 6 == 0, F.concat(F.lit("so \\boxed{\\dfrac{"), _text(key), F.lit("}{4}} done")))
        .when(key % 6 == 1, F.concat(F.lit("\\boxed{1} then \\boxed{\\text{"), _text(key), F.lit("} }")))
        .when(key % 6 == 2, F.concat(F.lit("it is $"), _text(key), F.lit(",000.")))
        .when(key % 6 == 3, F.concat(F.lit("\\boxed{"), _text(key), F.lit(" and 12/5")))
        .when(key % 6 == 4, F.concat(F.lit("\\boxed{\\left( "), _text(key), F.lit(".50 \\right)}")))
        .otherwise(F.lit("no answer"))
    )
    return table(spark, sf_dir, "orders").select(key.alias(KEY), spelled.alias("text"))


def edge_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order keys as gold answers beside one of ``EDGE_CASES``, chosen by the key."""
    key = _text(F.col("o_orderkey"))
    case = F.pmod("o_orderkey", F.lit(len(EDGE_CASES))).cast("int")

    def filled(i: int) -> Column:
        forms = [F.replace(F.lit(c[i]), F.lit("#"), key) for c in EDGE_CASES]
        return F.get(F.array(*forms), case)

    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias(KEY), filled(0).alias("solution"), filled(1).alias("trace")
    )


def plain_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as problems whose prompts differ in length."""
    key = F.col("o_orderkey")
    please = F.repeat(F.lit("please "), F.pmod(key, F.lit(3)).cast("int"))
    return table(spark, sf_dir, "orders").select(
        key.alias(KEY), F.concat(please, F.lit("q "), _text(key)).alias("problem"),
        boxed(key % 97).alias("solution"),
    )


def continuations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What follows a forced answer: right, except for every third line number."""
    wrong = (F.col("l_linenumber") % 3 == 0).cast("int")
    lines = table(spark, sf_dir, "lineitem").select(*LINE).distinct()
    return lines.select(
        F.col("l_orderkey").alias(KEY),
        F.concat_ws("-", *[_text(F.col(c)) for c in CANDIDATE]).alias("candidate"),
        F.concat(_text((F.col("l_orderkey") + wrong) % 97), F.lit("}\\]<|im_end|>")).alias("continuation"),
    )


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as scored candidates of their order, one row per key."""
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(*LINE)
        .agg(
            (F.min("l_extendedprice") / F.lit(10000.0)).alias("price"),
            (F.min("l_discount") * F.lit(100.0)).alias("score"),
            F.min("l_tax").alias("plus"),
            (F.min("l_quantity") / F.lit(50.0)).alias("minus"),
        )
        .withColumn("shard", F.pmod("l_orderkey", F.lit(4)))
    )


def candidate_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as candidate answers to their order; odd line numbers are wrong."""
    answer = (F.col("l_orderkey") + F.col("l_linenumber") % 2) % 97
    trace = F.concat(
        F.lit("<|im_start|>assistant\nflag "), F.min("l_returnflag"), F.lit(" part "),
        _text(F.col("l_partkey")), F.lit(" status "), F.min("l_linestatus"), F.lit(" so "),
        boxed(answer), F.lit("<|im_end|>"),
    )
    return table(spark, sf_dir, "lineitem").groupBy(*LINE).agg(trace.alias("trace")).select(
        F.col("l_orderkey").alias(KEY),
        F.concat_ws("-", *[_text(F.col(c)) for c in CANDIDATE]).alias("candidate"),
        "trace",
    )


def document_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", "lang", words(F.col("text")).alias("tokens"))


def document_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word lengths of each document as small ids."""
    return document_tokens(spark, sf_dir).select(
        "doc_id", F.transform("tokens", lambda t: F.length(t)).alias("ids")
    )


def conversation_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exchanges(table(spark, sf_dir, "conversations"))


def problem_sources(sf_dir: str) -> dict[str, ProblemSource]:
    """The three named sources, backed by the given tables."""

    def word_problems(spark):
        return graded_fixture(spark, sf_dir).select(KEY, "problem", "solution")

    def competition(spark):
        texts = table(spark, sf_dir, "documents").withColumnRenamed("lang", "subset")
        return as_problems(texts, "doc_id", "text", "source", "subset")

    def choice(spark):
        rows = table(spark, sf_dir, "part").select(
            "p_partkey",
            F.col("p_name").alias("question"),
            F.array("p_brand", "p_type", _text(F.col("p_size")), F.lit("none")).alias("choices"),
            (F.col("p_partkey") % 4).alias("answer"),
        )
        return mcq_as_problems(rows, "p_partkey")

    def benchmark(spark):
        return as_problems(table(spark, sf_dir, "benchmark"), "item_id", "text", "text")

    return {
        "gsm8k": ProblemSource(word_problems, benchmark),
        "math": ProblemSource(competition, benchmark, shuffled=True),
        "mmlu": ProblemSource(choice, choice),
    }

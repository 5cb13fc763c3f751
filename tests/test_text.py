import pytest
from pyspark.sql import functions as F

from traceforge.constants import ANSWER_FORCE_STRING, RESPONSE_MARKERS, SYSTEM_PROMPT
from traceforge.functions import text as tx
from traceforge.operators.encoding import split_responses

QWEN, R1, LLAMA = (RESPONSE_MARKERS[n] for n in ("qwen", "r1", "llama"))


@pytest.mark.parametrize("raw", ["  a b \n", "\t\n x ", " y　\r\n", "", " \n ", "\x1cz\x1f"])
def test_strip_removes_what_python_strips(value, raw):
    assert value(tx.strip(F.col("t")), t=raw) == raw.strip()


def test_prompt_ends_the_problem_with_one_newline(value):
    prompt = value(tx.render_prompt(F.col("t")), t="  1+1?\n\n")
    assert prompt == (
        f"<|im_start|>system\n{SYSTEM_PROMPT}<|im_end|>\n"
        "<|im_start|>user\n1+1?\n<|im_end|>\n<|im_start|>assistant\n"
    )


def test_chat_strips_both_sides_and_stays_closed(value):
    chat = value(tx.render_chat(F.lit(" 1+1? \n"), F.lit("\n2 ")))
    assert chat == (
        f"<|im_start|>system\n{SYSTEM_PROMPT}<|im_end|>\n"
        "<|im_start|>user\n1+1?<|im_end|>\n<|im_start|>assistant\n2<|im_end|>\n"
    )


def test_messages_of_any_number_are_rendered_in_order(spark):
    rows = spark.createDataFrame(
        [([("user", "a"), ("assistant", "b"), ("user", "c")],)],
        "messages array<struct<role string, content string>>",
    )
    template = tx.ChatTemplate("[", "]", "/", prefix="<s>")
    out = rows.select(tx.render_messages(F.col("messages"), template, True)).first()[0]
    assert out == "<s>[user]a/[assistant]b/[user]c/[assistant]"


def test_multiple_choice(spark):
    rows = spark.createDataFrame([("q?", ["x", "y", "z"], 2)], "q string, c array<string>, a int")
    out = rows.select(tx.format_mcq(F.col("q"), F.col("c")), tx.mcq_solution(F.col("a"))).first()
    assert tuple(out) == ("q?\nA. x\nB. y\nC. z", "\\boxed{C}")


@pytest.mark.parametrize(
    "raw, cleaned",
    [
        ("<s><s>a", "<s>a</s>"),
        ("[PAD][PAD]<s>a</s>b</s>[PAD]", "ab</s>"),
        ("", "</s>"),
        ("<[PAD]s>a", "a</s>"),
    ],
)
def test_clean_trace(value, raw, cleaned):
    assert value(tx.clean_trace(F.col("t"), "[PAD]", "<s>", "</s>"), t=raw) == cleaned


def test_empty_tokens_change_nothing(value):
    assert value(tx.clean_trace(F.col("t")), t="<s>a") == "<s>a"


@pytest.mark.parametrize(
    "trace, family",
    [
        (f"x{QWEN}y", "qwen"), (f"{R1}y", "r1"), (f"{LLAMA}y", "llama"),
        (f"{QWEN}{LLAMA}", "llama"), (f"{R1}{QWEN}", "qwen"), ("hello", None),
    ],
)
def test_family_is_the_first_in_fixed_order(value, trace, family):
    assert value(tx.response_family(F.col("t")), t=trace) == family


@pytest.mark.parametrize(
    "trace, response",
    [
        (f"p{QWEN}one<|im_end|>\n{QWEN}two<|im_end|>", "one"),
        (f"p{QWEN}open", "open"),
        (f"p{R1}a{R1}b<｜end▁of▁sentence｜>", f"a{R1}b<eos>"),
        (f"{R1}r{QWEN}q", "q"),
    ],
)
def test_extract_response(value, trace, response):
    assert value(tx.extract_response(F.col("t"), eos="<eos>"), t=trace) == response


def test_unknown_markers_are_quarantined(spark):
    rows = spark.createDataFrame([(1, f"{QWEN}a"), (2, "hello"), (3, None)], "id int, trace string")
    good, bad = split_responses(rows, "trace")
    assert [(r.id, r.response) for r in good.collect()] == [(1, "a")]
    assert {r.id: r.reason for r in bad.collect()} == {2: "no response marker", 3: "no trace"}


@pytest.mark.parametrize(
    "trace, closing",
    [
        (f"{QWEN}a</think>b", ""),
        (f"{QWEN}a", "\n</think>"),
        (f"{QWEN}a</think>{QWEN}b", "\n</think>"),
        ("</think> no marker", ""),
    ],
)
def test_force_answer_looks_at_the_last_response(value, trace, closing):
    assert value(tx.force_answer(F.col("t")), t=trace) == trace + closing + ANSWER_FORCE_STRING


def test_force_by_family(value):
    assert value(tx.force_answer_by_family(F.col("t")), t="none") is None
    forced = value(tx.force_answer_by_family(F.col("t")), t=f"</think>{R1}x")
    assert forced.endswith("x\n</think>" + ANSWER_FORCE_STRING)

import random

import pytest
from pyspark.sql import functions as F

from traceforge.functions.text import ChatTemplate
from traceforge.operators.conversations import joined_in_order, render_conversations

SCHEMA = "conv int, turn int, role string, text string, part string, rows int, chat string"


def conversations(rnd):
    """One conversation with most messages, small ones, an empty and a null one, ties and null places."""
    rows = [(0, t, "user" if t % 2 == 0 else "assistant", f"m{t}é" * rnd.randint(0, 9)) for t in range(2000)]
    rows += [(c, t, "user", f"{c}/{t}") for c in range(1, 30) for t in range(rnd.randint(1, 4))]
    rows += [(40, 0, "user", None), (41, 0, None, ""), (None, 1, "user", "b"), (None, 0, "user", "a"), (42, None, "user", "first"), (42, 0, "user", "second")]
    return [(*r, "clash", 1, "clash") for r in rows]


def message(role, text):
    return f"<|im_start|>{role or ''}\n{text or ''}<|im_end|>\n"


def expected(rows):
    listed = {}
    for conv, turn, role, text, *_ in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0)):
        listed.setdefault(conv, []).append(message(role, text))
    return listed


@pytest.mark.parametrize("group_rows", [10_000, 100])
def test_one_string_per_conversation(spark, group_rows):
    rows = conversations(random.Random(1))
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    out = render_conversations(df, ["conv"], ["turn"], system="be brief", group_rows=group_rows, segment_bytes=64)
    assert out.columns == ["conv", "part", "chat", "turns"]
    got = {r.conv: (r.part, r.chat, r.turns) for r in out.collect()}
    assert got == {c: (0, message("system", "be brief") + "".join(m), len(m)) for c, m in expected(rows).items()}


@pytest.mark.parametrize("group_rows", [10_000, 100])
def test_a_conversation_beyond_a_string_comes_in_parts(spark, group_rows):
    rows = conversations(random.Random(2))
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    out = render_conversations(df, ["conv"], ["turn"], group_rows=group_rows, segment_bytes=200, part_bytes=1000).collect()
    for conv, messages in expected(rows).items():
        parts = sorted((r.part, r.chat, r.turns) for r in out if r.conv == conv)
        assert "".join(chat for _, chat, _ in parts) == "".join(messages)
        assert sum(turns for *_, turns in parts) == len(messages)
        longest = max(len(m.encode()) for m in messages)
        assert all(len(chat.encode()) <= 1000 + longest for _, chat, _ in parts)
    assert sum(r.conv == 0 for r in out) > 50


def test_equal_places_give_one_result_and_templates_open_once(spark):
    df = spark.createDataFrame([(1, 0, "u", t) for t in "abcabc"], "conv int, turn int, role string, text string")
    results = {
        render_conversations(df.repartition(n), ["conv"], ["turn"], template=ChatTemplate("<", ">", "\n", "BOS")).first().chat
        for n in (1, 3, 4)
    }
    assert len(results) == 1 and results.pop().count("BOS") == 1


def test_empty_table(spark):
    df = spark.createDataFrame([], "conv int, turn int, role string, text string")
    assert render_conversations(df, ["conv"], ["turn"]).count() == 0
    assert joined_in_order(df.withColumn("text", F.lit(None).cast("string")), ["conv"], ["turn"], "text", "all").count() == 0

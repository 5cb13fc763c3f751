import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from traceforge.functions import tokens as tk
from traceforge.operators import encoding

FEW = settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
small_ids = st.lists(st.integers(1, 3), max_size=9)


def arrays(spark, rows):
    return spark.createDataFrame([(i, list(r)) for i, r in enumerate(rows)], "i int, ids array<int>")


def results(spark, rows, column):
    out = arrays(spark, rows).select("i", column.alias("out")).orderBy("i").collect()
    return [r.out for r in out]


def test_words_keep_chat_markers_whole(value):
    out = value(tk.words(F.col("t")), t="<|im_start|>Assistant\nÉté 3,5!<|im_end|>")
    assert out == ["<|im_start|>", "assistant", "été", "3", ",", "5", "!", "<|im_end|>"]


@FEW
@given(st.text(st.sampled_from("ab1 -.\\{}<|>_\t\n\u00e9\u0301\U0001f600\u00a0="), max_size=30))
def test_tokens_lose_nothing_but_blanks(value, text):
    assert "".join(value(tk.words(F.col("t")), t=text)) == "".join(c for c in text if c not in " \t\n")


def test_signs_tell_numbers_apart(value):
    read = lambda t: value(tk.words(F.col("t")), t=t)
    assert read("x = -3.5") == ["x", "=", "-", "3", ".", "5"] != read("x = 3/5")


def test_strip_trailing_cases(spark):
    rows = [[9, 9], [4, 9, 9], [9, 4], [9], []]
    assert results(spark, rows, tk.strip_trailing(F.col("ids"), 9)) == [[9], [4], [9, 4], [9], []]


def test_truncate(spark):
    rows = [[1, 2, 3], [1], []]
    assert results(spark, rows, tk.truncate(F.col("ids"), 2)) == [[1, 2], [1], []]
    assert results(spark, rows, tk.is_truncated(F.col("ids"), 2)) == [True, False, False]


def mask_model(ids, template, pad=None):
    n = len(template)
    starts = [i for i in range(len(ids) - n + 1) if ids[i : i + n] == template]
    begin = starts[-1] + n if starts else len(ids)
    return [x if i >= begin and x != pad else -100 for i, x in enumerate(ids)]


def test_mask_examples(spark):
    rows = [[5, 1, 2, 7, 8], [9], [1, 2], [1, 2, 3, 1, 2, 4], []]
    got = results(spark, rows, tk.completion_mask(F.col("ids"), [1, 2]))
    assert got == [[-100, -100, -100, 7, 8], [-100], [-100, -100], [-100] * 5 + [4], []]


@FEW
@given(st.lists(small_ids, min_size=1, max_size=20), st.lists(st.integers(1, 3), min_size=1, max_size=3))
def test_mask_matches_a_loop(spark, rows, template):
    got = results(spark, rows, tk.completion_mask(F.col("ids"), template, pad=3))
    assert got == [mask_model(r, template, 3) for r in rows]


def test_template_inside_a_number_is_not_found(spark):
    assert results(spark, [[11, 23]], tk.last_position(F.col("ids"), [1, 2])) == [None]


def test_validation_counts_reasons(spark):
    report = encoding.validation_report(arrays(spark, [[1, 2, 3], [], [9], [1, 2]]), "ids", [1, 2])
    assert {r.reason: r.rows for r in report.collect()} == {"ok": 2, "empty": 1, "no template": 1}


@pytest.mark.parametrize("head_rows", [2, 1000])
def test_vocabulary_and_encoding(spark, head_rows):
    rows = [(1, ["b", "a", "b"]), (2, []), (3, ["c", "b", "d", "a"])]
    df = spark.createDataFrame(rows, "id int, tokens array<string>")
    vocab = encoding.vocabulary(df, "tokens")
    ids = {r.token: r.id for r in vocab.collect()}
    assert ids == {"b": 1, "a": 2, "c": 3, "d": 4}
    got = {
        r.id: r.input_ids
        for r in encoding.encode(df, ["id"], "tokens", vocab, head_rows=head_rows).collect()
    }
    assert got == {1: [1, 2, 1], 2: [], 3: [3, 1, 4, 2]}


@pytest.mark.parametrize("head_rows", [1, 1000])
def test_foreign_vocabulary_gives_unknown_ids(spark, head_rows):
    known = spark.createDataFrame([(1, ["a", "a", "b"])], "id int, tokens array<string>")
    vocab = encoding.vocabulary(known, "tokens")
    other = spark.createDataFrame([(7, ["x", "b", "x", "a", "x"])], "id int, tokens array<string>")
    out = encoding.encode(other, ["id"], "tokens", vocab, head_rows=head_rows, same_corpus=False)
    assert out.first().input_ids == [0, 2, 0, 1, 0]


def test_callers_tokenizer(spark):
    ids = tk.subword_ids(lambda texts: [[ord(c) for c in t] for t in texts])
    df = spark.createDataFrame([("ab",), ("",)], "t string")
    assert [r.out for r in df.select(ids(F.col("t")).alias("out")).collect()] == [[97, 98], []]


def test_template_tokens_spell_the_marker(value):
    from traceforge.constants import RESPONSE_MARKERS
    from traceforge.plans.training import TEMPLATE_TOKENS

    assert value(tk.words(F.lit(RESPONSE_MARKERS["qwen"]))) == list(TEMPLATE_TOKENS)


def test_training_rows_end_to_end(spark):
    from traceforge.plans.training import chat_training_rows, trace_training_rows

    pairs = spark.createDataFrame([(1, "What is it", "It is two"), (2, "Why", "So")],
                                  "id int, problem string, response string")
    rows = {r.id: r for r in chat_training_rows(pairs, ["id"]).collect()}
    for row in rows.values():
        assert len(row.labels) == len(row.input_ids)
        assert row.problem_found is None and not row.was_truncated
    kept = [x for x in rows[1].labels if x != -100]
    assert rows[1].input_ids[-len(kept):] == kept and len(kept) == 3

    traces = spark.createDataFrame([(1, "p", "<|im_start|>assistant\nok<|im_end|>"), (2, "p", "no")],
                                   "id int, problem string, trace string")
    good, bad = trace_training_rows(traces, ["id"])
    assert [r.id for r in good.collect()] == [1] and [r.id for r in bad.collect()] == [2]

import math
import random

import pytest
from pyspark.sql import functions as F

from traceforge.constants import ANSWER_FORCE_STRING
from traceforge.functions import answers, formulas
from traceforge.operators import grading
from traceforge.plans.traces import build_traces, graded_traces


@pytest.mark.parametrize(
    "text, answer",
    [
        (r"\boxed{\frac{1}{2}} then \boxed{3}", "3"),
        (r"\boxed{\frac{1}{2}}", r"\frac{1}{2}"),
        (r"\boxed{a_{b_{c}}}", "a_{b_{c}}"),
        (r"\boxed{x", None),
        (r"\boxed{x and 12", "12"),
        (r"\boxed{1} \boxed{2", "1"),
        ("from 1,200.5 to -3/4", "-3/4"),
        ("#### 1,234", "1,234"),
        ("nothing", None),
    ],
)
def test_extract(value, text, answer):
    assert value(answers.extract_answer(F.col("t")), t=text) == answer


def test_long_boxes_do_not_overflow_the_matcher(value):
    inside = "{x}" * 50_000
    assert value(F.length(answers.extract_answer(F.col("t"))), t="\\boxed{" + inside + "}") == 150_000
    assert value(answers.extract_answer(F.col("t")), t="\\boxed{" + inside) is None


EQUIVALENT = [
    (r"\boxed{1/2}", r"\boxed{\dfrac{1}{2}}", True),
    (r"\boxed{0.5}", r"\boxed{\tfrac{1}{2}}", True),
    (r"\boxed{1,234,567}", r"\boxed{1234567.0}", True),
    (r"\boxed{\text{Blue} }", r"\boxed{blue}", True),
    (r"\boxed{$5$}", r"\boxed{5.}", True),
    (r"\boxed{\left(1,2\right)}", r"\boxed{(1,2)}", True),
    (r"\boxed{1}", r"\boxed{1.0000001}", True),
    (r"\boxed{1}", r"\boxed{1.001}", False),
    (r"\boxed{1/0}", r"\boxed{2/0}", False),
    (r"\boxed{x+1}", r"\boxed{1+x}", True),
    # mixed numbers, thousands, letters, names, empty boxes
    (r"\boxed{1\frac{1}{2}}", r"\boxed{1.5}", True),
    (r"\boxed{1\frac{1}{2}}", r"\boxed{11/2}", False),
    (r"\boxed{-2\frac12}", r"\boxed{-2.5}", True),
    (r"\boxed{1{,}000}", r"\boxed{1000}", True),
    (r"\boxed{\text{(A)}}", r"\boxed{A}", True),
    (r"\boxed{(A)}", r"\boxed{B}", False),
    (r"\boxed{x=5}", r"\boxed{5}", True),
    (r"\boxed{x=5}", r"\boxed{x = 5.0}", True),
    (r"\boxed{x=5}", r"\boxed{y=5}", False),
    (r"\boxed{}", r"\boxed{}", False),
    (r"\boxed{ }", r"\boxed{\,}", False),
    # units: none fits any, two must be one
    (r"\boxed{5 \text{ km}}", r"\boxed{5 \text{ m}}", False),
    (r"\boxed{5 \text{ km}}", r"\boxed{5\,\mathrm{km}}", True),
    (r"\boxed{5 \text{ dollars}}", r"\boxed{5 dollar}", True),
    (r"\boxed{5 km}", r"\boxed{5}", True),
    (r"\boxed{5 km}", r"\boxed{5 m}", False),
    (r"\boxed{5}", r"\boxed{6 \text{ km}}", False),
    (r"\boxed{90^\circ}", r"\boxed{90 \text{ degrees}}", True),
    (r"\boxed{50\%}", r"\boxed{50^\circ}", False),
    (r"\boxed{50\%}", r"\boxed{50 percent}", True),
    (r"\boxed{3 \text{ cm}^2}", r"\boxed{3 \text{ cm}^3}", False),
    # sets, tuples, intervals
    (r"\boxed{\{1, 2\}}", r"\boxed{\{2,1\}}", True),
    (r"\boxed{\{1, 2\}}", r"\boxed{2, 1}", True),
    (r"\boxed{\{1, 2\}}", r"\boxed{(1,2)}", False),
    (r"\boxed{(1,2)}", r"\boxed{(2,1)}", False),
    (r"\boxed{(\frac{1}{2}, 3)}", r"\boxed{(0.5,3)}", True),
    (r"\boxed{[0,1)}", r"\boxed{\left[0, 1\right)}", True),
    (r"\boxed{[0,1)}", r"\boxed{[0,1]}", False),
    (r"\boxed{(-\infty,1)\cup(2,3)}", r"\boxed{(2,3) \cup (-\infty, 1)}", True),
    (r"\boxed{1,2,3}", r"\boxed{3,2,1}", True),
    (r"\boxed{\{100, 200\}}", r"\boxed{\{200,100\}}", True),
    # formulas
    (r"\boxed{(x+1)^2}", r"\boxed{x^{2}+2x+1}", True),
    (r"\boxed{(x+1)^2}", r"\boxed{x^2+1}", False),
    (r"\boxed{\frac{1}{\sqrt{2}}}", r"\boxed{\dfrac{\sqrt{2}}{2}}", True),
    (r"\boxed{2\sqrt{3}}", r"\boxed{\sqrt{12}}", True),
    (r"\boxed{\frac{\pi}{2}}", r"\boxed{\pi/2}", True),
    (r"\boxed{2^{10}}", r"\boxed{1024}", True),
    (r"\boxed{east}", r"\boxed{seat}", False),
    ("none", "none", False),
    (r"\boxed{nan}", r"\boxed{1}", False),
]


def test_equivalence(spark):
    df = spark.createDataFrame(EQUIVALENT, "solution string, trace string, same boolean")
    wrong = grading.grade(df, "trace", "solution").where("is_correct <> same").collect()
    assert not wrong, wrong


def test_any_reading_of_a_forced_trace_counts(spark):
    forced = ANSWER_FORCE_STRING
    rows = [
        ("whole", f"wrong \\boxed{{1}}{forced}7}}\\]", True),
        ("head", f"\\boxed{{7}}{forced}1}}\\]", True),
        ("tail", f"x \\boxed{{1}}{forced}7", True),
        ("last", f"a{forced}7}}{forced}1}}", True),
        ("none", f"\\boxed{{1}}{forced}2}}", False),
        ("null", None, False),
    ]
    df = spark.createDataFrame([(n, t, "\\boxed{7}", e) for n, t, e in rows],
                               "name string, trace string, solution string, expected boolean")
    for r in grading.grade(df, "trace", "solution").collect():
        assert r.is_correct is r.expected, r.name


@pytest.mark.parametrize("small", [True, False])
def test_grade_against_solutions_in_another_table(spark, monkeypatch, small):
    from traceforge.operators import lookup

    if not small:
        monkeypatch.setattr(lookup.skewed_lookup, "__defaults__", (2,))
    traces = spark.createDataFrame(
        [(1, "\\boxed{1}")] * 20 + [(2, "\\boxed{3}"), (9, "\\boxed{1}"), (3, "\\boxed{3}")],
        "id int, trace string",
    )
    solutions = spark.createDataFrame([(i, f"\\boxed{{{i}}}") for i in range(1, 6)], "id int, solution string")
    out = grading.grade_against(traces, solutions, ["id"], "trace")
    counts = {(r.id, r.is_correct): r["count"] for r in out.groupBy("id", "is_correct").count().collect()}
    assert counts == {(1, True): 20, (2, False): 1, (9, False): 1, (3, True): 1}


def test_accuracy_and_comparison(spark):
    df = spark.createDataFrame(
        [("clean", True, True), ("clean", False, True), ("guard", False, False), ("guard", False, True)],
        "run string, is_raw_correct boolean, is_af_correct boolean",
    )
    runs = grading.accuracy(df, ["run"])
    out = {r.run: r for r in grading.compare_runs(runs, "clean").collect()}
    assert out["clean"].raw_accuracy_delta == 0 and out["guard"].raw_accuracy_delta == -0.5
    assert out["guard"].af_accuracy_delta == -0.5
    assert grading.accuracy(df, forced=None).first().af_accuracy is None


def test_forcing_can_turn_a_trace_right(spark):
    df = spark.createDataFrame(
        [(1, "<|im_start|>assistant\nno idea \\boxed{3}<|im_end|>", "\\boxed{4}")],
        "problem_id int, trace string, solution string",
    )
    more = spark.createDataFrame([(1, "4}\\]")], "problem_id int, continuation string")
    row = graded_traces(df, more).first()
    assert (row.is_raw_correct, row.is_af_correct) == (False, True)
    assert row.trace_af.endswith("4}\\]<|im_end|>") and row.trace_af.count("<|im_end|>") == 1


def test_answers_that_look_alike_are_told_apart(spark):
    box = "\\boxed{{{}}}".format
    half, wrong = r"\frac{\sqrt{\frac{1}{2}}}{3}", r"\frac{\sqrt{\frac{5}{7}}}{3}"
    rows = [
        (box(half), box(wrong), False),
        (box(half), box(half.replace("frac", "dfrac", 1)), True),
        (box("3,4"), box("34"), False),
        (box("(1,2)"), box("(12)"), False),
        (box("(1,234)"), box("(1234)"), False),
        (box("16777220"), box("16777216"), False),
        (box("1e999"), box("5"), False),
        ("18", "She earns 18, as shown", True),
        (box("1,234,567"), box("1234567"), True),
        (box("1,234.5"), box("1234.5"), True),
        (box("007"), box("7"), True),
        (box("0.5"), box("1/2"), True),
        (box(r"\{1\}"), box(r"\{1\}"), True),
        (box("x"), r"\boxed{x", False),
    ]
    frame = spark.createDataFrame(rows, "solution string, trace string, want boolean")
    for row in grading.grade(frame, "trace", "solution").collect():
        assert row["is_correct"] == row["want"], row


@pytest.mark.parametrize(
    "gold, other, same",
    [
        ("#### 18", r"\boxed{18 \text{ dollars}}", True),
        (r"\boxed{50}", r"\boxed{50\%}", True),
        (r"\boxed{90}", r"\boxed{90^\circ}", True),
        (r"\boxed{1/2}", r"\boxed{\frac12}", True),
        (r"\boxed{18}", r"\boxed{18x}", False),
        (r"\boxed{18}", r"\boxed{181 \text{ dollars}}", False),
        (r"\boxed{\text{18 dollars}}", r"\boxed{\text{18 pounds}}", False),
    ],
)
def test_units_beside_a_number_do_not_count(spark, gold, other, same):
    df = spark.createDataFrame([(gold, other)], "solution string, trace string")
    assert grading.grade(df, "trace", "solution").first().is_correct is same


def test_the_baseline_must_stand_once_in_each_group(spark):
    def compared(*rows):
        runs = spark.createDataFrame(rows, "split string, run string, raw_accuracy double")
        return grading.compare_runs(runs, "clean", metrics=["raw_accuracy"], by=["split"]).collect()

    out = compared(("a", "clean", 0.5), ("a", "x", 0.75), ("b", "clean", 1.0), ("b", "x", 0.5))
    assert {(r.split, r.run): r.raw_accuracy_delta for r in out}[("b", "x")] == -0.5
    for rows in ([("a", "x", 1.0)], [("a", "clean", 1.0), ("a", "clean", 0.5)]):
        with pytest.raises(Exception, match="not one baseline"):
            compared(*rows)


PROBLEMS = [(i, "please " * (i % 3) + f"q {i}", f"\\boxed{{{i}}}") for i in range(6)]
MARKER = "<|im_start|>assistant\n"


def _stage(spark, **options):
    problems = spark.createDataFrame(PROBLEMS, "problem_id int, problem string, solution string")
    rows = [(i, str(c), (MARKER if c else "") + f"work {c} \\boxed{{{i + c % 2}}}") for i in range(6) for c in range(3)]
    candidates = spark.createDataFrame([*rows, (99, "0", "lost")], "problem_id int, candidate string, trace string")
    return build_traces(problems, candidates, shards=2, **options)


def test_every_trace_is_kept_without_a_threshold(spark):
    going_on = spark.createDataFrame(
        [(i, str(c), f"{i}}}") for i in range(6) for c in range(3)], "problem_id int, candidate string, continuation string"
    )
    out, report = _stage(spark, threshold=None, continuations=going_on, prompt_in_score=True)
    rows = out.collect()
    assert report is None and len(rows) == 18 and all(r.is_af_correct for r in rows)
    assert {r.candidate for r in rows if not r.is_raw_correct} == {"1"}
    # the score of a trace does not count its prompt, whatever its length
    scores = {(r.problem_id, r.candidate): r.trace_logppl for r in rows}
    assert math.isclose(scores[1, "0"], scores[5, "0"], rel_tol=0.05)


def test_a_threshold_keeps_the_quota_by_cycle(spark):
    out, report = _stage(spark, threshold=99.0, target=4, batch=2)
    total = {r.shard: r for r in report.collect()}[None]
    assert out.count() == 8 == total.accepted and not total.exhausted
    assert not any(r.is_af_correct is None for r in out.collect())


def test_formula_constants_follow_their_rule():
    def is_prime(n):
        return all(n % i for i in range(2, int(n**0.5) + 1))

    def fits(n):
        return n % 8 == 7 and all(pow(q, (n - 1) // 2, n) == 1 for q in (2, 3, 5, 7, 11, 13, 17, 19, 23)) and is_prime(n)

    first, second = formulas.PRIMES
    assert [n for n in range((1 << 30) + 7, second + 1, 8) if fits(n)] == [first, second]


@pytest.mark.parametrize(
    "one, other, same",
    [
        ("(x+1)(x-1)", "x^2-1", True), ("\\frac{x^2-1}{x-1}", "x+1", True), ("\\sqrt{-4}", "2\\sqrt{-1}", True),
        ("\\sqrt{-1}", "1", False), ("\\sqrt{-1}", "-1", False), ("-x^2", "(-x)^2", False), ("x^-2", "1/(x^2)", True),
        ("\\sin(2x)", "\\sin(x+x)", True), ("\\sin2x", "\\cos2x", False), ("(1,(2,3))", "(1,2,3)", False),
        ("(1,2),(3,4)", "(3,4),(1,2)", True), ("a-b-c", "a-(b+c)", True), ("a/b/c", "a/(bc)", True), ("2^{n}", "2^n", True),
        ("x_1", "x_{1}", True), ("x_1", "x_2", False), ("«1,1,2»", "«2,1»", True), ("2xy", "2yx", True),
    ],
)
def test_formula_keys(one, other, same):
    keys = formulas.key_of(one), formulas.key_of(other)
    assert None not in keys and (keys[0] == keys[1]) is same


def test_what_is_no_formula_has_no_key():
    for text in ["x+", "(x", "x)", "", "1/0", "+", "()", "x!", "a**b", "\\sqrt", "\\frac{1}", "x^", "blue", "1..2",
                 "(" * 300 + "x", "x" * 500 + "+1", "2^9999999", "(" * 45 + "x" + ")" * 45, None, "é+1", "0^{-1}"]:
        assert formulas.key_of(text) is None, text


def test_random_identities():
    rnd = random.Random(4)
    for _ in range(200):
        a, b, c = (rnd.randint(1, 50) for _ in range(3))
        left = f"({a}x+{b})({c}x-{b})"
        right = f"{a * c}x^2+{b * c - a * b}x-{b * b}".replace("+-", "-")
        assert formulas.key_of(left) == formulas.key_of(right)
        assert formulas.key_of(left) != formulas.key_of(right + "+1")


def test_plain_integers_are_what_is_extracted_and_others_are_left(spark):
    texts = [
        "so \\boxed{45}<|im_end|>", "\\boxed{1} \\boxed{-7}", "45}\\]<|im_end|>", "\\boxed{0}", "-3} done",
        "\\boxed{007}", "\\boxed{-0}", "\\boxed{4.0}", "\\boxed{+4}", "45} and 6", "\\boxed{4 5}", "x 45}", "\\boxed{4", "", None,
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    rows = df.select(
        "id", answers.plain_integer(F.col("text")).alias("plain"), answers.extract_answer(F.col("text")).alias("any")
    ).orderBy("id").collect()
    assert [r.plain for r in rows] == ["45", "-7", "45", "0", "-3"] + [None] * 10
    assert all(r.plain == r.any for r in rows if r.plain is not None)


def test_rows_of_plain_integers_need_no_parsing(spark):
    gold, forced = "\\boxed{45}", "work \\boxed{44}" + ANSWER_FORCE_STRING
    traces = [("\\boxed{45}", True), ("\\boxed{46}", False), (forced + "45}\\]", True), (forced + "46}\\]", False),
              (forced + "45.0}\\]", True), ("\\boxed{45.0}", True), (None, False), ("no", False)]
    df = spark.createDataFrame([(i, gold, t) for i, (t, _) in enumerate(traces)], "id int, solution string, trace string")
    graded = grading.grade(df, "trace", "solution")
    assert [r.is_correct for r in graded.orderBy("id").collect()] == [right for _, right in traces]
    assert "_quick" in graded._jdf.queryExecution().analyzed().toString()

import math
from collections import Counter

import pytest

from traceforge.operators import candidates, language_model, shifted

ROWS = [(1, "a", "x x y".split(), 1.0), (1, "b", "y z".split(), 3.0), (2, "a", "x q q q".split(), None), (2, "b", [], 2.0), (3, "a", None, 1.0)]
SCHEMA = "id int, candidate string, tokens array<string>, weight double"


def plain(rows, clean, eps, alpha, weighted):
    counts = Counter(t for *_, ts, _ in rows for t in ts or [])
    types, total = len(counts) + 1, sum(counts.values())
    log = lambda n: math.log((n + alpha) / (total + alpha * types))
    used = [(ts, (w or 0.0) if weighted else 1.0) for *_, ts, w in clean if ts]
    whole = sum(w for _, w in used) or 1.0
    gradient = {t: sum(w * ts.count(t) / len(ts) for ts, w in used) / whole - math.exp(log(n)) for t, n in counts.items()}
    theta = {t: log(n) for t, n in counts.items()}
    models = [theta]
    for sign in (1, -1):
        moved = {t: theta[t] + sign * eps * gradient[t] for t in counts}
        norm = math.log(sum(map(math.exp, moved.values())) + math.exp(log(0) - sign * eps * math.exp(log(0))))
        models.append({t: v - norm for t, v in moved.items()})
    return {(i, c): tuple(sum(m[t] for t in ts) / len(ts) for m in models) if ts else (None,) * 3 for i, c, ts, _ in rows}


@pytest.mark.parametrize("weighted", [False, True])
def test_scores_equal_the_plain_computation(spark, weighted):
    df = spark.createDataFrame(ROWS, SCHEMA)
    model = language_model.fit_ngram(df, "tokens", alpha=0.5)
    tables = shifted.shifted_scores(
        df, df.where("candidate = 'b' or id = 1"), ["id", "candidate"], "tokens", 0.25, model, "weight" if weighted else None
    )
    clean = [r for r in ROWS if r[1] == "b" or r[0] == 1]
    want = plain(ROWS, clean, 0.25, 0.5, weighted)
    for side, table in enumerate(tables):
        got = {(r.id, r.candidate): r.score for r in table.collect()}
        assert got.keys() == want.keys()
        for key, value in got.items():
            assert value == pytest.approx(want[key][side], rel=1e-9) if want[key][side] is not None else value is None
    adjusted = candidates.rescore(*tables, ["id", "candidate"], lam=0.1, eps=0.25)
    for r in adjusted.where("adjusted is not null").collect():
        base, plus, minus = want[r.id, r.candidate]
        assert r.adjusted == pytest.approx(base + 0.1 / 0.5 * (plus - minus))


def test_probabilities_sum_to_one_and_the_gradient_points_to_the_clean_rows(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    model = language_model.fit_ngram(df, "tokens", alpha=0.5)
    models = shifted.shift(model, shifted.mean_shares(df.where("id = 2"), "tokens"), 0.5)
    words = {r.w2: r for r in models.words.collect()}
    for side, unseen in zip(shifted.SIDES, models.unseen):
        assert sum(math.exp(r[side]) for r in words.values()) + math.exp(unseen) == pytest.approx(1)
    assert words["q"].plus > words["q"].base > words["q"].minus and words["z"].plus < words["z"].minus


def test_words_that_the_model_lacks_and_empty_tables(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    model = language_model.fit_ngram(df, "tokens", alpha=0.5)
    models = shifted.shift(model, shifted.mean_shares(df, "tokens"), 0.5)
    new = spark.createDataFrame([(9, "n", ["new"], 1.0)], SCHEMA)
    row = shifted.score_sides(new, models, ["id"], "tokens", same_corpus=False).first()
    assert (row.base, row.plus, row.minus) == pytest.approx(models.unseen)
    empty = df.limit(0)
    none = language_model.fit_ngram(empty, "tokens")
    assert all(t.count() == 0 for t in shifted.shifted_scores(empty, empty, ["id"], "tokens", 0.5, none))
    with pytest.raises(ValueError):
        shifted.shift(language_model.fit_ngram(df, "tokens", order=2), shifted.mean_shares(df, "tokens"), 0.5)


def test_three_scores_of_a_row_are_read_without_a_join(spark, tmp_path):
    from traceforge.plans import registered

    line = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_returnflag string, l_linestatus string"
    lines = spark.createDataFrame([(i // 3, i % 3, i, i % 5, "NR"[i % 2], "O") for i in range(30)], line)
    lines.write.parquet(str(tmp_path / "lineitem.parquet"))
    out = registered.shifted_scores(spark, str(tmp_path))
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert "Join" not in plan and plan.count("FileScan") == 1
    assert out.columns == ["problem_id", "candidate", "score", "plus", "minus"] and out.count() == 30

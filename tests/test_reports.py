import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from traceforge.operators import ablation, stats
from traceforge.sources import tables
from traceforge.sources.problems import ProblemSource, exchanges, load_problems


@pytest.mark.parametrize("group_rows", [4, 10**6])
@pytest.mark.parametrize("by", [[], ["g"]])
def test_describe_equals_pandas(spark, group_rows, by):
    rng = random.Random(3)
    rows = [("a", rng.choice([1.0, 2.5, rng.random() * 9])) for _ in range(57)]
    rows += [("b", 4.0), ("c", None), ("c", math.nan), ("d", 1.0), ("d", math.nan), ("d", 8.0)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(3)
    got = stats.describe(df, "x", by, group_rows=group_rows).collect()
    frame = pd.DataFrame(rows, columns=["g", "x"])
    for row in got:
        values = frame if not by else frame[frame.g == row.g]
        expected = values.x.describe()
        assert row["count"] == expected["count"]
        for ours, theirs in zip(stats.STATISTICS[1:], expected.index[1:]):
            if math.isnan(expected[theirs]):
                assert row[ours] is None
            else:
                assert row[ours] == pytest.approx(expected[theirs])
    assert len(got) == (4 if by else 1)


def test_describe_one_row_and_approx(spark):
    one = stats.describe(spark.createDataFrame([(1,)], "x int"), "x").first()
    assert (one["count"], one["std"], one["q50"]) == (1, None, 1.0)
    rough = stats.describe(spark.range(1001).toDF("x"), "x", approx=True).first()
    assert rough["count"] == 1001 and rough["q50"] == pytest.approx(500, abs=2)


def test_flatten(spark):
    df = spark.range(1).select(
        F.lit(1).alias("a"),
        F.struct(F.struct(F.lit(2).alias("d"), F.array(F.lit(3)).alias("e")).alias("c"), F.struct().alias("z")).alias("b"),
    )
    flat = stats.flatten_struct(df)
    assert flat.columns == ["a", "b.c.d", "b.c.e"] and tuple(flat.first()) == (1, 2, [3])


def test_run_record_and_registry(spark, tmp_path):
    traces = spark.createDataFrame(
        [(True, True, 3, 1.5), (False, True, 5, 2.5)],
        "is_raw_correct boolean, is_af_correct boolean, length int, logppl double",
    )
    path = str(tmp_path / "registry")
    for tau in (0.0, 1.0):
        record = stats.run_record(traces, {"tau": tau}, "length", "logppl", forced="is_af_correct" if tau else None)
        tables.append_run(record, path)
    schema = "tau double, `stats.raw_accuracy` double, `stats.af_accuracy` double, `stats.ppl_stats.q50` double"
    runs = {r.tau: r for r in tables.read_runs(spark, path, schema).collect()}
    assert runs[1.0]["stats.raw_accuracy"] == 0.5 and runs[1.0]["stats.ppl_stats.q50"] == 2.0
    assert runs[0.0]["stats.af_accuracy"] is None and runs[1.0]["stats.af_accuracy"] == 1.0
    kept = stats.with_stored_settings({"tau": None, "seed": 4}, tables.read_runs(spark, path, schema))
    assert sorted((r.tau, r.seed) for r in kept.collect()) == [(0.0, 4), (1.0, 4)]


def test_traces_are_replaced_not_appended(spark, tmp_path):
    path = str(tmp_path / "traces")
    df = spark.createDataFrame([(1, "a", "x")], "id int, run string, trace string")
    for _ in range(2):
        tables.write_traces(df, path, ["run"])
    assert tables.read_traces(spark, path, ["id", "trace"]).collect() == [(1, "x")]


def test_sources(spark):
    def pool(session):
        return session.range(90).select(F.col("id").alias("problem_id"), F.lit("p").alias("problem"), F.lit("s").alias("solution"))

    sources = {
        "gsm8k": ProblemSource(pool, lambda s: pool(s).limit(3)),
        "math": ProblemSource(pool, pool, shuffled=True),
    }
    train = load_problems(spark, "gsm8k_train", sources)
    assert train.count() == 62 and train.agg(F.max("problem_id")).first()[0] == 61
    shuffled = load_problems(spark, "math_train", sources), load_problems(spark, "math_holdout", sources)
    assert shuffled[0].count() == 62 and shuffled[0].unionByName(shuffled[1]).distinct().count() == 90
    assert load_problems(spark, "gsm8k_test", sources).count() == 3
    for wrong in ("other_train", "gsm8k_dev", "gsm8k"):
        with pytest.raises(ValueError):
            load_problems(spark, wrong, sources)


def test_subjects_are_all_read(spark):
    from traceforge.sources.problems import subject_subsets

    out = subject_subsets(lambda name: spark.createDataFrame([(len(name),)], "n int"))
    assert out.count() == 7 and all(r.n == len(r.subset) for r in out.collect())


def test_only_direct_replies_pair(spark):
    rows = [(1, 0, "user", "q"), (1, 1, "user", "r"), (1, 2, "assistant", "a"), (2, 0, "assistant", "b"), (2, 1, "user", "c")]
    out = exchanges(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string"))
    assert [(r.problem, r.response) for r in out.collect()] == [("r", "a")]


@pytest.mark.parametrize("order", [1, 2])
def test_student_loss_equals_a_loop(spark, order):
    rng = random.Random(5)
    rows = [(i, [rng.choice("abcdef"[: 3 + i % 4]) for _ in range(i % 9)]) for i in range(60)]
    df = spark.createDataFrame(rows, "i int, tokens array<string>").repartition(4)
    chosen = {"all": lambda i: True, "few": lambda i: i % 4 == 1, "none": lambda i: False}
    conditions = {"all": F.lit(True), "few": F.col("i") % 4 == 1, "none": F.lit(None).cast("boolean")}
    out = {
        r.train_set: r
        for r in ablation.student_loss(df, conditions, F.col("i") % 5 == 0, "all", order=order, head_rows=4).collect()
    }
    grams = lambda t: [tuple(t[j : j + order]) for j in range(len(t) - order + 1)]
    held = [g for i, t in rows if i % 5 == 0 for g in grams(t)]
    types = len({g[-1] for i, t in rows if i % 5 for g in grams(t)}) + 1
    for name, takes in chosen.items():
        train = [g for i, t in rows if i % 5 and takes(i) for g in grams(t)]
        given = lambda g: len(train) if order == 1 else sum(h[0] == g[0] for h in train)
        loss = sum(-math.log((train.count(g) + 1) / (given(g) + types)) for g in held) / len(held)
        assert math.isclose(out[name].loss, loss, abs_tol=1e-9)
        assert math.isclose(out[name].perplexity, math.exp(loss), rel_tol=1e-9)
        assert out[name].rows == sum(1 for i, _ in rows if i % 5 and takes(i))
    assert out["all"].loss_delta == 0 and out["none"].loss_delta > 0


def test_student_loss_without_a_holdout_is_null(spark):
    df = spark.createDataFrame([(["a"],)], "tokens array<string>")
    row = ablation.student_loss(df, {"all": F.lit(True)}, F.lit(False), "all").first()
    assert row.loss is None and row.rows == 1
    with pytest.raises(ValueError):
        ablation.student_loss(df, {"all": F.lit(True)}, F.lit(False), "other")


def test_traces_read_by_schema_keep_partition_types(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.write_traces(spark.createDataFrame([(1, "01"), (2, "a")], "i int, run string"), path, ["run"])
    out = tables.read_traces(spark, path, schema="i int, run string")
    assert sorted(map(tuple, out.collect())) == [(1, "01"), (2, "a")]

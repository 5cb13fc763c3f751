import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from traceforge.operators import coverage, language_model as lm, lookup, vectors

DOCS = {1: "a b a c".split(), 2: "a a".split(), 3: [], 4: ["d"], 5: "b a b".split()}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(DOCS.items()), "id int, tokens array<string>").cache()


@pytest.mark.parametrize("head_rows", [1, 1000])
@pytest.mark.parametrize("same", [True, False])
def test_unigram_perplexity(spark, docs, head_rows, same):
    model = lm.fit_ngram(docs, "tokens", alpha=0.5)
    counts = Counter(t for d in DOCS.values() for t in d)
    total, types = sum(counts.values()), len(counts) + 1
    assert (model.total, model.types) == (total, types)

    def logp(token):
        return math.log((counts[token] + 0.5) / (total + 0.5 * types))

    unseen = math.log(0.5 / (total + 0.5 * types))
    assert sum(math.exp(logp(t)) for t in counts) + math.exp(unseen) == pytest.approx(1)
    out = lm.score_ngram(docs, model, ["id"], "tokens", F.lit(1), head_rows=head_rows, same_corpus=same)
    got = {r.id: r.logppl for r in out.collect()}
    for key, tokens in DOCS.items():
        tail = tokens[1:]
        if tail:
            assert got[key] == pytest.approx(-sum(map(logp, tail)) / len(tail))
        else:
            assert math.isnan(got[key])


@pytest.mark.parametrize("head_rows", [1, 1000])
@pytest.mark.parametrize("same", [True, False])
def test_bigram_scores_seen_and_unseen(spark, docs, head_rows, same):
    train = docs.where("id in (1, 2)")
    model = lm.fit_ngram(train, "tokens", order=2, alpha=1.0)
    pairs = Counter(p for k in (1, 2) for p in zip(DOCS[k], DOCS[k][1:]))
    firsts = Counter()
    for (a, _), n in pairs.items():
        firsts[a] += n
    types = len({b for _, b in pairs}) + 1
    got = {
        r.id: r.logppl
        for r in lm.score_ngram(docs, model, ["id"], "tokens", head_rows=head_rows, same_corpus=same).collect()
    }
    for key, tokens in DOCS.items():
        logs = [math.log((pairs[p] + 1) / (firsts[p[0]] + types)) for p in zip(tokens, tokens[1:])]
        if logs:
            assert got[key] == pytest.approx(-sum(logs) / len(logs))
        else:
            assert math.isnan(got[key])


def test_padding_counts_only_on_request(spark):
    rows = [(1, 0, -9.0, False), (1, 1, -1.0, False), (1, 2, -3.0, True), (2, 0, -1.0, False)]
    df = spark.createDataFrame(rows, "id int, position int, logp double, pad boolean")

    def run(**options):
        out = lm.log_perplexity(df, ["id"], F.lit(1), F.col("pad"), **options)
        return {r.id: r.logppl for r in out.collect()}

    assert run()[1] == 1.0 and run(count_padding=True)[1] == 2.0 and math.isnan(run()[2])


@pytest.mark.parametrize("head_rows", [1, 1000])
@pytest.mark.parametrize("order", [1, 2])
def test_cross_entropy_difference(spark, docs, order, head_rows):
    plus, minus = {1, 2}, {4, 5}

    def grams(tokens):
        return [tuple(tokens[i : i + order]) for i in range(len(tokens) - order + 1)]

    def counts(keys):
        items = Counter(g for k in keys for g in grams(DOCS[k]))
        given = Counter()
        for g, n in items.items():
            given[g[:-1]] += n
        return items, given

    (p, pg), (m, mg) = counts(plus), counts(minus)
    types = len({g[-1] for g in [*p, *m]}) + 1
    got = lm.cross_entropy_difference(
        docs, ["id"], "tokens", F.col("id").isin(1, 2), F.col("id").isin(4, 5), order, head_rows=head_rows
    )
    apart = lm.cross_entropy_difference_of(
        docs, docs.where("id in (1, 2)"), docs.where("id in (4, 5)"), ["id"], "tokens",
        order=order, head_rows=head_rows,
    )
    for frame in (got, apart):
        scores = {r.id: r.difference for r in frame.collect()}
        assert scores.keys() == DOCS.keys()
        for key, tokens in DOCS.items():
            logs = [
                math.log((p[g] + 1) / (pg[g[:-1]] + types)) - math.log((m[g] + 1) / (mg[g[:-1]] + types))
                for g in grams(tokens)
            ]
            if logs:
                assert scores[key] == pytest.approx(sum(logs) / len(logs))
            else:
                assert scores[key] is None


@pytest.mark.parametrize("head_rows", [1, 3, 1000])
def test_lookups_with_a_hot_key(spark, head_rows):
    facts = spark.createDataFrame([("hot", i) for i in range(30)] + [("x", 1), ("gone", 1), (None, 1)], "k string, i int")
    table = spark.createDataFrame([("hot", 30, 1), ("x", 1, 2), ("y", 0, 3), ("z", 0, 4), ("w", 9, 5)], "k string, n int, v int")
    expected = facts.join(table, "k", "left").select("k", "i", "v")
    for out in (
        lookup.lookup(facts, table, ["k"], "n", head_rows),
        lookup.lookup(facts, table, ["k"], "n", head_bytes=25),
        lookup.skewed_lookup(facts, table, ["k"], head_rows),
    ):
        got = out.select("k", "i", "v")
        assert got.count() == expected.count() == 33
        assert got.exceptAll(expected).count() == 0


def test_weighted_mean_vector_and_norms(spark):
    rows = [("a", 1.0, [1.0, 2.0]), ("a", 3.0, [5.0, 6.0]), ("b", 2.0, [3.0, 4.0]), ("b", 1.0, None)]
    df = spark.createDataFrame(rows, "g string, w double, v array<float>")
    got = {r.g: r["mean"] for r in vectors.vector_mean(df, "v", "w", ["g"]).collect()}
    assert got["a"] == pytest.approx([4.0, 5.0]) and got["b"] == pytest.approx([3.0, 4.0])
    norms = vectors.vector_norms(df.where("v is not null"), "v", ["g"]).where("g = 'b'").first()
    assert (norms.norm, norms.elements) == (5.0, 2) and norms.rms == pytest.approx(math.sqrt(12.5))
    whole = vectors.vector_norms(df.where("v is not null"), "v", []).first()
    assert whole.elements == 6 and whole.norm == pytest.approx(math.sqrt(1 + 4 + 25 + 36 + 9 + 16))
    long = vectors.long_mean(
        vectors.long_vector(df, "v", ["g", "w"]), ["g", "dim"], weight="w"
    ).where("g = 'a' and dim = 1").first()
    assert long["mean"] == pytest.approx(5.0)


def test_key_coverage(spark):
    a = spark.createDataFrame([(1,), (1,), (2,)], "k int")
    b = spark.createDataFrame([(2,), (3,), (3,)], "k int")
    assert {(r.k, r.missing_from) for r in coverage.key_coverage(a, b, ["k"]).collect()} == {(1, "right"), (3, "left")}
    with pytest.raises(ValueError, match="keys differ"):
        coverage.assert_key_coverage(a, b, ["k"])
    coverage.assert_key_coverage(a, a, ["k"])


def test_only_small_tables_are_collected(spark):
    from traceforge.workspace import row_bytes, small_or_none

    df = spark.createDataFrame([("ab", 1, ["x"]), (None, 2, None)], "s string, i int, a array<string>")
    assert [r[0] for r in df.select(row_bytes(df)).collect()] == [2 + 8 + len('{"a":["x"]}'), 8 + len("{}")]
    assert small_or_none(df, 2).collect() == df.collect()
    assert small_or_none(df, 1) is None and small_or_none(df, 2, 20) is None


@pytest.mark.parametrize("order", [1, 2])
def test_split_scores_read_and_explode_the_tokens_once(spark, tmp_path, order):
    rows = [(i, ["the", "a", f"w{i}", "the", f"v{i % 7}"] * 3) for i in range(60)] + [(99, []), (98, None)]
    spark.createDataFrame(rows, "id int, tokens array<string>").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    model = lm.fit_ngram(df, "tokens", order)
    split = lm.score_ngram(df, model, ["id"], "tokens", head_rows=3)
    plan = split._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("Generate ") == 1 and plan.count("tokens#") > 0
    assert sum("FileScan" in line and "tokens" in line for line in plan.splitlines()) == 1
    whole = {r.id: r.logppl for r in lm.score_ngram(df, model, ["id"], "tokens").collect()}
    got = {r.id: r.logppl for r in split.collect()}
    assert got.keys() == whole.keys() and math.isnan(got[99]) and math.isnan(got[98])
    for key, value in whole.items():
        assert math.isnan(value) or got[key] == pytest.approx(value, rel=1e-12)


def test_sums_of_a_hot_key_and_of_keys_that_lack(spark):
    facts = spark.createDataFrame([(1, "hot")] * 50 + [(2, "rare"), (2, "new"), (3, None), (None, "hot"), (None, "rare")], "by int, k string")
    table = spark.createDataFrame([("hot", 51, 2.0), ("rare", 2, 5.0), ("other", 1, 9.0)], "k string, n int, v double")
    for options in ({}, {"head_rows": 1}, {"head_rows": 0}, {"head_bytes": 20}):
        out = lookup.lookup_sums(
            facts, table, ["k"], "n", ["by"], {"sum": F.coalesce("v", F.lit(-1.0))}, F.col("k").isNotNull(), **options
        )
        got = {r["by"]: (r["sum"], r.facts) for r in out.collect()}
        assert {k: (s or 0, n) for k, (s, n) in got.items()} == {1: (100.0, 50), 2: (4.0, 2), 3: (0, 0), None: (7.0, 2)}, options


@pytest.mark.parametrize("order", [1, 2])
def test_a_weighted_row_counts_as_often_and_is_cut_into_tokens_once(spark, order):
    rows = [("a b a", 3), ("b", 1), ("", 2), (None, 1)]
    df = spark.createDataFrame(rows, "text string, times long")
    split = F.filter(F.split("text", " "), lambda w: w != "")
    weighted = lm.fit_ngram(df.withColumn("tokens", split), "tokens", order, weight="times")
    repeated = lm.fit_ngram(df.select(F.explode(F.array_repeat("text", F.col("times").cast("int"))).alias("text"))
                            .withColumn("tokens", split), "tokens", order)
    assert sorted(weighted.counts.collect()) == sorted(repeated.counts.collect())
    assert (weighted.total, weighted.types) == (repeated.total, repeated.types)
    listed = lm.listed_ngrams(df.withColumn("tokens", split), "tokens", order)
    plan = listed._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Filter" in line and "text" in line]


def test_a_key_beyond_the_bound_is_looked_up_beside_its_facts(spark, monkeypatch):
    from traceforge.workspace import small_or_none

    monkeypatch.setattr(lookup, "small_or_none", lambda df, rows=0, **_: small_or_none(df, 2))
    facts = spark.createDataFrame([(i % 5 if i % 2 else 0, i) for i in range(40)], "k int, id int")
    table = spark.createDataFrame([(i, f"v{i}") for i in range(4)], "k int, v string")
    plain = lookup.skewed_lookup(facts, table, ["k"], 2, key_rows=1000)
    heavy = lookup.skewed_lookup(facts, table, ["k"], 2, key_rows=10)
    assert sorted(map(str, plain.collect())) == sorted(map(str, heavy.collect()))
    assert plain.count() == 40
    text = plain._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in text and "Union" in heavy._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("head_rows, paired_words", [(0, 0), (1, 1), (3, 2), (1000, 256)])
def test_bigrams_are_counted_and_scored_in_one_shuffle(spark, monkeypatch, head_rows, paired_words):
    from traceforge.operators import own_counts

    monkeypatch.setattr(own_counts.bigram_sums, "__defaults__", (head_rows, paired_words))
    rows = [(i, ["the", "a", f"w{i}", "the", f"v{i % 7}", "é"] * (i % 4)) for i in range(60)] + [(99, []), (98, None), (97, ["x"])]
    df = spark.createDataFrame([*rows, rows[5]], "id int, tokens array<string>")
    model = lm.fit_ngram(df, "tokens", 2, 0.5)
    split = lm.score_ngram(df, model, ["id"], "tokens", head_rows=head_rows, own_rows=True)
    plan = split._jdf.queryExecution().sparkPlan().toString()
    assert "Join" not in plan and plan.count("MapInArrow") == 1 and "counts" not in model.__dict__
    want = {r.id: r.logppl for r in lm.score_ngram(df, model, ["id"], "tokens").collect()}
    got = {r.id: r.logppl for r in split.collect()}
    assert got.keys() == want.keys() and all(math.isnan(got[k]) for k in (97, 98, 99))
    for key, value in want.items():
        assert math.isnan(value) and math.isnan(got[key]) or got[key] == pytest.approx(value, rel=1e-12)


def test_words_of_one_hash_get_another_key(spark):
    from traceforge.operators import own_counts

    df = spark.createDataFrame([(["a", "b", "a"],), (["c"],)], "tokens array<string>").withColumn("_w", F.lit(2).cast("long"))
    plain = own_counts._hashes
    try:
        # shipped by value, so that the tasks get it too
        own_counts._hashes = lambda words, seed: plain(words, seed) if seed else plain(words, seed) * 0
        run = own_counts.word_totals
        clash = type(run)(run.__code__, {**run.__globals__, "__name__": "__main__"}, run.__name__, run.__defaults__, run.__closure__)
        found = clash(df, "tokens", ["_w"])
    finally:
        own_counts._hashes = plain
    assert found.seed == 1
    assert sorted((r.word, r.n, r.c0, r.p0) for r in found.table.collect()) == [("a", 1, 2, 2), ("b", 1, 2, 2), ("c", 0, 0, 0)]


def test_bigram_differences_are_counted_and_scored_in_one_shuffle(spark, docs):
    out = lm.cross_entropy_difference(docs, ["id"], "tokens", F.col("id") == 1, F.col("id") == 5, 2, head_rows=1)
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert "Join" not in plan and "Generate" not in plan and plan.count("MapInArrow") == 1

import hashlib

import pytest
from pyspark.sql import functions as F

from traceforge.operators import ranking


def numbers(spark, n):
    return spark.range(n).select((F.col("id") * 7 % n).alias("k"), (F.col("id") % 3).alias("v"))


def order(n, seed):
    return sorted(range(n), key=lambda k: (hashlib.md5(f"{k}|{seed}".encode()).hexdigest(), k))


@pytest.mark.parametrize("digits", [1, 4])
def test_seeded_rank_is_the_hash_order(spark, digits):
    out = ranking.shuffled_rank(numbers(spark, 200), "k", 5, "r", "n", digits).collect()
    ranks = {r.k: r.r for r in out}
    assert ranks == {k: i + 1 for i, k in enumerate(order(200, 5))}
    assert {r.n for r in out} == {200}


def test_stored_rank_over_several_slices(spark):
    df = numbers(spark, 1000).repartition(7)
    out = ranking.stored_rank(df, ["v", F.desc("k")], "r", "n").collect()
    expected = sorted(((r.v, -r.k) for r in out))
    assert [(r.v, -r.k) for r in sorted(out, key=lambda r: r.r)] == expected
    assert sorted(r.r for r in out) == list(range(1, 1001))


def test_empty_table(spark):
    empty = numbers(spark, 10).where("k < 0")
    assert ranking.stored_rank(empty, "k").count() == 0
    assert ranking.shuffled_rank(empty, "k", 1).count() == 0
    assert ranking.split(empty, "k", "train").count() == 0


@pytest.mark.parametrize("seed", [None, 3])
@pytest.mark.parametrize("n, train", [(90, 62), (10, 7), (1, 0)])
def test_split_sizes_follow_the_double_product(spark, seed, n, train):
    parts = ranking.with_split(numbers(spark, n) if n > 1 else spark.range(1).select(F.col("id").alias("k")), "k", seed)
    counts = {r.split: r["count"] for r in parts.groupBy("split").count().collect()}
    assert counts.get("train", 0) == train and counts.get("holdout", 0) == n - train
    whole = parts.select("k").collect()
    assert sorted(r.k for r in whole) == list(range(n))


@pytest.mark.parametrize("digits", [1, 4])
def test_seeded_split_is_a_prefix_of_the_hash_order(spark, digits):
    df = numbers(spark, 120)
    train = df.where(ranking.is_train(df, "k", 8, 0.35, digits))
    assert sorted(r.k for r in train.collect()) == sorted(order(120, 8)[:42])


def test_split_by_two_columns(spark):
    df = numbers(spark, 31)
    train = {(r.v, r.k) for r in ranking.split(df, ["v", "k"], "train").collect()}
    everything = sorted((r.v, r.k) for r in df.collect())
    assert train == set(everything[:21])
    assert ranking.split(df, ["v", "k"], "train", seed=2).count() == 21


def test_split_moves_no_rows(spark):
    plan = ranking.split(numbers(spark, 90), "k", "train", seed=1)._jdf.queryExecution().toString()
    assert "Exchange" not in plan


def test_split_rejects_other_parts(spark):
    with pytest.raises(ValueError):
        ranking.split(numbers(spark, 5), "k", "test")


def test_limits(spark, monkeypatch):
    df = numbers(spark, 50)
    assert ranking.limit_n(df, "k", None).count() == 50
    assert sorted(r.k for r in ranking.limit_n(df, "k", 5).collect()) == [0, 1, 2, 3, 4]
    assert ranking.limit_n(df, "k", 500).count() == 50
    monkeypatch.setattr(ranking, "TOP_ROWS", 3)
    assert sorted(r.k for r in ranking.limit_n(df, "k", 5).collect()) == [0, 1, 2, 3, 4]


@pytest.mark.parametrize("n, shards", [(10, 3), (9, 3), (2, 5), (7, 1)])
def test_shards(spark, n, shards):
    df = spark.range(n).select(F.col("id").alias("k"))
    got = {r.k: r.shard for r in ranking.with_shard(df, "k", shards).collect()}
    expected, start = {}, 0
    for s in range(shards):
        size = n // shards + (s < n % shards)
        expected.update({k: s for k in range(start, start + size)})
        start += size
    assert got == expected
    strided = {r.k: r.shard for r in ranking.with_shard(df, "k", shards, contiguous=False).collect()}
    assert strided == {k: k % shards for k in range(n)}


def test_batches(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(5)], "k int, length int")
    plan = {r.batch: r for r in ranking.batch_plan(df, "k", "length", 2).collect()}
    assert [(b, r.rows, r.padded_length, r.padding, r.is_full) for b, r in sorted(plan.items())] == [
        (0, 2, 2, 1, True), (1, 2, 4, 1, True), (2, 1, 5, 0, False),
    ]


@pytest.mark.parametrize("top_rows", [2, 1000])
def test_examples_are_reproducible(spark, monkeypatch, top_rows):
    monkeypatch.setattr(ranking, "TOP_ROWS", top_rows)
    first = [r.k for r in ranking.example_rows(numbers(spark, 40), "k", 3, 1).collect()]
    assert sorted(first) == sorted(order(40, 1)[:3])


def test_a_null_key_is_in_exactly_one_part(spark):
    rows = spark.createDataFrame([(None,)] + [(i,) for i in range(9)], "k long")
    for seed in (None, 3):
        parts = [ranking.split(rows, "k", part, seed=seed).count() for part in ("train", "holdout")]
        assert parts == [7, 3]

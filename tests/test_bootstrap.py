import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from traceforge.operators import bootstrap
from traceforge.workspace import spread


def weights(key, seed, replicates):
    out = []
    for block in range(math.ceil(replicates / 8)):
        digest = hashlib.md5(f"{key}|{seed}|{block}".encode()).hexdigest()
        out += [sum(int(digest[4 * i : 4 * i + 4], 16) >= t for t in bootstrap.THRESHOLDS) for i in range(8)]
    return out[:replicates]


def plain(rows, baseline, seed, replicates, low):
    shares, exact = {}, {}
    for run in {r for r, *_ in rows}:
        mine = [(weights(k, seed, replicates), ok) for r, k, ok in rows if r == run and ok is not None]
        exact[run] = sum(ok for _, ok in mine) / len(mine)
        shares[run] = [sum(w[i] * ok for w, ok in mine) / sum(w[i] for w, _ in mine) for i in range(replicates)]
    out = {}
    for run in shares:
        ordered = sorted(shares[run])
        gaps = sorted(a - b for a, b in zip(shares[run], shares[baseline], strict=True))
        high = replicates - 1 - low
        out[run] = (exact[run], ordered[low], ordered[high], exact[run] - exact[baseline], gaps[low], gaps[high])
    return out


def test_intervals_equal_the_plain_computation(spark):
    rnd = random.Random(3)
    rows = [(run, k, rnd.random() < share) for run, share in (("clean", 0.8), ("guard", 0.6)) for k in range(120)]
    rows += [("clean", 200, None), ("guard", 5, True)]
    df = spark.createDataFrame(rows, "run string, id int, ok boolean").repartition(3)
    out = bootstrap.accuracy_intervals(df, "ok", "id", "run", "clean", seed=7, replicates=50, level=0.9).collect()
    want = plain(rows, "clean", 7, 50, 2)
    for r in out:
        assert (r.accuracy, r.accuracy_low, r.accuracy_high, r.delta, r.delta_low, r.delta_high) == pytest.approx(want[r.run])
        assert r.accuracy_low <= r.accuracy <= r.accuracy_high
    assert {r.run: r.traces for r in out} == {"clean": 120, "guard": 121}


def test_weights_are_poisson_and_equal_keys_weigh_alike(spark):
    df = spark.range(2000).select("id", F.explode(bootstrap.replicate_weights("id", 1, 40)).alias("w"))
    row = df.agg(F.avg("w").alias("mean"), F.var_samp("w").alias("variance"), F.max("w").alias("top")).first()
    assert row["mean"] == pytest.approx(1, abs=0.02) and row.variance == pytest.approx(1, abs=0.03) and row.top <= 8
    # a run over the very same verdicts differs from its baseline in no replicate
    verdicts = spark.range(300).select("id", (F.col("id") % 3 == 0).alias("ok"))
    twice = verdicts.withColumn("run", F.lit("a")).union(verdicts.withColumn("run", F.lit("b")))
    for r in bootstrap.accuracy_intervals(twice, "ok", "id", "run", "a", replicates=20).collect():
        assert (r.delta, r.delta_low, r.delta_high) == (0, 0, 0)


def test_groups_each_have_their_baseline(spark):
    df = spark.createDataFrame(
        [("x", "a", 1, True), ("x", "b", 1, False), ("y", "a", 2, False), ("y", "b", 2, True)],
        "split string, run string, id int, ok boolean",
    )
    out = bootstrap.accuracy_intervals(df, "ok", "id", "run", "a", by=["split"], replicates=10).collect()
    assert {(r.split, r.run): r.delta for r in out} == {("x", "a"): 0, ("x", "b"): -1, ("y", "a"): 0, ("y", "b"): 1}
    with pytest.raises(Exception, match="not one baseline"):
        bootstrap.accuracy_intervals(df.where("run = 'b' or split = 'x'"), "ok", "id", "run", "a", by=["split"]).collect()
    assert bootstrap.accuracy_intervals(df.limit(0), "ok", "id", "run", "a").count() == 0


def test_narrow_rows_are_cut_into_tasks_by_their_number(spark, tmp_path):
    spark.range(1_200_000).coalesce(1).write.parquet(str(tmp_path / "ids"))
    rows = spread(spark.read.parquet(str(tmp_path / "ids")), "id")
    assert rows.rdd.getNumPartitions() == 12 and rows.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] < 110_000

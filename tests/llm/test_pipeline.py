"""The pipeline's stages on the smallest tables, and the registered twins."""

from __future__ import annotations

import random

import corpus_pipeline
import duckdb
import pytest
from pyspark.sql import functions as F

from traceforge.llm import registered, simhash
from traceforge.llm.components import connected_components

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / "out")
        stage(spark, docs, SF).write.parquet(path)
        out.append((name, docs, spark.read.parquet(path)))
        docs = out[-1][2]
    return out


def test_all_but_the_last_stage_keep_the_columns(stages):
    for _, before, after in stages[:-1]:
        assert after.columns == before.columns
        assert after.select("doc_id").distinct().count() == after.count()


def test_every_id_is_packed_once(stages):
    _, before, pieces = stages[-1]
    assert pieces.select("doc_id").distinct().count() == before.count()


def test_run_gives_the_last_stage(spark, stages):
    assert corpus_pipeline.run(spark, SF).columns == stages[-1][2].columns


def test_stages_take_empty_tables(spark, tmp_path):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, spark.read.parquet(f"{SF}/documents.parquet").limit(0), SF).count() == 0, name


@pytest.mark.parametrize("name", sorted(registered.ORACLE))
def test_twins(spark, name):
    for table in ("embeddings", "pages", "documents", "benchmark"):
        duckdb.sql(f"create or replace view {table} as from '{SF}/{table}.parquet'")
    got = registered.QUERIES[name](spark, SF)
    want = duckdb.sql(registered.ORACLE[name])
    assert sorted(map(str, map(tuple, got.select(*want.columns).collect()))) == sorted(map(str, want.fetchall()))


def alike(rnd, n, similarity):
    """Two texts of ``n`` words each whose five-word shingles have about this similarity, and that similarity."""
    a = [f"w{rnd.randrange(10**6)}" for _ in range(n)]
    b, at, shingles = list(a), list(range(0, n, 6)), lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    rnd.shuffle(at)
    while True:
        x, y = shingles(a), shingles(b)
        if (got := len(x & y) / len(x | y)) <= similarity:
            return " ".join(a), " ".join(b), got
        b[at.pop()] = f"w{rnd.randrange(10**6)}"


def test_pairs_just_above_the_similarity_are_found(spark):
    rnd = random.Random(1)
    made = [alike(rnd, 300, 0.82) for _ in range(150)]
    data = [(2 * i + k, pair[k]) for i, pair in enumerate(made) for k in (0, 1)]
    kept = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(data, "doc_id long, text string"), "")
    ids = {r["doc_id"] for r in kept.collect()}
    over = [i for i, (_, _, got) in enumerate(made) if got >= 0.8]
    assert sum(2 * i + 1 in ids for i in over) <= 0.08 * len(over)
    assert all(2 * i + 1 in ids for i in range(150) if made[i][2] < 0.8) and all(2 * i in ids for i in range(150))


def test_nodes_that_a_leader_refuses_meet(spark):
    zero, near = bytes(64), bytes(63) + b"\x01"
    far = bytes(32) + b"\xff" * 32
    rows = [(n, zero) for n in range(30)] + [(100 + n, far if n % 2 else far[:-1] + b"\xfe") for n in range(30)] + [(200, near)]
    nodes = spark.createDataFrame(rows, "node long, fingerprint binary")
    found = {frozenset(r) for part in simhash._candidates(nodes, 28, range(2), 8, 0.23) for r in part.collect()}
    for low, high in ((0, 30), (100, 130)):
        left = set(range(low, high))
        reached = {low}
        for _ in left:
            reached |= {n for pair in found if pair & reached for n in pair}
        assert left <= reached
    assert not any(min(pair) < 100 <= max(pair) < 200 for pair in found)


def test_keys_up_to_two_bits_apart_meet(spark):
    # one or two bits differ in either key of 28 bits, so that no key is equal; three do in the last one
    bits = {1: (), 2: (3, 30), 3: (5, 9, 35, 40), 4: (200, 12, 13, 14, 50, 51, 52)}
    rows = [(n, int(sum(1 << (511 - b) for b in at)).to_bytes(64)) for n, at in bits.items()]
    nodes = spark.createDataFrame([(n, bytearray(f)) for n, f in rows], "node long, fingerprint binary")
    found = {frozenset(r) for part in simhash._candidates(nodes, 28, range(2), 8, 0.23) for r in part.collect()}
    assert found == {frozenset((1, 2)), frozenset((1, 3))}


def test_rows_without_an_id_and_other_texts_of_an_id_stay(spark):
    rnd = random.Random(2)
    one, two, three = (" ".join(f"w{rnd.randrange(10**6)}" for _ in range(100)) for _ in range(3))
    data = [(1, one), (1, two), (1, one), (2, one), (3, three), (None, one), (None, one)]
    kept = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(data, "doc_id long, text string"), "")
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([(1, one), (1, two), (3, three), (None, one), (None, one)], key=str)


def test_every_pair_of_the_similarity_is_found(spark, monkeypatch):
    # as many documents as make keys wide, all pairs close to the limit; a line in all texts meets nothing
    rnd = random.Random(4)
    made = [alike(rnd, 100, 0.82) for _ in range(400)]
    data = [(2 * i + k, pair[k]) for i, pair in enumerate(made) for k in (0, 1)]
    want = {2 * i + 1 for i, (_, _, got) in enumerate(made) if got >= 0.8}
    monkeypatch.setattr(simhash, "MOST", 50, raising=False)
    line = " ".join(f"common{i}" for i in range(8))
    data += [(1000 + i, f"{line} {' '.join(f'u{i}x{j}' for j in range(30))}") for i in range(120)]
    kept = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(data, "doc_id long, text string"), "")
    assert {i for i, _ in data} - {r["doc_id"] for r in kept.collect()} == want and len(want) > 100


def test_copies_of_a_text_do_not_meet_pair_by_pair(spark):
    rnd = random.Random(5)
    base, texts = [f"w{i}" for i in range(200)], []
    for _ in range(300):
        edited = list(base)
        edited[rnd.randrange(200)] = f"e{rnd.randrange(10**6)}"
        texts.append(" ".join(edited))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = simhash._sets(docs.selectExpr("doc_id as node", "doc_id", "xxhash64(text) as hash"), docs, 5).cache()
    entries = simhash._prefixes(sets, 0.8).cache()
    groups = spark.createDataFrame([], "node long, component long")
    for lead in (F.min, None):
        pairs = simhash._meeting(entries, groups, 0.8, lead).cache()
        assert pairs.count() <= 8 * len(texts)
        groups = connected_components(simhash._alike(pairs, sets, 0.8).unionByName(groups.toDF("a", "b")))
    assert groups.count() == len(texts) - 1 and [r[0] for r in groups.select("component").distinct().collect()] == [0]
    assert corpus_pipeline.drop_near_copies(spark, docs, "").count() == 1


def test_texts_that_share_most_words_do_not_meet_pair_by_pair(spark):
    # 0.55 of a text is a passage of all: under the similarity by far, and many in the shingles that are looked at
    rnd, shared = random.Random(6), [f"w{i}" for i in range(70)]
    texts = [" ".join([*shared, *(f"u{i}x{j}" for j in range(30 + rnd.randrange(4)))]) for i in range(200)]
    pairs = [" ".join([*shared, *(f"p{i}x{j}" for j in range(30)), *"ab"[: k]]) for i in range(5) for k in (0, 1)]
    docs = spark.createDataFrame(list(enumerate(texts + pairs)), "doc_id long, text string")
    sets = simhash._sets(docs.selectExpr("doc_id as node", "doc_id", "xxhash64(text) as hash"), docs, 5).cache()
    groups = spark.createDataFrame([], "node long, component long")
    met = simhash._meeting(simhash._prefixes(sets, 0.8), groups, 0.8, None)
    found = {tuple(r) for r in met.collect()}
    assert {(200 + 2 * i + 1, 200 + 2 * i) for i in range(5)} <= found and len(found) <= len(texts)


def test_rounds_of_contraction_give_their_shuffle_files_back(spark, monkeypatch):
    from traceforge.llm import components

    released, before = [], components.release
    monkeypatch.setattr(components, "release", lambda s: released.append(before(s)))
    chain = spark.createDataFrame([(i, i + 1) for i in range(20)], "a long, b long")
    assert {r["component"] for r in connected_components(chain).collect()} == {0} and len(released) >= 2

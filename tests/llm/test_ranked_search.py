"""Ranked search against scores of every pair, and the tree's bounds."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from traceforge.llm import ranked_search
from traceforge.llm.ranked_search import BallTree, Best, Queries

DOCS = "doc_id long, text string, score long, at string, item_id int"
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]


def plain(docs, items, k):
    held = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    total = sum(sum(c.values()) for _, c in held)
    out = []
    for item_id, text in dict.fromkeys((i, t) for i, t in items if t is not None):
        scores = []
        for doc_id, counts in held:
            n = sum(counts.values())
            m = 50 + (50 * n * len(held)) // total
            score = 0
            for term in set(terms(text)):
                holding = sum(term in c for _, c in held)
                if counts[term]:
                    weight = math.floor(1000 * math.log((2 * len(held) + 2) / (2 * holding + 1)))
                    score += weight * ((10**9 * counts[term]) // (1000 * counts[term] + 20 * m))
            if score > 0:
                scores.append((-score, doc_id is None, doc_id or 0))
        for nth, (score, none, doc_id) in enumerate(sorted(scores)[:k]):
            out.append((item_id, nth + 1, None if none else doc_id, -score))
    return sorted(out, key=str)


def corpus():
    rnd = random.Random(5)
    word = lambda: rnd.choice("abcdefgh") + rnd.choice(["", "x", "É", "1"]) * int(rnd.random() * 3)
    docs = [" ".join(word() for _ in range(rnd.choice([0, 1, 5, 40, 200]))) for _ in range(150)]
    docs += [docs[3], docs[3], docs[5].upper(), "", None, "!!! --", "a_b.c/d é日本 A", "ax " * 3000, "zzz only once"]
    rows = list(enumerate(docs)) + [(None, "ax bÉ no id"), (None, "ax bÉ no id"), (7, "hx repeated id ax")]
    items = [(i, " ".join(word() for _ in range(rnd.choice([1, 4, 12])))) for i in range(25)]
    items += [(1, items[1][1]), (1, "another text ax"), (None, "bÉ ax"), (40, None), (41, "?!"), (42, "unseen"), (43, "zzz A日 é日本")]
    return rows, items


@pytest.mark.parametrize("sizes", [{}, {"ITEM_BYTES": 200, "GROUP": 3, "TREE_DOCS": 11, "SLOTS": 2}, {"TREE_ENTRIES": 30, "LEAF": 1}])
def test_ranks_equal_brute_force(spark, monkeypatch, sizes):
    for name, value in sizes.items():
        monkeypatch.setattr(ranked_search, name, value)
    rows, items = corpus()
    docs = spark.createDataFrame([(i, t, 1, "clash", 2) for i, t in rows], DOCS).repartition(3)
    benchmark = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, rank int")
    got = ranked_search.rank(docs, benchmark, k=10)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == plain(rows, items, 10)


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], DOCS), spark.createDataFrame([], "item_id long, text string")
    one = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert ranked_search.rank(docs, one).count() == 0
    assert ranked_search.rank(docs, items).count() == 0
    assert ranked_search.rank(one.withColumnRenamed("item_id", "doc_id"), items).count() == 0


def tree_of(rnd, families, copies, width):
    """Documents near a few centres, so that balls are small."""
    starts, at, values = [0], [], []
    for _ in range(families):
        base = sorted(rnd.sample(range(width), 30))
        for _ in range(copies):
            own = sorted(set(rnd.sample(base, 28) + rnd.sample(range(width), 2)))
            at += own
            values += [rnd.randint(400_000, 500_000) * 7000 for _ in own]
            starts.append(len(at))
    band = np.arange(width) * 16 // width
    return BallTree(np.array(starts), np.array(at), np.array(values, np.int64), band), band


def test_bounds_hold_and_prune():
    rnd = random.Random(3)
    tree, _ = tree_of(rnd, 40, 50, 600)
    sets = [sorted(rnd.sample(range(600), 20)) for _ in range(30)]
    queries = Queries(sets, 600)
    dense = np.zeros((2000, 600), np.int64)
    for d in range(2000):
        own = slice(tree.starts[d], tree.starts[d + 1])
        dense[d, tree.at[own]] = tree.values[own]
    masks = np.zeros((600, 30), np.int64)
    for q, s in enumerate(sets):
        masks[s, q] = 1
    scores = dense @ masks

    def below(node):
        child = tree.children[node]
        return child if isinstance(child, np.ndarray) else np.concatenate([below(c) for c in child])

    for node in range(len(tree.nodes)):
        assert (tree.bounds(node, queries) >= scores[below(node)].max(axis=0)).all()
    best = Best(30, 5)
    pairs = tree.search(queries, np.arange(2000), best)
    assert pairs < 0.5 * 30 * 2000  # of 60,000 pairs
    for q in range(30):
        want = sorted(((-int(s), d) for d, s in enumerate(scores[:, q]) if s > 0))[:5]
        assert sorted((-s, -d) for s, d in best.heaps[q]) == want

"""Spelling variants against all pairs."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest

from traceforge.llm import spelling
from traceforge.llm.spelling import VocabularyIndex

DOCS = "doc_id long, text string, word string, n long"


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def vocabulary(rnd, n, letters="abc", least=7):
    words = set()
    while len(words) < n:
        word = "".join(rnd.choice(letters) for _ in range(rnd.randint(least, least + 3)))
        at = rnd.randrange(len(word))
        words |= {word, word[:at] + word[at + 1 :], word[:at] + rnd.choice(letters + "éà") + word[at:]}
    return sorted(w for w in words if len(w) >= least)


@pytest.mark.parametrize("letters,least", [("ab", 2), ("abc", 7), ("xyzéü日", 4)])
def test_index_finds_every_pair_once(letters, least):
    words = vocabulary(random.Random(least), 150, letters, least)
    index = VocabularyIndex(words[::2], words)
    got = [
        (words[q], index.words[w])
        for prefix in (True, False)
        for query, word in index.near(words, prefix)
        for q, w in zip(query.tolist(), word.tolist(), strict=True)
    ]
    assert sorted(got) == sorted((a, b) for a in words for b in index.words if one_edit(a, b))


def plain(counts):
    for word, n in counts.items():
        near = sorted((-counts[o], o) for o in counts if one_edit(word, o))
        form = near[0][1] if near and -near[0][0] >= 10 * n else None
        yield word, form, n, len(near), counts[form] if form else None


def plain_groups(counts):
    rows = list(plain(counts))
    forms = {word: form for word, form, *_ in rows}

    def root(word):
        while forms[word]:
            word = forms[word]
        return word

    return sorted((w, f, root(w), n, k, m) for w, f, n, k, m in rows)


@pytest.mark.parametrize("block_words", [None, 64])
def test_groups_equal_brute_force(spark, block_words):
    rnd = random.Random(11)
    counts = {w: rnd.choice([2, 3, 20, 30, 300, 4000, 50000]) for w in vocabulary(rnd, 400)}
    counts |= {"commonpre" + "".join(rnd.choice("ab") for _ in range(4)): 5 for _ in range(40)}  # one begin, many blocks
    counts |= {"q" * 900: 2, "q" * 901: 40, "q" * 902: 500, "q" * 899 + "z": 2}
    words = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3)
    got = spelling.group_variants(words, block_words=block_words)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted(map(tuple, got.collect())) == plain_groups(counts)
    assert any(r[2] != (r[1] or r[0]) for r in plain_groups(counts))  # chains of more than one form


def test_long_words_are_indexed_in_parts(spark, monkeypatch):
    monkeypatch.setattr(spelling, "INDEX_LETTERS", 100)
    monkeypatch.setattr(spelling, "CELLS", 64)
    rows = {w: 2 + i for i, w in enumerate(vocabulary(random.Random(2), 60))}
    words = spark.createDataFrame(list(rows.items()), "word string, n long").coalesce(1)
    got = spelling.near_words(words).select("word", "near").collect()
    assert sorted(map(tuple, got)) == sorted((a, b) for a in rows for b in rows if one_edit(a, b))


def test_words_of_a_corpus(spark, monkeypatch):
    monkeypatch.setattr(spelling, "COUNTED_WORDS", 3)
    texts = ["Hällowelt HÄLLOWELT hÄllowelt 1letters2lettersé", None, "", "abcdefg" * 500, "short runs on ly", "÷×wordsÿÀ words"]
    texts += ["lettersx and lettersy " * 3, "ǅletterſab letterſ", "abcdefg abcdefg"] * 30
    rows = [(i, t, "clash", 1) for i, t in enumerate(texts)] + [(None, "lettersx lettersx", "", 0), (3, "lettersx", "", 0)]
    docs = spark.createDataFrame(rows, DOCS).repartition(2)
    want = Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            want[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    want = {w: n for w, n in want.items() if len(w) >= 7 and n >= 2}
    got = spelling.corpus_words(docs, misspell=31)
    assert {r["word"]: r["n"] for r in got.collect()} == want
    assert sorted(map(tuple, spelling.group_variants(got).collect())) == plain_groups(want)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], DOCS)
    words = spelling.corpus_words(empty, misspell=31)
    assert words.count() == 0
    assert spelling.group_variants(words).count() == 0

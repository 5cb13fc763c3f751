"""Lattice language model against a plain version over the same rows."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from traceforge.llm import language, lattice_lm

VOCABULARY = public_tokenizers.path("piece_bpe_32k.model")
DOCS = "doc_id long, text string, score double, word string"
WORD = re.compile("[^\x20\x09-\x0d]+")
TEXTS = [
    "The cat sat on the mat", "the CAT\tsat\x0bagain\x85here", "", None, "  \n ", "naïve façade 日本語 🙂 ǅungla",
    "x" * 700 + " end", "\x00 odd ▁▁ word", "the the the", "the the the", "A b É", "common rare" * 40,
] * 3 + ["the quick brown fox"] * 15 + ["longword" * 400]
ROWS = [(i, t, 0.5, "clash") for i, t in enumerate(TEXTS)] + [(None, "null id", 0.1, ""), (3, "id again", 0.1, "")]


def lowered(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall(text or "")]


def is_held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 10 == 0


class Plain:
    """Probabilities in plain numbers per word, by a loop over all cuts."""

    def __init__(self):
        self.sp = sentencepiece.SentencePieceProcessor(model_file=VOCABULARY)
        self.ids = {
            p: i for i in range(self.sp.vocab_size())
            if not (self.sp.is_control(i) or self.sp.is_unknown(i) or self.sp.is_byte(i))
            and "▁" not in (p := self.sp.id_to_piece(i))[1:] and not re.search("[A-Z]", p)
        }
        self.bytes = {b: self.sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)}
        size = self.sp.vocab_size()
        p = np.zeros(size)
        for i in self.ids.values():
            p[i] = 1 / (1 + min(size, -self.sp.get_score(i)))
        for i in self.bytes.values():
            p[i] = 1 / (1 + size)
        p[self.sp.eos_id()] = 1 / size
        self.prior = self.p = p / p.sum()

    def edges(self, word):
        symbols = [s for c in "▁" + word for s in ([c] if c in self.ids else c.encode())]
        for i, first in enumerate(symbols):
            if isinstance(first, int):
                yield i, i + 1, self.bytes[first], len(symbols)
                continue
            for j in range(i + 1, min(len(symbols), i + 16) + 1):
                if isinstance(symbols[j - 1], int):
                    break
                piece = self.ids.get("".join(symbols[i:j]))
                if piece is not None:
                    yield i, j, piece, len(symbols)

    def log(self, word):
        return self.lattice(word)[0]

    def lattice(self, word):
        found = list(self.edges(word))
        n = found[0][3]
        ahead, behind = [-math.inf] * (n + 1), [-math.inf] * (n + 1)
        ahead[0] = behind[n] = 0.0
        for i, j, piece, _ in sorted(found, key=lambda e: e[1]):
            ahead[j] = np.logaddexp(ahead[j], ahead[i] + math.log(self.p[piece]))
        for i, j, piece, _ in sorted(found, key=lambda e: -e[0]):
            behind[i] = np.logaddexp(behind[i], behind[j] + math.log(self.p[piece]))
        shares = Counter()
        for i, j, piece, _ in found:
            shares[piece] += math.exp(ahead[i] + math.log(self.p[piece]) + behind[j] - ahead[n])
        return ahead[n], shares

    def learn(self, counts, ends):
        for _ in range(2):
            sums = np.zeros(len(self.prior))
            for word, count in counts.items():
                for piece, share in self.lattice(word)[1].items():
                    sums[piece] += share * count
            sums[self.sp.eos_id()] = ends
            pseudo = np.count_nonzero(self.prior)
            self.p = (sums + pseudo * self.prior) / (sums.sum() + pseudo)


def expected_rows(rows):
    learning = [t for i, t, *_ in rows if not is_held(i)]
    counts = Counter(w for t in learning for w in lowered(t))
    plain = Plain()
    plain.learn(counts, len(learning))
    total, types = sum(counts.values()) + len(learning), len(counts) + bool(learning)
    base = lambda c: math.log10((c + 0.1) / (total + 0.1 * (types + 1)))
    for i, text, *_ in rows:
        found = lowered(text)
        yield (
            i, is_held(i), len(found) + 1, sum(counts[w] > 0 for w in found) + bool(learning), total,
            sum(base(counts[w]) for w in found) + base(len(learning)),
            (sum(plain.log(w) for w in found) + math.log(plain.p[plain.sp.eos_id()])) / math.log(10),
        )


@pytest.mark.parametrize("head_rows", [lattice_lm.HEAD_ROWS, 3, 0])
def test_scores_equal_the_plain_version(spark, monkeypatch, head_rows):
    monkeypatch.setattr(lattice_lm, "HEAD_ROWS", head_rows)
    monkeypatch.setattr(lattice_lm, "COUNTED_WORDS", 5)
    docs = spark.createDataFrame(ROWS, DOCS).repartition(3)
    held = language.held_out(F.col("doc_id"), 10, 0)
    model = lattice_lm.fit(docs, held, VOCABULARY)
    got = lattice_lm.score(docs, model, keep=(held.alias("held_out"),))
    assert got.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    order = lambda r: (r[0] is None, r[0] or 0, r[2], r[6])
    got, want = sorted(map(tuple, got.collect()), key=order), sorted(expected_rows(ROWS), key=order)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    np.testing.assert_allclose([g[5:] for g in got], [w[5:] for w in want], rtol=1e-9)


def test_tables_without_rows_or_learning_texts(spark):
    held = language.held_out(F.col("doc_id"), 10, 0)
    empty = spark.createDataFrame([], DOCS)
    assert lattice_lm.score(empty, lattice_lm.fit(empty, held, VOCABULARY)).count() == 0
    only_held = spark.createDataFrame([(next(i for i in range(99) if is_held(i)), "a b", 0.0, "")], DOCS)
    row = lattice_lm.score(only_held, lattice_lm.fit(only_held, held, VOCABULARY)).first()
    assert (row["n_known"], row["train_tokens"], row["n_tokens"]) == (0, 0, 3)
    assert row["base_score"] == 0 and row["score"] < 0


def test_words_of_many_lengths_share_batches():
    own = lattice_lm.lattice(VOCABULARY)
    words = ["a" * n for n in (1, 400, 3, 90, 2)] + ["the", "日" * 50]
    logs = lattice_lm._logs(own.prior)
    plain = Plain()
    np.testing.assert_allclose(own.log_probability(words, logs), [plain.log(w) for w in words], rtol=1e-9)
    sums = own.expected(words, np.ones(len(words)), logs)
    want = Counter()
    for word in words:
        want.update(plain.lattice(word)[1])
    np.testing.assert_allclose(sums[list(want)], list(want.values()), rtol=1e-6)
    assert np.isclose(sums.sum(), sum(want.values()))

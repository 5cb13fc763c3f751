"""Language-model scoring: probability of a text over all its segmentations into an existing vocabulary's pieces."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from traceforge.llm.common import in_chunks, in_sizes
from traceforge.operators.lookup import _heavy_cut
from traceforge.workspace import materialise

# --- fixed values: sentencepiece's sign for a blank, where byte pieces stand among the symbols
BLANK, BYTE_SYMBOL = "▁", 0x110000
# Symbols below this have a column of their own in the dense step table.
DENSE = 0x100
# Characters read at once, words counted before they are sent on, cells of one batch of words.
CHUNK_CHARS, COUNTED_WORDS, CELLS = 1 << 20, 1 << 18, 1 << 16
# Most frequent words that every task looks up by itself: rows, bytes.
HEAD_ROWS, HEAD_BYTES = 200_000, 16 << 20
SMOOTHING = 0.1


def tokens(text: str | None) -> list[bytes]:
    """Words of a text, A-Z in lower case; ``bytes`` lowers and splits just these."""
    return text.encode().lower().split() if text else []


class Lattice:
    """Pieces that may follow each other in a word, as a tree of symbols.

    A symbol is a character, or one byte of a character that no piece spells.
    Pieces with a blank beyond their first place, or an upper-case A-Z, occur in
    no word and are left out. ``prior`` is the vocabulary's own score made a
    probability: the scores number the pieces by rank, so a piece of rank r
    weighs 1 / (r + 1); bytes and the end of a text weigh as the last rank.
    """

    def __init__(self, path: str) -> None:
        vocabulary = sentencepiece.SentencePieceProcessor(model_file=path)
        self.end = vocabulary.eos_id()
        self.size = vocabulary.vocab_size()
        self.prior = np.zeros(self.size)
        steps: dict[tuple[int, int], int] = {}
        final = [-1, -1]  # state 0 is dead, 1 is the root
        spelled: dict[int, int] = {}
        for i in range(self.size):
            piece = vocabulary.id_to_piece(i)
            if vocabulary.is_byte(i):
                symbols = [BYTE_SYMBOL + int(piece[1:-1], 16)]
            elif i == self.end:
                self.prior[i] = 1 / self.size
                continue
            elif vocabulary.is_control(i) or vocabulary.is_unknown(i) or BLANK in piece[1:] or any("A" <= c <= "Z" for c in piece):
                continue
            else:
                symbols = [ord(c) for c in piece]
            if len(symbols) == 1:
                spelled[symbols[0]] = i
            self.prior[i] = 1 / (1 + (self.size if vocabulary.is_byte(i) else min(self.size, -vocabulary.get_score(i))))
            state = 1
            for symbol in symbols:
                key = (state, symbol)
                if key not in steps:
                    steps[key] = len(final)
                    final.append(-1)
                state = steps[key]
            final[state] = i
            self.longest = max(getattr(self, "longest", 1), len(symbols))
        self.prior /= self.prior.sum()
        self.final = np.array(final, np.int32)
        self.spelled = np.array(sorted(spelled), np.uint32)
        inner = sorted({state for state, _ in steps})
        self.row = np.zeros(len(final), np.int32)
        self.row[inner] = np.arange(1, len(inner) + 1)
        self.dense = np.zeros((len(inner) + 1, DENSE), np.int32)
        rare = []
        for (state, symbol), after in steps.items():
            if symbol < DENSE:
                self.dense[self.row[state], symbol] = after
            else:
                rare.append((state << 32 | symbol, after))
        rare.sort()
        self.rare_keys = np.array([k for k, _ in rare], np.int64)
        self.rare_after = np.array([a for _, a in rare], np.int32)

    def symbols(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all words, each behind a blank, and how many each has."""
        joined = "".join(f"{BLANK}{w}" for w in words)
        codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        lengths = np.array([len(w) + 1 for w in words])
        at = np.minimum(np.searchsorted(self.spelled, codes), len(self.spelled) - 1)
        unknown = self.spelled[at] != codes
        if not unknown.any():
            return codes, lengths
        width = np.where(unknown, 1 + (codes >= 0x80).astype(int) + (codes >= 0x800) + (codes >= 0x10000), 1)
        starts = np.cumsum(width) - width
        out = np.repeat(codes, width)
        for code in np.unique(codes[unknown]).tolist():
            first = starts[np.flatnonzero(codes == code)]
            for nth, byte in enumerate(chr(code).encode()):
                out[first + nth] = BYTE_SYMBOL + byte
        owner = np.repeat(np.arange(len(words)), lengths)
        return out, np.bincount(owner, weights=width, minlength=len(words)).astype(int)

    def _step(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        near = symbol < DENSE
        after = self.dense[self.row[state], np.where(near, symbol, 0)]
        far = np.flatnonzero(~near & (state > 0))
        if len(far):
            keys = state.ravel()[far].astype(np.int64) << 32 | symbol.ravel()[far]
            at = np.minimum(np.searchsorted(self.rare_keys, keys), len(self.rare_keys) - 1)
            after.ravel()[far] = np.where(self.rare_keys[at] == keys, self.rare_after[at], 0)
        after[state == 0] = 0
        return after

    def _batches(self, words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Positions of words of like length, their lengths, their symbols: one column a word, zeros below."""
        codes, lengths = self.symbols(words)
        starts = np.cumsum(lengths) - lengths
        order = np.argsort(-lengths, kind="stable")
        at = 0
        while at < len(order):
            most = int(lengths[order[at]])
            chosen = order[at : at + max(1, CELLS // most)]
            at += len(chosen)
            size = lengths[chosen]
            place = np.arange(most)[:, None]
            table = codes[np.minimum(starts[chosen] + place, len(codes) - 1)]
            yield chosen, size, np.where(place < size, table, 0)

    def _pieces(self, table: np.ndarray) -> np.ndarray:
        """``[place, k, word]``: the piece of k + 1 symbols that starts there, else -1."""
        most, n = table.shape
        found = np.full((most, min(self.longest, most), n), -1, np.int32)
        state = np.ones((most, n), np.int32)
        for k in range(found.shape[1]):
            state = self._step(state[: most - k], table[k:])
            found[: most - k, k] = self.final[state]
            if not state.any():
                break
        return found

    @staticmethod
    def _sums(values: np.ndarray) -> np.ndarray:
        """Logarithm of the sum of exponentials along the first axis, minus infinity for none."""
        top = values.max(axis=0)
        base = np.where(top > -np.inf, top, 0)
        with np.errstate(divide="ignore"):
            return base + np.log(np.exp(values - base).sum(axis=0))

    def _forward(self, scores: np.ndarray) -> np.ndarray:
        """Log-probability of all segmentations of the first j symbols, ``[j, word]``."""
        most, widest, n = scores.shape
        out = np.full((most + 1, n), -np.inf)
        out[0] = 0
        for j in range(1, most + 1):
            k = np.arange(min(widest, j))
            out[j] = self._sums(out[j - 1 - k] + scores[j - 1 - k, k])
        return out

    def _backward(self, scores: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Log-probability of all segmentations from symbol j to the word's end, ``[j, word]``."""
        most, widest, n = scores.shape
        out = np.full((most + 1, n), -np.inf)
        out[size, np.arange(n)] = 0
        for j in range(most - 1, -1, -1):
            k = np.arange(min(widest, most - j))
            follow = self._sums(out[j + 1 + k] + scores[j, k])
            out[j] = np.where(j < size, follow, out[j])
        return out

    def log_probability(self, words: list[str], logs: np.ndarray) -> np.ndarray:
        """Natural logarithm of each word's marginal probability; ``logs`` is by piece, its last entry for none."""
        out = np.zeros(len(words))
        for chosen, size, table in self._batches(words):
            forward = self._forward(logs[self._pieces(table)])
            out[chosen] = forward[size, np.arange(len(chosen))]
        return out

    def expected(self, words: list[str], weights: np.ndarray, logs: np.ndarray) -> np.ndarray:
        """Expected number of each piece over the segmentations of all words, each counted ``weights`` times."""
        out = np.zeros(self.size)
        for chosen, size, table in self._batches(words):
            pieces = self._pieces(table)
            scores = logs[pieces]
            forward, backward = self._forward(scores), self._backward(scores, size)
            whole = forward[size, np.arange(len(chosen))]
            most, widest, n = scores.shape
            for k in range(widest):
                shares = np.exp(forward[: most - k] + scores[: most - k, k] + backward[k + 1 :] - whole)
                real = pieces[: most - k, k] >= 0
                out += np.bincount(pieces[: most - k, k][real], (shares * weights[chosen])[real], self.size)
        return out


_LATTICES: dict[str, Lattice] = {}


def lattice(path: str) -> Lattice:
    """One lattice per worker process."""
    if path not in _LATTICES:
        _LATTICES[path] = Lattice(path)
    return _LATTICES[path]


def _logs(probabilities: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.log(np.append(probabilities, 0))


def count_words(docs: DataFrame, held_out: Column, text: str = "text") -> DataFrame:
    """``word, n, c``: occurrences in all texts and in the learning ones; a null word is the end of a text.

    Counted per task before the shuffle, so that a frequent word is a few rows.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every, out = Counter(), Counter()

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays(
                [
                    pa.array(list(every), pa.binary()).cast(pa.string()),
                    pa.array(list(every.values()), pa.int64()),
                    pa.array([n - out[w] for w, n in every.items()], pa.int64()),
                ],
                ["word", "n", "c"],
            )
            every.clear()
            out.clear()
            return batch

        for batch in batches:
            for value, held in zip(batch.column("text"), batch.column("held").to_pylist(), strict=True):
                found = tokens(value.as_py())
                found.append(None)
                every.update(found)
                if held:
                    out.update(found)
                if len(every) > COUNTED_WORDS:
                    yield flush()
        yield flush()

    rows = docs.select(F.col(text).cast("string").alias("text"), held_out.alias("held"))
    counted = rows.mapInArrow(run, "word string, n long, c long")
    return materialise(counted.groupBy("word").agg(F.sum("n").alias("n"), F.sum("c").alias("c")), "lm-words")


@dataclass(frozen=True)
class LatticeModel:
    """``words`` has each word of the corpus with its counts and log10 probability ``lp``."""

    words: DataFrame
    total: int
    types: int
    end_seen: int
    end_lp: float

    def base(self, count: Column) -> Column:
        return F.log10((count + SMOOTHING) / (self.total + SMOOTHING * (self.types + 1)))


def fit(docs: DataFrame, held_out: Column, vocabulary: str, text: str = "text", rounds: int = 2) -> LatticeModel:
    """Learn the weight of each piece from the texts that are not ``held_out``.

    The vocabulary's own scores weight the first segmentations. Each round sums
    the expected pieces over all distinct learning words times their counts, in
    Spark, and mixes in the prior as if it were one occurrence per piece; a
    round's sums are one number per piece. A table without learning texts leaves
    the prior as it is.
    """
    words = count_words(docs, held_out, text)
    total, types, ends = words.agg(F.sum("c"), F.count_if(F.col("c") > 0), F.sum(F.when(F.col("word").isNull(), F.col("c")))).first()
    own = lattice(vocabulary)
    weights = own.prior
    learning = words.where("c > 0 and word is not null")
    for _ in range(rounds):
        sums = np.zeros(own.size)
        for row in _expected(learning, vocabulary, _logs(weights)).collect():  # at most one row a piece
            sums[row["piece"]] = row["n"]
        sums[own.end] = ends or 0
        pseudo = np.count_nonzero(own.prior)
        weights = (sums + pseudo * own.prior) / (sums.sum() + pseudo)
    logs = _logs(weights)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = lattice(vocabulary).log_probability
            values = [known(part, logs) for part in in_sizes(batch.column("word").to_pylist(), CHUNK_CHARS)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.concatenate(values) / np.log(10))], ["word", "n", "c", "lp"]
            )

    scored = words.where("word is not null").mapInArrow(run, "word string, n long, c long, lp double")
    return LatticeModel(
        materialise(scored, "lm-scored"), int(total or 0), int(types), int(ends or 0), float(logs[own.end] / np.log(10))
    )


def _expected(words: DataFrame, vocabulary: str, logs: np.ndarray) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = lattice(vocabulary)
        sums = np.zeros(own.size)
        for batch in batches:
            listed, counts, at = batch.column("word").to_pylist(), batch.column("c").to_numpy(), 0
            for part in in_sizes(listed, CHUNK_CHARS):
                sums += own.expected(part, counts[at : at + len(part)].astype(float), logs)
                at += len(part)
        used = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(sums[used])], ["piece", "n"])

    return words.mapInArrow(run, "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n"))


def score(
    docs: DataFrame, model: LatticeModel, text: str = "text", doc_id: str = "doc_id", keep: tuple[Column, ...] = ()
) -> DataFrame:
    """``doc_id, n_tokens, n_known, train_tokens, base_score, score`` of every row, and ``keep`` columns.

    ``score`` is the log10 probability of the text's words, each behind a blank,
    and its end, summed over all segmentations into pieces. No piece reaches
    beyond a word, so this is the sum of its words' marginals. ``base_score``
    takes whole words, smoothed. A null or empty text is its end alone; rows of
    null or repeated doc_id are scored like any other.

    The most frequent words are broadcast, bounded by rows and bytes; only the
    others are shuffled to their counts, and their sums back.
    """
    spark = docs.sparkSession
    cut = _heavy_cut(model.words, "n", HEAD_ROWS, HEAD_BYTES)
    frequent = F.lit(True) if cut is None else F.col("n") > cut
    head = model.words.where(frequent).select("word", "c", model.base(F.col("c")).alias("base"), "lp").toArrow()
    index = {w.encode(): i for i, w in enumerate(head["word"].to_pylist())}
    columns = [head[name].to_numpy() for name in ("c", "base", "lp")]
    shared = spark.sparkContext.broadcast((index, (columns[0] > 0).astype(np.int64), *columns[1:]))
    end_known = int(model.end_seen > 0)
    kept = [f"_keep{i}" for i in range(len(keep))]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, known, base, lp = shared.value
        known, base, lp = (np.append(column, 0) for column in (known, base, lp))  # the last is for words elsewhere
        part, rows = TaskContext.get().partitionId(), 0
        for batch in batches:
            at = 0
            for _, texts in in_chunks([batch], "text", "text", CHUNK_CHARS):
                listed = [tokens(t) for t in texts]
                sizes = np.array([len(found) for found in listed])
                flat = [w for found in listed for w in found]
                ids = np.fromiter((places.get(w, -1) for w in flat), np.int64, len(flat))
                owner = np.repeat(np.arange(len(texts)), sizes)
                away = np.flatnonzero(ids < 0)
                edges = np.searchsorted(away, np.concatenate(([0], np.cumsum(sizes))))
                rest = pa.array([flat[i] for i in away.tolist()], pa.binary()).cast(pa.string())
                sums = [np.bincount(owner, column[ids], len(texts)) for column in (known, base, lp)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array((part << 40) + rows + np.arange(len(texts))),
                        *[batch.column(k).slice(at, len(texts)) for k in ("doc_id", *kept)],
                        pa.array(sizes + 1),
                        pa.array(sums[0].astype(np.int64)),
                        pa.array(sums[1]),
                        pa.array(sums[2]),
                        pa.ListArray.from_arrays(pa.array(edges, pa.int32()), rest),
                    ],
                    names,
                )
                at += len(texts)
                rows += len(texts)

    rows = docs.select(
        F.col(text).cast("string").alias("text"), F.col(doc_id).alias("doc_id"),
        *[column.alias(name) for column, name in zip(keep, kept, strict=True)],
    )
    types = dict(rows.dtypes)
    head_names = ["doc_id", *kept]
    names = ["row", *head_names, "n_tokens", "known", "base", "lp", "rest"]
    schema = ["row long", *[f"{k} {types[k]}" for k in head_names], "n_tokens long", "known long", "base double", "lp double", "rest array<string>"]
    first = materialise(rows.mapInArrow(run, ", ".join(schema)), "lm-rows")
    shared.destroy()
    out = first.drop("rest")
    if cut is not None:
        counts = model.words.where(~frequent).select("word", "c", "lp")
        found = first.select("row", F.explode("rest").alias("word")).join(counts, "word")
        rest = found.groupBy("row").agg(
            F.count_if(F.col("c") > 0).alias("_known"), F.sum(model.base(F.col("c"))).alias("_base"), F.sum("lp").alias("_lp")
        )
        zero = F.lit(0)
        out = out.join(rest, "row", "left").withColumns(
            {name: F.col(name) + F.coalesce(F.col(f"_{name}"), zero) for name in ("known", "base", "lp")}
        )
    end = model.base(F.lit(model.end_seen))
    return out.select(
        "doc_id",
        *[F.col(name).alias(out_name) for name, out_name in zip(kept, docs.select(*keep).columns if keep else [], strict=True)],
        "n_tokens",
        (F.col("known") + end_known).alias("n_known"),
        F.lit(model.total).cast("long").alias("train_tokens"),
        (F.col("base") + end).alias("base_score"),
        (F.col("lp") + model.end_lp).alias("score"),
    )

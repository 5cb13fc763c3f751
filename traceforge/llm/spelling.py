"""Spelling variant grouping: words one edit apart, found with bidirectional FM-indexes over the vocabulary."""

from __future__ import annotations

import math
import re
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from traceforge.workspace import materialise

# --- fixed values: letters of a word, in lower case but for those beyond ASCII
LETTERS = "a-zÀ-ÿ"
# Words counted before they are sent on, words of one index, cells of one batch of queries, letters of one index.
COUNTED_WORDS, BLOCK_WORDS, CELLS, INDEX_LETTERS = 1 << 18, 1 << 14, 1 << 20, 1 << 22
# Words drawn per index to place the borders, and letters of a border.
DRAWN, BORDER_LETTERS = 64, 64


def corpus_words(
    docs: DataFrame, least_letters: int = 7, least_count: int = 2, misspell: int | None = None,
    text: str = "text", doc_id: str = "doc_id",
) -> DataFrame:
    """``word, n``: runs of letters with their occurrences in all texts, A-Z in lower case.

    With ``misspell`` m, a run loses one letter where m divides the crc32 of
    ``<doc_id>:<run>`` (a null id is empty): the one that this number, modulo
    the run's length, counts from its begin. Counted per task before the shuffle.
    """
    pattern = re.compile(f"[{LETTERS}]{{{least_letters},}}")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counter()

        def flush() -> pa.RecordBatch:
            columns = [pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())]
            counts.clear()
            return pa.RecordBatch.from_arrays(columns, ["word", "n"])

        for batch in batches:
            for key, value in zip(batch.column("id").to_pylist(), batch.column("text"), strict=True):
                found = pattern.findall((value.as_py() or "").encode().lower().decode())
                if misspell is None:
                    counts.update(found)
                    continue
                seed = zlib.crc32(f"{key or ''}:".encode())
                for word, n in Counter(found).items():
                    number = zlib.crc32(word.encode(), seed)
                    if number % misspell == 0:
                        at = number % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < least_letters:
                            continue
                    counts[word] += n
                if len(counts) > COUNTED_WORDS:
                    yield flush()
        yield flush()

    rows = docs.select(F.col(doc_id).cast("string").alias("id"), F.col(text).cast("string").alias("text"))
    counted = rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return materialise(counted.where(F.col("n") >= least_count), "spelling-words")


class Wavelet:
    """Sequence of symbols, as one bit vector with running counts per bit of a symbol."""

    def __init__(self, sequence: np.ndarray, size: int) -> None:
        self.ones, self.zeros = [], []
        self.bits = range(max(1, (size - 1).bit_length()) - 1, -1, -1)
        rest = sequence
        for bit in self.bits:
            on = (rest >> bit & 1).astype(bool)
            ones = np.zeros(len(rest) + 1, np.int32)
            np.cumsum(on, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(int(len(rest) - ones[-1]))
            rest = np.concatenate((rest[~on], rest[on]))
        counts = np.bincount(sequence, minlength=size)
        self.shift = np.zeros(size, np.int64)
        first = self._down(np.zeros(size, np.int64), np.zeros(size, np.int64), np.arange(size))[0]
        self.shift = np.cumsum(counts) - counts - first

    def _down(self, low: np.ndarray, high: np.ndarray, symbol: np.ndarray):
        smaller = np.zeros(len(low), np.int64)
        for bit, ones, zeros in zip(self.bits, self.ones, self.zeros, strict=True):
            on = (symbol >> bit & 1).astype(bool)
            low_ones, high_ones = ones[low], ones[high]
            low_zeros, high_zeros = low - low_ones, high - high_ones
            smaller += np.where(on, high_zeros - low_zeros, 0)
            low = np.where(on, zeros + low_ones, low_zeros)
            high = np.where(on, zeros + high_ones, high_zeros)
        return low, high, smaller

    def step(self, low: np.ndarray, size: np.ndarray, symbol: np.ndarray):
        """Ranks of the suffixes that ``symbol`` precedes: first rank, how many, how many had a smaller symbol."""
        low, high, smaller = self._down(low, low + size, symbol)
        return low + self.shift[symbol], high - low, smaller

    def steps(self, low: np.ndarray, size: np.ndarray):
        """``step`` for every symbol that occurs: whose it is, the symbol, and the same three."""
        high, owner = low + size, np.arange(len(low))
        symbol, smaller = np.zeros(len(low), np.int64), np.zeros(len(low), np.int64)
        for bit, ones, zeros in zip(self.bits, self.ones, self.zeros, strict=True):
            low_ones, high_ones = ones[low], ones[high]
            low_zeros, high_zeros = low - low_ones, high - high_ones
            off, on = np.flatnonzero(high_zeros > low_zeros), np.flatnonzero(high_ones > low_ones)
            passed = (high_zeros - low_zeros)[on]
            owner = np.concatenate((owner[off], owner[on]))
            symbol = np.concatenate((symbol[off], symbol[on] | 1 << bit))
            smaller = np.concatenate((smaller[off], smaller[on] + passed))
            low = np.concatenate((low_zeros[off], zeros + low_ones[on]))
            high = np.concatenate((high_zeros[off], zeros + high_ones[on]))
        return owner, symbol, low + self.shift[symbol], high - low, smaller


def _last_column(words: list[str], symbols: np.ndarray, size: int) -> Wavelet:
    """The symbol before each suffix of ``$w$w...$``, in the order of the suffixes; words are sorted.

    Every delimiter is one symbol of its own while sorting, in order of place,
    but for the last, which comes first. As the words are sorted too, and the
    text is read as a ring, this is the order of plain delimiters.
    """
    joined = "\0".join(["", *words, ""])
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    text = np.where(points > 0, np.searchsorted(symbols, points) + 1, 0)
    between = text == 0
    rank = np.where(between, np.cumsum(between), text + len(words))
    rank[-1] = 0
    width = 1
    while True:
        behind = np.zeros(len(rank), np.int64)
        behind[:-width] = rank[width:] + 1
        key = rank * (len(rank) + len(symbols) + len(words) + 2) + behind
        order = np.argsort(key, kind="stable")
        fresh = np.concatenate(([0], np.cumsum(np.diff(key[order]) != 0)))
        rank = np.empty(len(rank), np.int64)
        rank[order] = fresh
        width *= 2
        if fresh[-1] == len(rank) - 1 or width >= len(rank):
            break
    return Wavelet(text[order - 1], size)


class VocabularyIndex:
    """Bidirectional FM-index of a set of words, each between delimiters.

    A found pattern is a run of ranks in the order of the suffixes and one in
    the order of the reversed suffixes, of one length. A symbol more on the left
    is a step in the first order, and moves the second run by the occurrences
    with a smaller symbol there; on the right it is the other way round. The
    run of a whole word between delimiters starts one beyond the word's number.
    """

    def __init__(self, words: list[str], others: Iterable[str] = ()) -> None:
        self.words = sorted(words)
        points = np.frombuffer("".join([*self.words, *others]).encode("utf-32-le"), np.uint32)
        self.symbols = np.unique(points)
        size = len(self.symbols) + 1
        self.orders = (
            _last_column(self.words, self.symbols, size),
            _last_column(sorted(w[::-1] for w in self.words), self.symbols, size),
        )
        self.length = sum(map(len, self.words)) + len(self.words) + 1

    def _table(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of each part, one row a part, and 0, the delimiter, behind it."""
        lengths = np.array([len(p) for p in parts])
        out = np.zeros((len(parts), int(lengths.max(initial=0)) + 1), np.int64)
        points = np.frombuffer("".join(parts).encode("utf-32-le"), np.uint32)
        out[np.arange(out.shape[1]) < lengths[:, None]] = np.searchsorted(self.symbols, points) + 1
        return out, lengths

    def _extend(self, side: int, state: tuple, symbol: np.ndarray) -> tuple:
        """Each pattern with one symbol more on a side (0 left, 1 right); those that do not occur are gone."""
        query, runs, size = state
        low, count, smaller = self.orders[side].step(runs[side], size, symbol)
        alive = np.flatnonzero(count > 0)
        moved = (low, runs[1] + smaller) if side == 0 else (runs[0] + smaller, low)
        return query[alive], (moved[0][alive], moved[1][alive]), count[alive]

    def one_edit(self, inner: list[str], outer: list[str], side: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a query and the number of a word that differs by one edit in the query's outer half.

        ``inner`` is read from the middle of the query to one end and is matched
        as it is, delimiter included; ``outer`` from the middle to the other
        end, on ``side``, where one symbol is replaced, inserted or lacks. Of
        edits that give one word (a letter of a run), only the last is made, so
        no pair comes twice.
        """
        n = len(inner)
        (exact, exact_size), (wanted, wanted_size) = self._table(inner), self._table(outer)
        start = np.zeros(n, np.int64)
        state = (np.arange(n), (start, start), np.full(n, self.length))
        done = []
        for at in range(exact.shape[1]):
            ended = exact_size[state[0]] < at
            done.append(self._taken(state, ended))
            rest = self._taken(state, ~ended)
            state = self._extend(1 - side, rest, exact[rest[0], at])
        plain = self._joined([*done, state])
        edited = self._taken(plain, np.zeros(len(plain[0]), bool))
        found = []
        for at in range(wanted.shape[1]):
            query, runs, size = plain
            symbol = wanted[query, at]
            inside = at < wanted_size[query]
            following = wanted[query, np.minimum(at + 1, wanted.shape[1] - 1)]
            owner, own, low, count, smaller = self.orders[side].steps(runs[side], size)
            other = runs[1 - side][owner] + smaller
            stepped = (query[owner], (low, other) if side == 0 else (other, low), count)
            differs = (own != symbol[owner]) & (own > 0)
            edited = self._joined([edited, self._taken(stepped, differs)])  # one more before this symbol
            later = [
                self._taken(stepped, differs & inside[owner]),  # another instead of this symbol
                self._taken(plain, inside & (symbol != following)),  # without this symbol
            ]
            ended = wanted_size[edited[0]] == at
            whole = self._extend(side, self._taken(edited, ended), np.zeros(int(ended.sum()), np.int64))
            found.append((whole[0], whole[1][0] - 1))
            rest = self._taken(edited, ~ended)
            edited = self._joined([self._extend(side, rest, wanted[rest[0], at]), *later])
            plain = self._taken(stepped, (own == symbol[owner]) & inside[owner])
        return tuple(np.concatenate(part) for part in zip(*found, strict=True))

    @staticmethod
    def _taken(state: tuple, which: np.ndarray) -> tuple:
        query, runs, size = state
        return query[which], (runs[0][which], runs[1][which]), size[which]

    @staticmethod
    def _joined(states: list[tuple]) -> tuple:
        return (
            np.concatenate([s[0] for s in states]),
            (np.concatenate([s[1][0] for s in states]), np.concatenate([s[1][1] for s in states])),
            np.concatenate([s[2] for s in states]),
        )

    def near(self, queries: list[str], prefix: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Positions of queries and numbers of words at one edit, by the half that is equal.

        With ``prefix`` the first half is, else the second half is and the first
        is not, so the two give every pair once.
        """
        lengths = np.array([len(q) for q in queries])
        order, at = np.argsort(lengths, kind="stable"), 0
        while at < len(order):
            widest = np.maximum.accumulate(lengths[order[at:]]) + 1
            stop = at + max(1, int(np.searchsorted(widest * np.arange(1, len(widest) + 1), CELLS, "right")))
            chosen, at = order[at:stop], stop
            halves = [(q[: len(q) // 2][::-1], q[len(q) // 2 :]) for q in (queries[i] for i in chosen.tolist())]
            first, second = [a for a, _ in halves], [b for _, b in halves]
            query, word = self.one_edit(first, second, 1) if prefix else self.one_edit(second, first, 0)
            if not prefix:
                fresh = [
                    not self.words[w].startswith(first[q][::-1])
                    for q, w in zip(query.tolist(), word.tolist(), strict=True)
                ]
                query, word = query[fresh], word[fresh]
            yield chosen[query], word


def _borders(words: DataFrame, total: int, block_words: int) -> tuple[list[str], list[str]]:
    """Words that cut the vocabulary, and its reversed words, into blocks of about ``block_words``.

    One border per block is broadcast; they are read off a draw by hash of
    about 64 words per block.
    """
    blocks = -(-total // block_words)
    if blocks < 2:
        return [], []
    drawn = words.where(F.pmod(F.xxhash64("word"), F.lit(max(1, block_words // DRAWN))) == 0)
    short = [r["w"] for r in drawn.select(F.substring("word", 1, BORDER_LETTERS).alias("w")).collect()]
    ends = [r["w"] for r in drawn.select(F.substring(F.reverse("word"), 1, BORDER_LETTERS).alias("w")).collect()]
    cut = lambda listed: sorted(set(sorted(listed)[DRAWN // 2 :: DRAWN]))
    return cut(short), cut(ends)


def _routed(words: DataFrame, borders: tuple[list[str], list[str]]) -> DataFrame:
    """Every word to its block on both sides, and as a query to all blocks that its equal half reaches."""
    shared = words.sparkSession.sparkContext.broadcast(borders)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, sides, blocks, own = [], [], [], []
            for i, word in enumerate(batch.column("word").to_pylist()):
                middle = len(word) // 2
                for side, whole, half in ((0, word, word[:middle]), (1, word[::-1], word[middle:][::-1])):
                    cuts = shared.value[side]
                    home = bisect_right(cuts, whole)
                    for block in range(bisect_right(cuts, half), bisect_right(cuts, half + chr(0x10FFFF)) + 1):
                        rows.append(i)
                        sides.append(side)
                        blocks.append(block)
                        own.append(block == home)
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(sides, pa.int32()), pa.array(blocks, pa.int64()), pa.array(own, pa.bool_()),
                    batch.column("word").take(at), batch.column("n").take(at),
                ],
                ["side", "block", "own", "word", "n"],
            )

    return words.mapInArrow(run, "side int, block long, own boolean, word string, n long")


def _search_block(rows: pa.Table) -> pa.Table:
    """``word, n, near, near_n`` of one block: its own words are indexed, all words are queries."""
    queries, counts = rows["word"].to_pylist(), rows["n"].to_numpy()
    own = rows.filter(rows["own"])
    known = dict(zip(own["word"].to_pylist(), own["n"].to_pylist(), strict=True))
    prefix = rows["side"][0].as_py() == 0
    out = []
    for part in _index_parts(sorted(known)):
        index = VocabularyIndex(part, queries)
        many = np.array([known[w] for w in index.words], np.int64)
        for query, word in index.near(queries, prefix):
            out.append(
                pa.table(
                    {
                        "word": pa.array([queries[i] for i in query.tolist()], pa.string()),
                        "n": pa.array(counts[query], pa.int64()),
                        "near": pa.array([index.words[i] for i in word.tolist()], pa.string()),
                        "near_n": pa.array(many[word], pa.int64()),
                    }
                )
            )
    return pa.concat_tables(out) if out else pa.table({n: pa.array([], t) for n, t in PAIR})


PAIR = [("word", pa.string()), ("n", pa.int64()), ("near", pa.string()), ("near_n", pa.int64())]


def _index_parts(words: list[str]) -> Iterator[list[str]]:
    """Parts of bounded letters, for very long words; one longer word alone."""
    part, size = [], 0
    for word in words:
        if part and size + len(word) > INDEX_LETTERS:
            yield part
            part, size = [], 0
        part.append(word)
        size += len(word) + 1
    if part:
        yield part


def near_words(words: DataFrame, block_words: int | None = None) -> DataFrame:
    """``word, n, near, near_n``: every ordered pair of words at exactly one edit, once.

    ``words`` has distinct ``word`` of two letters or more and ``n``. A pair at
    one edit shares its first or its second half of either word, so the words
    are cut into blocks of bounded size by their order, and by the order of
    their reversals; each block is one task's index, and a word asks only the
    blocks that hold words with its half. A common begin of words is spread over
    as many blocks as it fills.
    """
    total = words.count()
    routed = _routed(words, _borders(words, total, block_words or BLOCK_WORDS))
    return routed.groupBy("side", "block").applyInArrow(_search_block, "word string, n long, near string, near_n long")


def group_variants(words: DataFrame, factor: int = 10, block_words: int | None = None) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of each word.

    ``form`` is the most frequent word at one edit (equal ones: the first in
    code-point order) if it occurs ``factor`` times as often or more, else null;
    ``root`` follows the forms to the last, and is the word itself without one.
    An empty table gives none.

    Each form multiplies ``n`` by ``factor``, which bounds the length of a chain
    and so the rounds of doubling that find the roots.
    """
    near = near_words(words, block_words).groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), F.col("near"))).alias("best")
    )
    often = -F.col("best.minus")
    has_form = F.coalesce(often >= factor * F.col("n"), F.lit(False))
    listed = materialise(
        words.join(near, "word", "left").select(
            "word", F.when(has_form, F.col("best.near")).alias("form"), "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has_form, often).alias("form_n"),
        ),
        "spelling-forms",
    )
    least, most = listed.agg(F.min("n"), F.max("n")).first()
    roots = listed.where("form is not null").select("word", F.col("form").alias("root"))
    if most is not None:
        chain = math.floor(math.log(max(most / max(least, 1), 1), factor)) + 1
        for _ in range(max(chain - 1, 0).bit_length()):
            after = roots.select(F.col("word").alias("root"), F.col("root").alias("_next"))
            roots = materialise(
                roots.join(after, "root", "left").select("word", F.coalesce("_next", "root").alias("root")), "spelling-roots"
            )
    return listed.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )

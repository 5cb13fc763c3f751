"""Benchmark leaks: CGK embeddings, bit-sampling LSH over item-sized windows, exact edit distance."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from traceforge.llm.common import RangeHashes, give_back, in_slices, rolled, scrambled, word_bounds, word_hashes

# Every byte but a letter's or digit's is a blank.
SPACED = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
# Shortest item searched for with edits, shorter ones word for word; edits per
# word: two texts with a fifth of their words edited are four fifths alike.
LEAST_WORDS, EDIT_SHARE = 8, 0.2
# Random walks, samples per walk, positions per sample; an embedding's length per word.
WALKS, SAMPLES, POSITIONS, STRETCH = 8, 4, 3, 3
# Bytes of item text searched for in one pass over the documents; characters looked at together.
ITEM_BYTES, CHUNK_CHARS = 8 << 20, 1 << 20
# Bytes of embeddings held at once, and places of shared parts looked at together.
EMBED_BYTES, PAIRS = 16 << 20, 1 << 17
TABLE_BITS = 22


def normal_words(text: str | None) -> list[bytes]:
    """Lower-cased runs of letters and digits."""
    return spaced(text).split()


def spaced(text: str | None) -> bytes:
    return text.lower().encode().translate(SPACED) if text else b""


@lru_cache(maxsize=1 << 16)
def _draw(*numbers: int) -> np.uint64:
    value = np.array([0], np.uint64)
    for number in numbers:
        value = scrambled(value + np.uint64(number + 1))
    return value[0] | np.uint64(1)


def embed(symbols: np.ndarray, words_: np.ndarray) -> np.ndarray:
    """CGK: at each step copy the current symbol, and move on if a coin of (walk, step, symbol) says so.

    Rows are padded with zeros, one at least, and stand by falling ``words_``;
    a row takes ``STRETCH`` steps per word. Indexed by step, walk and row; zero
    past the end, where the coin of a zero stays down.
    """
    steps = STRETCH * words_
    flat, at = symbols.ravel(), np.tile(np.arange(len(symbols)) * symbols.shape[1], (WALKS, 1))
    out = np.zeros((steps[0], WALKS, len(symbols)), np.uint64)
    for step in range(steps[0]):
        open_ = int(np.searchsorted(-steps, -step, "left"))
        symbol = flat.take(at[:, :open_])
        out[step, :, :open_] = symbol
        symbol *= np.array([[_draw(walk, step)] for walk in range(WALKS)])
        at[:, :open_] += (scrambled(symbol) >> np.uint64(63)).view(np.int64)
    return out


@lru_cache(maxsize=1 << 10)
def _sampled(words_: int) -> np.ndarray:
    """Steps sampled for items of a length, by walk, sample and position."""
    steps = STRETCH * words_
    return np.array(
        [
            [
                np.random.default_rng((words_, walk, sample)).choice(steps, min(POSITIONS, steps), replace=False)
                for sample in range(SAMPLES)
            ]
            for walk in range(WALKS)
        ]
    )


def lsh_keys(hashes: np.ndarray, starts: np.ndarray, stops: np.ndarray, words_: np.ndarray) -> np.ndarray:
    """One key per walk and sample of each window of ``hashes``, from fixed positions of its embedding.

    ``words_`` is the length of the items that a window is held against. Windows
    are embedded in parts of about ``EMBED_BYTES``.
    """
    keys = np.empty((len(starts), WALKS * SAMPLES), np.uint64)
    order = np.argsort(-words_, kind="stable")
    walks, begin = np.arange(WALKS)[:, None], 0
    while begin < len(order):
        most = int(words_[order[begin]])
        rows = order[begin : begin + max(1, EMBED_BYTES // (8 * WALKS * STRETCH * most))]
        begin += len(rows)
        place = starts[rows, None] + np.arange(most + 1)
        symbols = np.where(place < stops[rows, None], hashes[np.minimum(place, len(hashes) - 1)], np.uint64(0))
        embedded, sizes = embed(symbols, words_[rows]), words_[rows]
        for n in np.unique(sizes).tolist():
            mine = np.flatnonzero(sizes == n)
            seeds = np.array([[_draw(n, walk, sample) for sample in range(SAMPLES)] for walk in range(WALKS)])
            key = np.repeat(seeds[:, :, None], len(mine), 2)
            for at in np.moveaxis(_sampled(n), 2, 0):
                key = scrambled(key ^ embedded[at[:, :, None], walks[:, :, None], mine])
            keys[rows[mine]] = key.reshape(-1, len(mine)).T
    return keys


def best_match(item: list[bytes], text: list[bytes]) -> tuple[int, int]:
    """Least word edits between ``item`` and any part of ``text``, and the first end of such a part.

    One bit per word of the item, so a word of the text costs a few operations.
    """
    full, top = (1 << len(item)) - 1, 1 << (len(item) - 1)
    places: dict[bytes, int] = {}
    for i, word in enumerate(item):
        places[word] = places.get(word, 0) | 1 << i
    more, less, score = full, 0, len(item)
    best = (score, 0)
    for end, word in enumerate(text, 1):
        equal = places.get(word, 0)
        down = equal | less
        across = (((equal & more) + more) ^ more | equal) & full
        rise, fall = less | full & ~(across | more), more & across
        score += bool(rise & top) - bool(fall & top)
        rise, fall = rise << 1 & full, fall << 1 & full
        more, less = (fall | ~(down | rise)) & full, rise & down
        if score < best[0]:
            best = (score, end)
    return best


class Finder:
    """Items prepared for the search; small enough to be sent to every task."""

    def __init__(self, items: list[tuple[int | None, str]]) -> None:
        parts = [(key, normal_words(text)) for key, text in items]
        self.items = [(key, sequence) for key, sequence in parts if sequence]
        self.edits = [int(len(s) * EDIT_SHARE) if len(s) >= LEAST_WORDS else 0 for _, s in self.items]
        # An item with k edits or fewer keeps one of its k + 1 equal parts unchanged.
        seeds: dict[int, list[tuple[int, int, int]]] = {}
        for i, (_, sequence) in enumerate(self.items):
            cuts = np.linspace(0, len(sequence), self.edits[i] + 2).astype(int)
            hashes = word_hashes(sequence)
            for low, high in zip(cuts[:-1], cuts[1:], strict=True):
                key = int(rolled(hashes[low:high], int(high - low))[0])
                seeds.setdefault(int(high - low), []).append((key, i, int(low)))
        self.seeds = {size: sorted(found) for size, found in seeds.items()}
        self.tables = {}
        for size, found in self.seeds.items():
            table = np.zeros(1 << TABLE_BITS, bool)
            table[np.array([k for k, _, _ in found], np.uint64) >> np.uint64(64 - TABLE_BITS)] = True
            self.tables[size] = (table, np.array([k for k, _, _ in found], np.uint64))
        sizes = np.array([len(s) for _, s in self.items], np.int64)
        self.sizes, self.most_edits = sizes, np.array(self.edits, np.int64)
        stops = np.cumsum(sizes)
        joined = np.concatenate([word_hashes(s) for _, s in self.items]) if self.items else np.zeros(0, np.uint64)
        keys = lsh_keys(joined, stops - sizes, stops, sizes)
        order = np.argsort(keys, axis=None)
        self.keys, self.owners = keys.ravel()[order], order // keys.shape[1]

    def _windows(self, hashes: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
        """Item size, start and stop of windows around a part that an item shares, in this order and each once."""
        found = [np.zeros((3, 0), np.int64)]
        for size, (table, sorted_keys) in self.tables.items():
            keys = rolled(hashes, size)
            at = np.flatnonzero(table[keys >> np.uint64(64 - TABLE_BITS)])
            at = at[at + size <= end[at]]
            low = np.searchsorted(sorted_keys, keys[at], "left")
            hits = np.searchsorted(sorted_keys, keys[at], "right") - low
            at, low, hits = at[hits > 0], low[hits > 0], hits[hits > 0]
            seeds = np.array(self.seeds[size])[:, 1:].astype(np.int64)
            stops = np.cumsum(hits)
            for a in range(0, int(stops[-1]) if len(stops) else 0, PAIRS):
                nth = np.arange(a, min(a + PAIRS, stops[-1]))
                row = np.searchsorted(stops, nth, "right")
                item, offset = seeds[low[row] + nth - (stops - hits)[row]].T
                p, n, k = at[row], self.sizes[item], self.most_edits[item]
                part = []
                for shift in (-k, -(k // 2), 0, k // 2, k):
                    start = np.maximum(begin[p], p - offset + shift)
                    stop = np.minimum(end[p], start + n)
                    part.append(np.array([n, start, stop])[:, stop - start >= n - k])
                found.append(_distinct(np.concatenate(part, 1)))
        return tuple(_distinct(np.concatenate(found, 1)))

    def leaks(self, texts: list[str | None]) -> list[dict[int, tuple[int, int]]]:
        """By text: item position to its least word edits and the number of words before the match's end."""
        found: list[dict[int, tuple[int, int]]] = [{} for _ in texts]
        if not self.items:
            return found
        pieces = [b" ".join(normal_words(text)) for text in texts]
        data = b" ".join(filter(None, pieces))
        begins, ends = word_bounds(data)
        ranges = RangeHashes(data)
        hashes = ranges.of(begins, ends)
        sizes = np.array([piece.count(b" ") + bool(piece) for piece in pieces], np.int64)
        stops = np.cumsum(sizes)
        owner = np.repeat(np.arange(len(texts)), sizes)
        begin, end = np.repeat(stops - sizes, sizes), np.repeat(stops, sizes)
        size, start, stop = self._windows(hashes, begin, end)
        if not len(start):
            return found
        # equal windows are embedded once
        alike = scrambled(ranges.of(begins[start], ends[stop - 1]) ^ size.astype(np.uint64))
        _, sample, which = np.unique(alike, return_index=True, return_inverse=True)
        keys = lsh_keys(hashes, start[sample], stop[sample], size[sample])
        low = np.searchsorted(self.keys, keys, "left")
        hits = np.searchsorted(self.keys, keys, "right") - low
        candidates: dict[int, set[int]] = {}
        for row, column in np.argwhere(hits).tolist():
            a = low[row, column]
            candidates.setdefault(row, set()).update(self.owners[a : a + hits[row, column]].tolist())
        tried = set()
        for at in np.flatnonzero(np.isin(which, list(candidates))).tolist():
            here = int(start[at])
            text, first = int(owner[here]), int(begin[here])
            for i in candidates[int(which[at])]:
                k = self.edits[i]
                # windows of one neighbourhood share a verification, which reaches over all of them
                if (text, i, here // max(1, k)) in tried or found[text].get(i, (k + 1, 0))[0] == 0:
                    continue
                tried.add((text, i, here // max(1, k)))
                left = max(first, here - 2 * k)
                right = min(int(end[here]), here + int(size[at]) + 2 * k)
                distance, to = best_match(self.items[i][1], data[begins[left] : ends[right - 1]].split())
                if distance <= k and distance < found[text].get(i, (k + 1, 0))[0]:
                    found[text][i] = (distance, left + to - first)
        return found


def _distinct(rows: np.ndarray) -> np.ndarray:
    """Columns of a table, ordered by its rows from the first on, each once."""
    rows = rows[:, np.lexsort(rows[::-1])]
    fresh = np.ones(rows.shape[1], bool)
    fresh[1:] = (rows[:, 1:] != rows[:, :-1]).any(0)
    return rows[:, fresh]


def _finders(benchmark: DataFrame) -> Iterator[Finder]:
    """The items in blocks of bounded size; a benchmark beyond one block is searched for block by block."""
    items = benchmark.where("text is not null").select(F.col("item_id").cast("long"), "text").distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = size // ITEM_BYTES + 1
    for block in range(blocks):
        mine = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        yield Finder(sorted(map(tuple, mine.collect()), key=lambda item: (item[0] is None, item[0] or 0, item[1])))


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, item_id, distance, item_words, end_word``: items that a document holds, with few words edited.

    A document holds an item if some part of it is within a fifth of the item's
    words in edits (insertions, deletions, replacements of words; case and signs
    do not count). Item-sized windows are embedded by CGK random walks, which
    turn edits into differing positions; windows that share a sampled key with
    an item in any of 32 samples are verified exactly. Only windows are embedded
    that hold one of the item's k + 1 equal parts unchanged, which every match
    with k edits does. Items under eight words are searched for word for word.
    Null texts and items without a word match nothing; a null doc_id or item_id
    is reported as such. Equal rows of the benchmark count once, different texts
    of one item_id each; repeated documents are reported each.
    """
    spark, parts = docs.sparkSession, []
    for finder in _finders(benchmark):
        shared = spark.sparkContext.broadcast(finder)

        def run(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            give_back()
            finder = shared.value
            for batch in in_slices(batches, "text", CHUNK_CHARS):
                texts = batch.column("text").to_pylist()
                rows = [
                    (key, finder.items[i][0], distance, len(finder.items[i][1]), end)
                    for key, leaks in zip(batch.column("doc_id").to_pylist(), finder.leaks(texts), strict=True)
                    for i, (distance, end) in sorted(leaks.items())
                ]
                columns = zip(*rows, strict=True) if rows else [[]] * 5
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in columns],
                    ["doc_id", "item_id", "distance", "item_words", "end_word"],
                )

        rows = docs.select(F.col("doc_id").cast("long"), "text")
        parts.append(
            rows.mapInArrow(run, "doc_id long, item_id long, distance long, item_words long, end_word long")
        )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def drop_leaking(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no item (see ``find_leaks``)."""
    for finder in _finders(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(finder)

        def run(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            give_back()
            for batch in in_slices(batches, "text", CHUNK_CHARS):
                yield batch.filter(pa.array([not leaks for leaks in shared.value.leaks(batch.column("text").to_pylist())], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs

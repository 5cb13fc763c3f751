"""Exact removal of repeated word windows by super-k-mer partitioning."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from traceforge.llm.common import RangeHashes, in_chunks, scrambled, settle, word_bounds, words
from traceforge.workspace import small_or_none

# Words of a minimiser, characters deduplicated before anything is shuffled,
# characters of text per bucket, and bytes beyond which no task takes a bucket whole.
MINIMISER, CHUNK_CHARS, BUCKET_CHARS, HOT_BYTES = 3, 4 << 20, 3 << 19, 64 << 20
# Windows of a hot bucket that are written out at once.
WINDOW_ROWS = 1 << 13
PACKED = "bucket int, texts binary, docs binary, starts binary, sizes binary"
SPANS = "doc_id long, start int, stop int"


def _sliding_min(values: np.ndarray, size: int) -> np.ndarray:
    width = 1
    while width * 2 <= size:
        values = np.minimum(values[:-width], values[width:])
        width *= 2
    rest = size - width
    return np.minimum(values[:-rest], values[rest:]) if rest else values


class _Words:
    """Words of several pieces of documents, joined by single blanks, with the windows that lie in one piece.

    ``first`` holds for every such window (``valid``, by its first word) the
    first one with the same words; pieces come in the order of (document, start).
    """

    def __init__(self, joined: bytes, sizes: np.ndarray, docs: np.ndarray, starts: np.ndarray, window: int) -> None:
        self.joined, self.window = joined, window
        self.begins, self.ends = word_bounds(joined)
        self.hashes = RangeHashes(joined)
        piece = np.repeat(np.arange(len(sizes)), sizes)
        inside = np.arange(len(piece)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        self.valid = np.flatnonzero(inside + window <= sizes[piece])
        self.doc, self.start = docs[piece], starts[piece] + inside
        self.first = self._first(self.range_hashes(window)[self.valid])
        if not self._same(self.first):
            self.first = self._first_by_text()
        repeats = self.first != self.valid
        same_place = (self.doc[self.first] == self.doc[self.valid]) & (
            self.start[self.first] == self.start[self.valid]
        )
        self.unique, self.removed = self.valid[~repeats], self.valid[repeats & ~same_place]

    def range_hashes(self, size: int) -> np.ndarray:
        """Hash of each run of ``size`` words."""
        return self.hashes.of(self.begins[: len(self.begins) - size + 1], self.ends[size - 1 :])

    def slice(self, a: int, b: int) -> bytes:
        return self.joined[self.begins[a] : self.ends[b - 1]]

    def _first(self, keys: np.ndarray) -> np.ndarray:
        """For each valid window the first one with an equal key."""
        order = np.argsort(keys)
        fresh = np.ones(len(keys), bool)
        fresh[1:] = keys[order[1:]] != keys[order[:-1]]
        heads = np.flatnonzero(fresh)
        least = np.minimum.reduceat(order, heads) if len(heads) else order
        first = np.empty(len(keys), np.int64)
        first[order] = least[np.cumsum(fresh) - 1]
        return self.valid[first]

    def _same(self, first: np.ndarray) -> bool:
        """Whether windows with equal hashes are equal, run by run of neighbouring windows."""
        at = np.flatnonzero(first != self.valid)
        if not len(at):
            return True
        here, there = self.valid[at], first[at]
        cut = np.flatnonzero((np.diff(here) != 1) | (np.diff(there) != 1)) + 1
        lows = np.concatenate(([0], cut))
        highs = np.concatenate((cut, [len(at)])) - 1
        return all(
            self.slice(a, b + self.window) == self.slice(c, d + self.window)
            for a, b, c, d in zip(here[lows], here[highs], there[lows], there[highs], strict=True)
        )

    def _first_by_text(self) -> np.ndarray:
        """As ``_first``, by the texts themselves; for the case that two hashes collide."""
        seen: dict[bytes, int] = {}
        return np.array([seen.setdefault(self.slice(p, p + self.window), p) for p in self.valid.tolist()], np.int64)

    def removed_spans(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Documents, starts and stops of the words that repeated windows cover, neighbours merged."""
        docs, starts = self.doc[self.removed], self.start[self.removed]
        cut = np.flatnonzero((np.diff(docs) != 0) | (np.diff(starts) != 1)) + 1 if len(docs) else []
        lows = np.concatenate(([0], cut)).astype(int)[: len(docs)]
        highs = (np.concatenate((cut, [len(docs)])) - 1).astype(int)[: len(docs)]
        return docs[lows], starts[lows].astype(np.int32), (starts[highs] + self.window).astype(np.int32)


def _squeezed(array: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(array).tobytes(), 1)


def _super_kmers(chunk: _Words, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, word after the last, and bucket of each run of windows with one minimiser."""
    at = chunk.unique
    if not len(at):
        return at, at, at
    grams = chunk.range_hashes(min(MINIMISER, chunk.window))
    least = _sliding_min(grams, chunk.window - min(MINIMISER, chunk.window) + 1)[at]
    cut = np.flatnonzero((np.diff(at) != 1) | (np.diff(least.view(np.int64)) != 0)) + 1
    lows, highs = np.concatenate(([0], cut)), np.concatenate((cut, [len(at)])) - 1
    return at[lows], at[highs] + chunk.window, (scrambled(least[lows]) % np.uint64(buckets)).astype(np.int64)


def _packed_rows(chunk: _Words, buckets: int) -> Iterator[tuple]:
    """A row per bucket with its super-k-mers, and one with what is known to be repeated."""
    docs, starts, stops = chunk.removed_spans()
    if len(docs):
        yield int(docs[0]) % buckets, None, _squeezed(docs), _squeezed(starts), _squeezed(stops - starts)
    a, b, bucket = _super_kmers(chunk, buckets)
    if not len(a):
        return
    order = np.argsort(bucket, kind="stable")
    bounds = np.concatenate(([0], np.flatnonzero(np.diff(bucket[order])) + 1, [len(order)]))
    for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        runs = order[low:high]
        begin, end = chunk.begins[a[runs]].tolist(), chunk.ends[b[runs] - 1].tolist()
        text = b"\n".join([chunk.joined[s:e] for s, e in zip(begin, end, strict=True)])
        yield (
            int(bucket[runs[0]]),
            zstandard.compress(text, 3),
            _squeezed(chunk.doc[a[runs]]),
            _squeezed(chunk.start[a[runs]].astype(np.int32)),
            _squeezed((b - a)[runs].astype(np.int32)),
        )


def _hot_spans(packed: DataFrame, window: int) -> DataFrame:
    """``doc_id, start, stop`` of repeated windows in packed rows, however many share a bucket or a text.

    Windows become rows. The first place of each text is a minimum, combined
    before the shuffle; every other place is found by its own (document, start),
    so no key of either step is frequent.
    """

    def unpack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                texts, ids, starts = [], [], []
                doc = np.frombuffer(zstandard.decompress(row["docs"]), np.int64).tolist()
                at = np.frombuffer(zstandard.decompress(row["starts"]), np.int32).tolist()
                pieces = zstandard.decompress(row["texts"]).split(b"\n")
                for i, (piece, d, s) in enumerate(zip(pieces, doc, at, strict=True), 1):
                    sequence = piece.split(b" ")
                    n = len(sequence) - window + 1
                    texts += [b" ".join(sequence[j : j + window]) for j in range(n)]
                    ids += [d] * n
                    starts += range(s, s + n)
                    if len(texts) >= WINDOW_ROWS or i == len(doc):
                        columns = [pa.array(texts, pa.binary()), pa.array(ids, pa.int64()), pa.array(starts, pa.int32())]
                        yield pa.RecordBatch.from_arrays(columns, ["words", "doc_id", "start"])
                        texts, ids, starts = [], [], []

    windows = packed.select("docs", "starts", "texts").mapInArrow(unpack, "words binary, doc_id long, start int")
    first = windows.groupBy("words").agg(F.min(F.struct("doc_id", "start")).alias("at")).select("at.*")
    later = windows.select("doc_id", "start").join(first, ["doc_id", "start"], "left_anti")
    return later.distinct().withColumn("stop", F.col("start") + window)


def repeated_spans(docs: DataFrame, window: int = 20, hot_bytes: int = HOT_BYTES) -> DataFrame:
    """``doc_id, start, stop``: word ranges covered by windows that also start earlier.

    Chunks of documents drop what repeats within themselves, so that a passage
    occurs once per chunk at most in what is shuffled; the rest travels as
    super-k-mers, one packed string for all consecutive windows with the same
    minimiser, to the bucket of that minimiser. A bucket sorts its windows by
    hash, compares the texts of equal ones and keeps each window's first place.

    Buckets are weighed first. One beyond ``hot_bytes``, whose minimiser is
    frequent or whose passage lies in very many chunks, is never one task's work
    but is counted window by window (see ``_hot_spans``), with the same result.
    """
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), "text")
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = max(docs.sparkSession.sparkContext.defaultParallelism, -(-chars // BUCKET_CHARS))

    def chunks(batches: Iterable[pa.RecordBatch]) -> Iterator[_Words]:
        for ids, texts in in_chunks(batches, "doc_id", "text", CHUNK_CHARS):
            order = np.argsort(np.array(ids, np.int64), kind="stable")
            pieces = [b" ".join(words(texts[i])) for i in order]
            sizes = np.array([piece.count(b" ") + bool(piece) for piece in pieces], np.int64)
            long = np.flatnonzero(sizes >= window)
            if not len(long):
                continue
            joined = b" ".join([pieces[i] for i in long])
            docs_ = np.array(ids, np.int64)[order][long]
            del pieces, texts
            yield _Words(joined, sizes[long], docs_, np.zeros(len(long), np.int64), window)

    def weigh(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches):
            a, b, bucket = _super_kmers(chunk, buckets)
            if len(a):
                mine, which = np.unique(bucket, return_inverse=True)
                size = np.bincount(which, chunk.ends[b - 1] - chunk.begins[a] + 1).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(mine.astype(np.int32)), pa.array(size)], ["bucket", "bytes"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches):
            columns = zip(*_packed_rows(chunk, buckets), strict=True)
            types = [pa.int32()] + [pa.binary()] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types, strict=True)],
                ["bucket", "texts", "docs", "starts", "sizes"],
            )

    def count(table: pa.Table) -> pa.Table:
        known, pieces, parts = [], [], []
        open_ = lambda data, kind: np.frombuffer(zstandard.decompress(data), kind)
        for row in table.to_pylist():
            ids, at, size = open_(row["docs"], np.int64), open_(row["starts"], np.int32), open_(row["sizes"], np.int32)
            if row["texts"] is None:
                known.append((ids, at, at + size))
                continue
            pieces += zstandard.decompress(row["texts"]).split(b"\n")
            parts.append((ids, at.astype(np.int64), size.astype(np.int64)))
        if pieces:
            ids, at, size = (np.concatenate(c) for c in zip(*parts, strict=True))
            order = np.lexsort((at, ids))
            joined = b" ".join([pieces[i] for i in order.tolist()])
            known.append(_Words(joined, size[order], ids[order], at[order], window).removed_spans())
        columns = [np.concatenate(c) for c in zip(*known, strict=True)] if known else [[], [], []]
        return pa.table(
            {
                "doc_id": pa.array(columns[0], pa.int64()),
                "start": pa.array(columns[1], pa.int32()),
                "stop": pa.array(columns[2], pa.int32()),
            }
        )

    weights = rows.mapInArrow(weigh, "bucket int, bytes long").groupBy("bucket").agg(F.sum("bytes").alias("bytes"))
    hot = settle(weights.where(F.col("bytes") > hot_bytes).select("bucket", F.lit(True).alias("hot")))
    packed = rows.mapInArrow(run, PACKED)
    if hot.isEmpty():
        return packed.groupBy("bucket").applyInArrow(count, SPANS)
    few = small_or_none(hot)
    marked = settle(packed.join(hot if few is None else few, "bucket", "left"))
    is_hot = F.col("hot").isNotNull() & F.col("texts").isNotNull()
    cool = marked.where(~is_hot).drop("hot").groupBy("bucket").applyInArrow(count, SPANS)
    return cool.unionByName(_hot_spans(marked.where(is_hot), window))


def remove_repeats(docs: DataFrame, window: int = 20, hot_bytes: int = HOT_BYTES) -> DataFrame:
    """``doc_id, n_words, n_removed, kept`` of every document with an id.

    ``kept`` are the words outside all repeated windows, joined by one blank.
    A null text has no words; a text shorter than a window loses none. A row
    without doc_id cannot be placed in the order and is left out. Rows that
    share a doc_id must repeat each other; they count as one place and are all
    reported.
    """
    spans = (
        repeated_spans(docs, window, hot_bytes)
        .groupBy(F.col("doc_id").alias("_doc"))
        .agg(F.collect_list("start").alias("starts"), F.collect_list("stop").alias("stops"))
    )
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), "text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, kept = [], [], []
            for text, starts, stops in zip(*(batch.column(c) for c in ("text", "starts", "stops")), strict=True):
                sequence = words(text.as_py())
                n_words.append(len(sequence))
                if starts.is_valid:
                    edges = np.zeros(len(sequence) + 1, np.int64)
                    np.add.at(edges, starts.values.to_numpy(), 1)
                    np.add.at(edges, stops.values.to_numpy(), -1)
                    sequence = [*compress(sequence, (np.cumsum(edges[:-1]) == 0).tolist())]
                n_removed.append(n_words[-1] - len(sequence))
                kept.append(b" ".join(sequence).decode())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(n_words, pa.int64()),
                    pa.array(n_removed, pa.int64()),
                    pa.array(kept, pa.string()),
                ],
                ["doc_id", "n_words", "n_removed", "kept"],
            )

    joined = rows.join(spans, F.col("doc_id") == F.col("_doc"), "left").drop("_doc")
    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string")

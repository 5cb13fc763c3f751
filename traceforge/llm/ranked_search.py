"""Ranked lexical search: exact inner products of sparse vectors, pruned by ball trees."""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from traceforge.workspace import materialise

# Items of one pass over the documents (bytes of text), queries searched for together.
ITEM_BYTES, GROUP = 1 << 21, 512
# Documents and entries of one tree, documents of a leaf, entries read at once.
TREE_DOCS, TREE_ENTRIES, LEAF = 1 << 13, 1 << 20, 8
# Terms of like frequency share a band, and a ball has a radius of its own in every band.
BANDS = 64
# Tasks whose results meet before the last ranking.
SLOTS = 512
CHUNK_ENTRIES = 1 << 17
NO_ID = (1 << 63) - 1
# --- fixed values: how term counts and lengths are weighed
SCALE, LENGTH_SHARE, SATURATION = 1_000_000_000, 50, 20

# Letters and digits of ASCII and all bytes beyond stay, A-Z in lower case; the rest is blank.
TERM_BYTES = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256)).lower()


def terms(text: str | None) -> list[bytes]:
    """Runs of ASCII letters, digits and anything beyond ASCII, A-Z in lower case."""
    return text.encode().translate(TERM_BYTES).split() if text else []


def term_weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def entry_values(tf: np.ndarray, n: np.ndarray, documents: int, total: int) -> np.ndarray:
    """What a term that occurs ``tf`` times in a document of ``n`` terms adds per unit of its weight."""
    m = 100 - LENGTH_SHARE + (LENGTH_SHARE * n * documents) // max(total, 1)
    return (SCALE * tf) // (1000 * tf + SATURATION * m)


class Queries:
    """Sets of terms, held by term: which queries ask for it."""

    def __init__(self, sets: list[list[int]], width: int) -> None:
        self.n = len(sets)
        query = np.repeat(np.arange(self.n), [len(s) for s in sets])
        term = np.array([t for s in sets for t in s], np.int64)
        order = np.argsort(term, kind="stable")
        self.query = query[order]
        self.starts = np.concatenate(([0], np.cumsum(np.bincount(term, minlength=width))))

    def __len__(self) -> int:
        return self.n

    def holding(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a place in ``at`` and a query that asks for the term there."""
        size = self.starts[at + 1] - self.starts[at]
        place = np.repeat(np.arange(len(at)), size)
        shift = self.starts[at] - (np.cumsum(size) - size)
        return place, self.query[np.arange(len(place)) + shift[place]]


class Best:
    """The ``k`` highest documents of each query so far; ``least`` is the score that still counts."""

    def __init__(self, n: int, k: int) -> None:
        self.k, self.least = k, np.ones(n, np.int64)
        self.heaps: list[list[tuple[int, int]]] = [[] for _ in range(n)]

    def offer(self, score: np.ndarray, ids: np.ndarray) -> None:
        """Scores by query and document; equal scores go to the smaller id."""
        for q, d in zip(*np.nonzero(score >= self.least[:, None]), strict=True):
            heap, pair = self.heaps[q], (int(score[q, d]), -int(ids[d]))
            if len(heap) < self.k:
                heapq.heappush(heap, pair)
            elif pair > heap[0]:
                heapq.heapreplace(heap, pair)
            if len(heap) == self.k:
                self.least[q] = heap[0][0]


class BallTree:
    """Documents as sparse vectors of exact whole numbers, in nested balls.

    A node has the mean of its documents, rounded to 32 bits, and per band the
    largest distance of a document from that point. For a query of zeros and
    ones, ``bound`` adds to the point's product, band by band, the radius times
    the root of the number of query terms that occur below the node: no document
    there scores higher (Cauchy-Schwarz in each band), since terms that do not
    occur below add nothing. Radii and bounds are rounded up by more than all
    rounding errors.
    """

    def __init__(self, starts: np.ndarray, at: np.ndarray, values: np.ndarray, band: np.ndarray, leaf: int | None = None) -> None:
        self.starts, self.at, self.values, self.band = starts, at, values, band
        self.bands = int(band.max(initial=0)) + 1
        self.nodes: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.children: list[tuple[int, int] | np.ndarray] = []
        self.leaf = leaf or LEAF
        if len(starts) > 1:
            self._build(np.arange(len(starts) - 1))

    def _entries(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of all entries of some documents, and whose they are."""
        size = self.starts[docs + 1] - self.starts[docs]
        owner = np.repeat(np.arange(len(docs)), size)
        return np.arange(len(owner)) + np.repeat(self.starts[docs] - (np.cumsum(size) - size), size), owner

    def _build(self, everything: np.ndarray) -> None:
        width = len(self.band)
        todo = [(everything, None)]
        while todo:
            docs, slot = todo.pop()
            places, owner = self._entries(docs)
            at, values = self.at[places], self.values[places].astype(np.float64)
            if len(at) > width:
                present, local = np.arange(width), at
            else:
                present, local = np.unique(at, return_inverse=True)
            centre = (np.bincount(local, values, len(present)) / len(docs)).astype(np.float32)
            wide = centre.astype(np.float64)
            squares = np.bincount(self.band[present], wide * wide, self.bands)
            cell = owner * self.bands + self.band[at]
            n = len(docs) * self.bands
            gap = values - wide[local]
            apart = np.bincount(cell, gap * gap - wide[local] ** 2, n).reshape(-1, self.bands) + squares
            size = np.bincount(cell, values * values, n).reshape(-1, self.bands) + squares
            radius = np.sqrt(np.maximum(apart, 0).max(axis=0) + 1e-11 * size.max(axis=0))
            me = len(self.nodes)
            used = np.flatnonzero(centre)
            self.nodes.append((present[used], centre[used], radius * (1 + 1e-9)))
            self.children.append(docs)
            if slot is not None:
                parent, side = slot
                self.children[parent][side] = me
            if len(docs) > self.leaf:
                near, far = self._halves(docs, local, values, owner, apart.sum(axis=1), len(present))
                self.children[me] = [-1, -1]
                todo += [(near, (me, 0)), (far, (me, 1))]

    @staticmethod
    def _halves(docs, at, values, owner, apart, width):
        """Two halves by which of two far documents is nearer: the farthest from the centre, and the farthest from that."""

        def products(chosen: int) -> np.ndarray:
            own = owner == chosen
            dense = np.bincount(at[own], values[own], width)
            return np.bincount(owner, values * dense[at], len(docs))

        squares = np.bincount(owner, values * values, len(docs))
        first = int(apart.argmax())
        to_first = products(first)
        second = int((squares - 2 * to_first).argmax())
        to_second = products(second)
        order = np.argsort(to_first - to_second, kind="stable")
        return docs[order[len(docs) // 2 :]], docs[order[: len(docs) // 2]]

    def bounds(self, node: int, queries: Queries) -> np.ndarray:
        """No document below the node scores higher, by query."""
        present, centre, radius = self.nodes[node]
        place, query = queries.holding(present)
        n = len(queries)
        upper = np.bincount(query, centre[place].astype(np.float64), n)
        shared = np.bincount(query * self.bands + self.band[present[place]], minlength=n * self.bands)
        return (upper + np.sqrt(shared).reshape(n, -1) @ radius) * (1 + 1e-9) + 1

    def search(self, queries: Queries, ids: np.ndarray, found: Best) -> int:
        """Offer all documents that may be among the best of a query; how many pairs were scored.

        The ball that promises most, against the least score that still counts
        for a query, is opened first; each query leaves a ball, and all below
        it, as soon as its bound is under that score.
        """
        if not self.nodes:
            return 0
        pairs, nth, queue = 0, 0, []

        def offer(node: int) -> None:
            upper = self.bounds(node, queries)
            promise = float((upper / found.least).max(initial=0))
            if promise >= 1:
                heapq.heappush(queue, (-promise, node, upper))

        offer(0)
        while queue:
            _, node, upper = heapq.heappop(queue)
            active = upper >= found.least
            if not active.any():
                continue
            below = self.children[node]
            if isinstance(below, list):
                for child in below:
                    offer(child)
                continue
            places, owner = self._entries(below)
            entry, query = queries.holding(self.at[places])
            kept = active[query]
            entry, query = entry[kept], query[kept]
            score = np.zeros((len(queries), len(below)), np.int64)
            np.add.at(score.ravel(), query * len(below) + owner[entry], self.values[places[entry]])
            found.offer(score, ids[below])
            pairs += int(active.sum()) * len(below)
        return pairs


def bands(weight: np.ndarray, holding: np.ndarray) -> np.ndarray:
    """Bands of consecutive terms that hold about the same part of all squared weights."""
    mass = np.cumsum(holding * weight.astype(np.float64) ** 2)
    if not len(mass) or mass[-1] == 0:
        return np.zeros(len(mass), np.int64)
    at = np.minimum(BANDS - 1, (mass - mass[0] / 2) / mass[-1] * BANDS).astype(np.int64)
    return np.unique(at, return_inverse=True)[1]


def _items(benchmark: DataFrame, item_id: str, text: str) -> Iterator[list[tuple[int | None, str]]]:
    """Distinct items, in groups of bounded size; an item is never cut."""
    items = benchmark.select(F.col(item_id).alias("item_id"), F.col(text).alias("text")).where("text is not null").distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = -(-total // ITEM_BYTES)
    for group in range(groups):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(groups)) == group).orderBy("item_id", "text")
        yield [(r["item_id"], r["text"]) for r in part.collect()]


def _term_counts(docs: DataFrame, vocabulary: dict[bytes, int], doc_id: str, text: str) -> DataFrame:
    """``doc_id, n, at, tf`` of every document with a term: its length and its terms of the vocabulary."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            ids, sizes, edges, places, counts = [], [], [0], [], []

            def flush() -> pa.RecordBatch:
                lists = [pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(x, pa.int32())) for x in (places, counts)]
                return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), *lists], ["doc_id", "n", "at", "tf"])

            for key, value in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                found = terms(value.as_py())
                if not found:
                    continue
                for term, count in Counter(found).items():
                    place = known.get(term)
                    if place is not None:
                        places.append(place)
                        counts.append(count)
                ids.append(key)
                sizes.append(len(found))
                edges.append(len(places))
                if len(places) > CHUNK_ENTRIES:
                    yield flush()
                    ids, sizes, edges, places, counts = [], [], [0], [], []
            yield flush()

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    out = materialise(rows.mapInArrow(run, "doc_id long, n long, at array<int>, tf array<int>"), "ranked-terms")
    shared.destroy()
    return out


def rank(
    docs: DataFrame, benchmark: DataFrame, k: int = 50,
    doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text",
) -> DataFrame:
    """``item_id, rank, doc_id, score``: each item's ``k`` highest documents with a score above 0.

    Scores are whole numbers (``term_weight`` times ``entry_values``, over the
    item's distinct terms), so ranks are the same on every machine. Equal scores
    go to the smaller doc_id, a null one last. Every row of ``docs`` is a
    document, repeated ids and equal texts too; null texts and texts without a
    term count nowhere. Equal rows of the benchmark are one item; different
    texts of one item_id, or without one, are ranked each by itself.

    The terms of the items, a bounded group of them, are numbered and their
    counts are written once per document. Each task then puts its documents, a
    bounded number at a time, into a ball tree, and searches it for all items;
    an item's k-th score so far prunes the trees that follow. A last step ranks
    at most ``k`` rows an item and task, in two rounds.
    """
    spark, parts, nth = docs.sparkSession, [], 0
    for items in _items(benchmark, item_id, text):
        sets = [set(terms(t)) for _, t in items]
        words = sorted(set().union(*sets))
        counted = _term_counts(docs, {w: i for i, w in enumerate(words)}, doc_id, text)
        documents, total = counted.agg(F.count("*"), F.sum("n")).first()
        holding = np.zeros(len(words), np.int64)
        for row in counted.select(F.explode("at").alias("at")).groupBy("at").count().collect():  # one row a term
            holding[row["at"]] = row["count"]
        # terms by falling frequency, so that bands are runs of them
        order = np.argsort(-holding, kind="stable")
        number = np.empty(len(words), np.int64)
        number[order] = np.arange(len(words))
        weight = np.array([term_weight(documents, int(h)) for h in holding[order]], np.int64)
        index = {w: int(number[i]) for i, w in enumerate(words)}
        asked = [(nth + i, key, sorted(index[w] for w in s)) for i, ((key, _), s) in enumerate(zip(items, sets, strict=True))]
        nth += len(items)
        shared = spark.sparkContext.broadcast((asked, number, weight, bands(weight, holding[order])))
        parts.append(counted.where(F.size("at") > 0).mapInArrow(_searcher(shared, documents, total, k), FOUND))
    if not parts:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    best_first = [F.desc("score"), F.asc_nulls_last("doc_id")]
    for by in (["item", "slot"], ["item"]):
        nth_best = F.row_number().over(Window.partitionBy(*by).orderBy(*best_first))
        found = found.withColumn("rank", nth_best).where(F.col("rank") <= k)
    return found.select("item_id", "rank", "doc_id", "score")


FOUND = "item long, item_id long, slot int, doc_id long, score long"


def _searcher(shared, documents: int, total: int, k: int):
    """Function for ``mapInArrow`` over the written term counts."""

    def trees(batches: Iterable[pa.RecordBatch], number, weight, band) -> Iterator[tuple[BallTree, np.ndarray]]:
        held, docs, entries = [], 0, 0
        for batch in batches:
            edges = batch.column("at").offsets.to_numpy()
            begin = 0
            while begin < batch.num_rows:
                room = max(0, TREE_ENTRIES - entries)
                stop = int(np.searchsorted(edges, edges[begin] + room, "right")) - 1
                stop = min(max(stop, begin), begin + TREE_DOCS - docs, batch.num_rows)
                if stop == begin and not docs:
                    stop = begin + 1  # a document with more entries than a tree has
                held.append(batch.slice(begin, stop - begin))
                docs, entries = docs + stop - begin, entries + int(edges[stop] - edges[begin])
                if stop < batch.num_rows or docs >= TREE_DOCS or entries >= TREE_ENTRIES:
                    yield tree(held, number, weight, band)
                    held, docs, entries = [], 0, 0
                begin = stop
        if docs:
            yield tree(held, number, weight, band)

    def tree(held: list[pa.RecordBatch], number, weight, band) -> tuple[BallTree, np.ndarray]:
        rows = pa.Table.from_batches(held).combine_chunks()
        sizes = rows["at"].combine_chunks().value_lengths().to_numpy()
        at = number[rows["at"].combine_chunks().flatten().to_numpy()]
        tf = rows["tf"].combine_chunks().flatten().to_numpy().astype(np.int64)
        n = np.repeat(rows["n"].to_numpy(), sizes)
        values = entry_values(tf, n, documents, total) * weight[at]
        starts = np.concatenate(([0], np.cumsum(sizes)))
        ids = rows["doc_id"].combine_chunks().fill_null(NO_ID).to_numpy()
        return BallTree(starts, at, values, band), ids

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, number, weight, band = shared.value
        groups = [asked[i : i + GROUP] for i in range(0, len(asked), GROUP)]
        state = [(Queries([s for _, _, s in g], len(number)), Best(len(g), k), g) for g in groups]
        for built, ids in trees(batches, number, weight, band):
            for queries, best, _ in state:
                built.search(queries, ids, best)
        slot = TaskContext.get().partitionId() % SLOTS
        for _, best, group in state:
            rows = [
                (item, key, slot, None if -id_ == NO_ID else -id_, score)
                for heap, (item, key, _) in zip(best.heaps, group, strict=True)
                for score, id_ in heap
            ]
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)],
                ["item", "item_id", "slot", "doc_id", "score"],
            )

    return run

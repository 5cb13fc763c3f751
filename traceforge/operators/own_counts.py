"""Sums over the bigrams of each row, of values that follow from how often each bigram stands in the same rows.

Counting and looking up are one shuffle: every row's bigrams are counted where the
row is, sent by bigram once, and meet their own totals there. Bigrams of the
commonest words, and the commonest first words, are counted ahead and never sent.
Words travel as hashes, under a key by which no two words of the table agree.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from traceforge.workspace import SMALL_ROWS, materialise

# Tokens coded at once, words whose bigrams are counted ahead, bigrams per task of the shuffle.
CHUNK_TOKENS, PAIRED_WORDS, TASK_GRAMS = 1 << 21, 1024, 10_000_000


def _coded(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, pa.Array]]:
    """Slices of each batch, whose last column has the tokens: the row of each token, its code, and the words of the codes."""
    for batch in batches:
        lengths = pc.fill_null(pc.list_value_length(batch.column(batch.num_columns - 1)), 0).to_numpy()
        ends, begin = np.cumsum(lengths, dtype=np.int64), 0
        while begin < len(ends):
            before = ends[begin - 1] if begin else 0
            stop = max(begin + 1, int(np.searchsorted(ends, before + CHUNK_TOKENS, "right")))
            part = batch.slice(begin, stop - begin)
            coded = pc.dictionary_encode(pc.fill_null(part.column(part.num_columns - 1).flatten(), ""))
            yield part, np.repeat(np.arange(stop - begin), lengths[begin:stop]), coded.indices.to_numpy(), coded.dictionary
            begin = stop


def _hashes(words: pa.Array, seed: int) -> np.ndarray:
    return pd.util.hash_array(words.to_numpy(zero_copy_only=False), hash_key=f"{seed:016d}", categorize=False).view(np.int64)


def _weights(part: pa.RecordBatch, names: Sequence[str]) -> list[np.ndarray]:
    return [part.column(name).to_numpy() for name in names]


def _totals(groups: np.ndarray, size: int, rows: np.ndarray, weights: list[np.ndarray]) -> list[np.ndarray]:
    return [np.bincount(groups, w[rows], size).astype(np.int64) for w in weights]


@dataclass(frozen=True)
class WordTotals:
    """``table`` has ``hash, word, n``, n being how often a word is first in a bigram, and by each of ``weights``
    how often it is first (``c0``, ...) and second (``p0``, ...); ``hash`` is of the key ``seed``."""

    table: DataFrame
    seed: int
    weights: tuple[str, ...]

    def types(self) -> int:
        """Words that are second in a bigram of any weight."""
        seconds = [F.col(f"p{i}") for i in range(len(self.weights))]
        return self.table.where(F.greatest(*seconds, F.lit(0)) > 0).count()


def word_totals(df: DataFrame, tokens: str, weights: Sequence[str], seed: int = 0) -> WordTotals:
    """``weights`` are columns of whole numbers, none null. A null token counts as an empty word."""
    weights = tuple(weights)
    names = ["n", *[f"{side}{i}" for side in "cp" for i in range(len(weights))]]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, row, code, words in _coded(batches):
            inner = np.flatnonzero(row[1:] == row[:-1])
            each = _weights(part, weights)
            sums = [t for at in (inner, inner + 1) for t in _totals(code[at], len(words), row[at], each)]
            sums.insert(0, np.bincount(code[inner], minlength=len(words)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(_hashes(words, seed)), words, *map(pa.array, sums)], ["hash", "word", *names]
            )

    schema = ", ".join(["hash long", "word string", *[f"{n} long" for n in names]])
    each = df.select(*weights, tokens).mapInArrow(run, schema)
    table = materialise(each.groupBy("hash", "word").agg(*[F.sum(n).alias(n) for n in names]), "word-totals")
    if table.groupBy("hash").count().where("count > 1").isEmpty():
        return WordTotals(table, seed, weights)
    return word_totals(df, tokens, weights, seed + 1)


def _found(known: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each hash among the ``known``, which are in order, and whether it is there."""
    if not len(known):
        return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
    at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    return at, known[at] == hashes


def _pair_values(
    df: DataFrame, tokens: str, words: WordTotals, paired: np.ndarray, of_bigram: Callable[..., Column]
) -> np.ndarray:
    """``of_bigram`` of every pair of the ``paired`` words, one row of values after the other."""
    weights, seed, size = words.weights, words.seed, len(paired)
    names = [f"t{i}" for i in range(len(weights))]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros(size * size, np.int64) for _ in weights]
        for part, row, code, dictionary in _coded(batches):
            at, there = _found(paired, _hashes(dictionary, seed))
            inner = np.flatnonzero((row[1:] == row[:-1]) & there[code[1:]] & there[code[:-1]])
            cell = at[code[inner]] * size + at[code[inner + 1]]
            for total, more in zip(sums, _totals(cell, size * size, row[inner], _weights(part, weights)), strict=True):
                total += more
        used = np.flatnonzero(np.any(sums, axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(used), *[pa.array(s[used]) for s in sums]], ["cell", *names])

    each = df.select(*weights, tokens).mapInArrow(run, ", ".join(f"{n} long" for n in ["cell", *names]))
    totals = each.groupBy("cell").agg(*[F.sum(n).alias(n) for n in names])
    valued = totals.select("cell", of_bigram(*map(F.col, names)).cast("double").alias("v")).toArrow()
    none = df.sparkSession.range(1).select(of_bigram(*[F.lit(0)] * len(weights)).cast("double")).first()[0]
    values = np.full(size * size, none or 0.0)
    values[valued["cell"].to_numpy()] = pc.fill_null(valued["v"], 0.0).to_numpy()
    return values


def bigram_sums(
    df: DataFrame,
    key: Sequence[str],
    tokens: str,
    words: WordTotals,
    of_bigram: Callable[..., Column],
    of_first: Callable[..., Column],
    name: str,
    head_rows: int = SMALL_ROWS,
    paired_words: int = PAIRED_WORDS,
) -> DataFrame:
    """``key``, ``name`` and ``facts``: the sum over a key's bigrams of ``of_bigram`` of the bigram's totals by each
    weight and ``of_first`` of the totals of its first word, and the number of the bigrams.

    ``words`` are the totals of ``df``. The commonest first words, at most ``head_rows``, and all pairs of the
    commonest ``paired_words`` are valued ahead; so no bigram that is sent has a large share of all. The sum of a
    key without bigrams is 0.
    """
    key, weights, seed = list(key), words.weights, words.seed
    context = df.sparkSession.sparkContext
    firsts = [F.col(f"c{i}") for i in range(len(weights))]
    # 16 bytes a word reach the driver
    head = (
        words.table.where("n > 0").orderBy(F.desc("n"), "hash").limit(head_rows)
        .select("hash", of_first(*firsts).cast("double").alias("v")).toArrow()
    )
    hashes = head["hash"].to_numpy()
    order, paired = np.argsort(hashes), np.sort(hashes[:paired_words])
    size = len(paired)
    known = context.broadcast(
        (hashes[order], pc.fill_null(head["v"], 0.0).to_numpy()[order], paired,
         _pair_values(df, tokens, words, paired, of_bigram))
    )
    keys, numbers = [f"_k{i}" for i in range(len(key))], [f"_w{i}" for i in range(len(weights))]
    names = [*keys, *numbers, "_first", "_second", "_n", "_base", "_facts"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head_words, head_values, pair_words, pair_values = known.value
        begun = 0
        for part, row, code, dictionary in _coded(batches):
            hashed, rows, distinct = _hashes(dictionary, seed), part.num_rows, len(dictionary)
            (at, there), (place, near) = _found(head_words, hashed), _found(pair_words, hashed)
            first_value = np.where(there, head_values[at], 0.0) if len(head_values) else np.zeros(distinct)
            inner = np.flatnonzero(row[1:] == row[:-1])
            of, first, second = row[inner], code[inner].astype(np.int64), code[inner + 1].astype(np.int64)
            common = near[first] & near[second]
            # what is valued ahead becomes one line per row, which counts nothing and may stand under any word
            value = first_value[first]
            value[common] += pair_values[place[first[common]] * size + place[second[common]]]
            spread = pd.util.hash_array(np.arange(begun, begun + rows)).view(np.int64)
            begun += rows
            # other first words go by themselves, without a second one, and other bigrams whole
            rare, rare_n = np.unique((of * distinct + first)[~there[first]], return_counts=True)
            pair, pair_n = np.unique(((of * distinct + first) * distinct + second)[~common], return_counts=True)
            width = max(distinct, 1)
            source = np.concatenate([np.arange(rows), rare // width, pair // width // width])
            alone, zeros = rows + len(rare), np.zeros(len(rare) + len(pair), np.int64)
            columns = [
                *[part.column(i).take(pa.array(source)) for i in range(len(key))],
                *[w[source] for w in _weights(part, numbers)],
                np.concatenate([spread, hashed[rare % width], hashed[pair // width % width]]),
                pa.array(
                    np.concatenate([np.zeros(alone, np.int64), hashed[pair % width]]),
                    mask=np.arange(len(source)) < alone,
                ),
                np.concatenate([np.zeros(rows, np.int64), rare_n, pair_n]),
                np.concatenate([np.bincount(of, value, rows).astype(float), zeros]),
                np.concatenate([np.bincount(of, minlength=rows), zeros]),
            ]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names)

    rows = df.select(
        *[F.col(k).alias(a) for k, a in zip(key, keys, strict=True)],
        *[F.col(w).alias(a) for w, a in zip(weights, numbers, strict=True)],
        tokens,
    )
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema.fields[:-1]])
    for column in names[len(schema) :]:
        schema = schema.add(column, "double" if column == "_base" else "long")
    tasks = max(context.defaultParallelism, (words.table.agg(F.sum("n")).first()[0] or 0) // TASK_GRAMS)
    same = Window.partitionBy("_first", "_second")
    valued = (
        rows.mapInArrow(run, schema)
        .repartition(tasks, "_first", "_second")
        .withColumns({f"_t{i}": F.sum(F.col("_n") * F.col(w)).over(same) for i, w in enumerate(numbers)})
    )
    totals = [F.col(f"_t{i}") for i in range(len(weights))]
    each = F.when(F.col("_second").isNull(), of_first(*totals)).otherwise(of_bigram(*totals))
    sums = valued.groupBy(*keys).agg(
        F.sum(F.col("_base") + F.when(F.col("_n") > 0, F.col("_n") * each).otherwise(0.0)).alias(name),
        F.sum("_facts").alias("facts"),
    )
    return sums.withColumnsRenamed(dict(zip(keys, key, strict=True)))

"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from traceforge.llm.common import in_chunks

# Longest n-gram, buckets of a hash, characters hashed at once, most languages of a model.
LONGEST, BUCKETS, CHUNK_CHARS, MOST_LANGUAGES = 3, 1 << 14, 1 << 20, 512
UNKNOWN = "und"


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of one to three characters of lower-cased texts, and the text of each.

    Runs of anything but letters count as one blank, and a text has a blank at
    either end, so n-grams see word edges and no digits or signs.
    """
    joined = "".join(f" {t} " for t in texts).lower() if texts else ""
    lengths = [len(t.lower()) + 2 for t in texts]
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    owner = np.repeat(np.arange(len(texts)), lengths)
    letter = _is_letter(points)
    points = np.where(letter, points, 32)
    keep = letter | np.concatenate(([True], letter[:-1]))
    points, owner, letter = points[keep], owner[keep], letter[keep]
    out, owners, rolled = [], [], np.zeros(len(points), np.uint32)
    for n in range(LONGEST):
        rolled = rolled[: len(points) - n] * np.uint32(0x01000193) + points[n:] + np.uint32(1)
        mixed = (rolled ^ (rolled >> np.uint32(15))) * np.uint32(0x85EBCA6B)
        inside = owner[: len(rolled)] == owner[n:]
        if n == 0:
            inside &= letter
        out.append((mixed >> np.uint32(32 - 14))[inside].astype(np.int64))
        owners.append(owner[: len(rolled)][inside])
    return np.concatenate(out), np.concatenate(owners)


def _letter_table() -> np.ndarray:
    return np.array([chr(c).isalpha() if c < 0xD800 or c > 0xDFFF else False for c in range(0x30000)])


_LETTERS: list[np.ndarray] = []


def _is_letter(points: np.ndarray) -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(_letter_table())
    known = _LETTERS[0]
    return known[np.minimum(points, len(known) - 1)] & (points < len(known))


def _pieces(texts: list[str]) -> Iterator[tuple[list[int], list[str]]]:
    """Texts in groups of bounded size; a long one in pieces, its words uncut where it has blanks."""
    at, group, size = [], [], 0
    for i, text in enumerate(texts):
        begin = 0
        while begin < len(text) or begin == 0:
            stop = min(len(text), begin + CHUNK_CHARS)
            if stop < len(text):
                stop = max(text.rfind(" ", begin + 1, stop), 0) or stop
            if group and size + stop - begin > CHUNK_CHARS:
                yield at, group
                at, group, size = [], [], 0
            at.append(i)
            group.append(text[begin:stop])
            size += stop - begin
            begin = max(stop, 1)
    if group:
        yield at, group


def fit(examples: DataFrame, smoothing: float = 0.5) -> tuple[list[str], np.ndarray]:
    """Languages in order, and their matrix of log-probabilities by bucket plus a column of log-priors.

    ``examples`` has ``text, lang``; rows with a null in either are not learned
    from. Every task adds up its documents' counts and emits one row per
    language and block of buckets in use; Spark sums them.
    """

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for langs, texts in in_chunks(batches, "lang", "text", CHUNK_CHARS):
            for at, group in _pieces(texts):
                codes, owners = _codes(group)
                names = np.array([langs[i] for i in at], object)
                for lang in set(names):
                    mine = codes[(names == lang)[owners]]
                    row = totals.setdefault(lang, np.zeros(BUCKETS + 1, np.int64))
                    row[:BUCKETS] += np.bincount(mine, minlength=BUCKETS)
            for lang in langs:
                totals[lang][BUCKETS] += 1
        for lang, row in totals.items():
            used = np.flatnonzero(row)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(used), pa.string()), pa.array(used.astype(np.int32)), pa.array(row[used])],
                ["lang", "bucket", "n"],
            )

    rows = examples.select("text", "lang").where("text is not null and lang is not null")
    counted = rows.mapInArrow(count, "lang string, bucket int, n long")
    counted = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    names = examples.select("lang").where("lang is not null").distinct()
    if names.limit(MOST_LANGUAGES + 1).count() > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    # one row per language and bucket in use, so its size is bounded by the model's
    found = counted.toArrow()
    lang = found.column("lang").to_pylist()
    languages = sorted(set(lang))
    index = {name: i for i, name in enumerate(languages)}
    matrix = np.zeros((len(languages), BUCKETS + 1))
    lang = [index[name] for name in lang]
    matrix[lang, found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    if not languages:
        return [], matrix
    grams, documents = matrix[:, :BUCKETS] + smoothing, matrix[:, BUCKETS:]
    log = np.log(grams / grams.sum(axis=1, keepdims=True))
    return languages, np.hstack((log, np.log(documents / documents.sum())))


def predict(docs: DataFrame, languages: list[str], matrix: np.ndarray, kept: list[Column]) -> DataFrame:
    """``kept`` columns, ``lang_pred`` and ``score`` of every text.

    A null text, one without a letter, or any text under a model without
    languages is ``und`` with score 0. ``score`` is the posterior probability.
    """
    shared = docs.sparkSession.sparkContext.broadcast(matrix)
    frame = docs.select(*kept, F.col("text").alias("_text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        log = shared.value
        for batch in batches:
            texts = [t or "" for t in batch.column("_text").to_pylist()]
            scores = np.zeros((len(texts), len(languages)))
            grams = np.zeros(len(texts), np.int64)
            for at, group in _pieces(texts):
                codes, owners = _codes(group)
                rows = np.array(at)[owners]
                grams += np.bincount(rows, minlength=len(texts))
                for j in range(len(languages)):
                    scores[:, j] += np.bincount(rows, weights=log[j][codes], minlength=len(texts))
            names, best = [UNKNOWN] * len(texts), np.zeros(len(texts))
            if languages:
                scores += log[:, BUCKETS]
                scores = np.exp(scores - scores.max(axis=1, keepdims=True))
                scores /= scores.sum(axis=1, keepdims=True)
                pick = scores.argmax(axis=1)
                known = [i for i in np.flatnonzero(grams) if any(map(str.isalpha, texts[i]))]
                best[known] = scores[known, pick[known]]
                for i in known:
                    names[i] = languages[pick[i]]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(names, pa.string()), pa.array(best)],
                [*batch.schema.names[:-1], "lang_pred", "score"],
            )

    schema = frame.drop("_text").schema.add("lang_pred", "string").add("score", "double")
    return frame.mapInArrow(run, schema)


def held_out(key: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the key's text falls into ``fold``; false for a null key."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % folds == fold, F.lit(False))

"""Quality classifier learned from trusted positives and unlabelled text (non-negative PU risk)."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from traceforge.llm.common import RangeHashes, settle, word_bounds

# Most rows of a class that are learned from, bins of a feature, gradient steps.
SAMPLE, BINS, STEPS = 10_000, 16, 1500
FEATURES = 18
BLANKS = bytes.maketrans(b"\t\n\x0b\x0c\r", b" " * 5)


def features(text: str | None) -> np.ndarray:
    """Shape of a text: what its characters, words and lines are like and how often they repeat."""
    data = (text or "").encode()
    spaced = data.translate(BLANKS)
    begins, ends = word_bounds(spaced)
    n = len(begins)
    if not n:
        return np.zeros(FEATURES)
    seen = np.bincount(np.frombuffer(data, np.uint8), minlength=256).astype(float)
    # ASCII capitals, and second bytes of capitals among the accented Latin letters
    capitals = seen[65:91].sum() + seen[0x80:0x9F].sum()
    letters = capitals + seen[97:123].sum() + seen[0xA0:0xC0].sum()
    signs = seen[33:48].sum() + seen[58:65].sum() + seen[91:97].sum() + seen[123:127].sum()
    stops = seen[[33, 44, 46, 63]].sum()
    lines = [line for line in data.split(b"\n") if line.strip()]
    hashes, size = RangeHashes(spaced).of(begins, ends), ends - begins
    distinct = len(np.unique(hashes))
    grams = hashes[:-4] * np.uint64(3) + hashes[2:-2] * np.uint64(5) + hashes[4:] * np.uint64(7)
    breaks = np.flatnonzero(np.frombuffer(data, np.uint8) == 10)
    wide = np.bincount(np.searchsorted(breaks, begins))
    return np.array(
        [
            np.log1p(n),
            size.mean(),
            size.std(),
            capitals / max(1, letters),
            letters / len(data),
            signs / n,
            (signs - stops) / n,
            seen[33] / n,
            seen[124] / n,
            seen[46] / n,
            seen[44] / n,
            seen[48:58].sum() / n,
            distinct / n,
            distinct / np.sqrt(n),
            (hashes[1:] == hashes[:-1]).sum() / n,
            1 - len(np.unique(grams)) / max(1, len(grams)),
            1 - len(set(lines)) / max(1, len(lines)),
            np.log1p(np.median(wide[wide > 0])),
        ]
    )


@dataclass
class Model:
    """Bin edges by feature and one weight per bin; the last weight is the intercept."""

    edges: np.ndarray
    weights: np.ndarray

    def scores(self, rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(_binned(rows, self.edges) @ self.weights, -30, 30)))


def _binned(rows: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """One column per bin, and a last one of ones."""
    out = np.zeros((len(rows), edges.shape[0] * BINS + 1), np.float32)
    at = np.arange(len(rows))
    for j, cuts in enumerate(edges):
        out[at, j * BINS + np.searchsorted(cuts, rows[:, j], side="right")] = 1
    out[:, -1] = 1
    return out


def fit_risk(positive: np.ndarray, unlabelled: np.ndarray, prior: float, decay: float = 1e-4) -> Model:
    """Minimise ``prior * R_p(+) + max(0, R_u(-) - prior * R_p(-))`` with logistic loss.

    When the part in the maximum falls below zero, the step follows its negative,
    which undoes the fit to single unlabelled rows.
    """
    both = np.vstack((positive, unlabelled))
    edges = np.quantile(both, np.linspace(0, 1, BINS + 1)[1:-1], axis=0).T
    p, u = _binned(positive, edges), _binned(unlabelled, edges)
    weights = np.zeros(p.shape[1], np.float32)
    first, second = np.zeros_like(weights), np.zeros_like(weights)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for step in range(1, STEPS + 1):
        sp, su = sigmoid(p @ weights), sigmoid(u @ weights)
        negative = -np.log1p(-np.minimum(su, 1 - 1e-7)).mean() + prior * np.log1p(-np.minimum(sp, 1 - 1e-7)).mean()
        slope = u.T @ su / len(u) - prior * (p.T @ sp) / len(p)
        gain = prior * (p.T @ (sp - 1)) / len(p)
        gradient = (gain + slope if negative >= 0 else -slope) + decay * weights
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        weights -= 0.05 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return Model(edges, weights)


def calibrated(model: Model, ones: np.ndarray, zeros: np.ndarray, ridge: float = 1.0, rounds: int = 100) -> Model:
    """Rescale and shift the model's logits by Newton steps so that 0.5 parts the labels best.

    The order of the scores stays as the risk has made it (the slope is held
    positive). ``ridge`` keeps the slope finite when the classes part without error.
    """
    if not len(ones) or not len(zeros):
        return model
    z = _binned(np.vstack((ones, zeros)), model.edges) @ model.weights.astype(float)
    y = np.concatenate((np.ones(len(ones)), np.zeros(len(zeros))))
    x, fitted = np.column_stack((z, np.ones(len(z)))), np.array([1.0, 0.0])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ fitted, -30, 30)))
        slope = x.T @ (p - y) + ridge * (fitted - [1.0, 0.0])
        curve = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(2)
        fitted = fitted - np.clip(np.linalg.solve(curve, slope), -1, 1)
    fitted[0] = max(fitted[0], 1e-3)
    weights = model.weights.astype(float) * fitted[0]
    weights[-1] += fitted[1]
    return Model(model.edges, weights)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    """Learn from ``docs`` (doc_id, text) and ``labels`` (doc_id, quality), both limited to learning rows.

    Rows of quality 1 are the trusted positives, rows without a label the
    unlabelled text; the class prior is the share of ones among the labelled
    rows of ``docs``, so labels of other documents count nowhere. The labels of
    both kinds then place the logits around 0.5. At most ``sample`` rows of each
    kind are used, those of the least hashes of doc_id and text; only their
    features reach the driver. Where every row has a label, the labelled rows
    are the unlabelled text, with their own share of ones. No rows give None;
    rows without a one, or ones alone, cannot be learned from and raise. A
    doc_id with several labels counts with the highest.
    """
    marks = labels.where("doc_id is not null and quality is not null")
    marks = marks.groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max("quality").alias("quality"))
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("hash"), "text")
    kind = F.when(F.col("_id").isNull(), -1).otherwise((F.col("quality") == 1).cast("int")).alias("kind")
    texts = rows.select("doc_id", "hash").distinct().join(marks, F.col("doc_id") == F.col("_id"), "left")
    texts = settle(texts.select("doc_id", "hash", kind))
    counts = {r["kind"]: r["count"] for r in texts.groupBy("kind").count().collect()}
    if not counts:
        return None
    if not counts.get(1) or len(counts) == 1:
        raise ValueError(f"quality cannot be learned: {counts.get(1, 0)} rows of quality 1, {counts.get(0, 0)} of 0, {counts.get(-1, 0)} without")
    # a tenth more than the sample by hash, of which the least stay: at most three samples of keys
    # go to every task; the texts stay where they are
    place = F.xxhash64("doc_id", "hash", F.lit(0))
    part = F.pmod(place, F.lit(1 << 20)) / float(1 << 20)
    least = [
        texts.where((F.col("kind") == k) & (part < 1.1 * sample / n)).orderBy(part, place, "doc_id", "hash").limit(sample)
        for k, n in counts.items()
    ]
    drawn = rows.join(F.broadcast(reduce(DataFrame.unionByName, least)), ["doc_id", "hash"])
    drawn = drawn.groupBy("doc_id", "hash", "kind").agg(F.any_value("text").alias("text")).select("kind", "text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [features(t.as_py()).tolist() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("kind"), pa.array(values, pa.list_(pa.float64()))], ["kind", "features"]
            )

    found = drawn.mapInArrow(run, "kind int, features array<double>").toArrow()
    values = np.array(found.column("features").to_pylist(), float).reshape(-1, FEATURES)
    kind = found.column("kind").to_numpy()
    order = np.lexsort((*values.T, kind))  # the same model whatever order the rows arrive in
    values, kind = values[order], kind[order]
    one, zero, plain = (values[kind == k] for k in (1, 0, -1))
    prior = counts[1] / (counts[1] + counts.get(0, 0))
    if not len(plain):
        plain = np.vstack((one, zero))
        prior = len(one) / len(plain)
    return calibrated(fit_risk(one, plain, prior), one, zero)


def score(docs: DataFrame, model: Model | None, kept: list[Column]) -> DataFrame:
    """``kept`` columns, ``score`` and ``predicted`` of every text; score 0.5 without a model."""
    frame = docs.select(*kept, F.col("text").alias("_text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.array([features(t.as_py()) for t in batch.column("_text")]).reshape(-1, FEATURES)
            value = model.scores(rows).astype(float) if model else np.full(len(rows), 0.5)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(value), pa.array((value >= 0.5).astype(np.int32))],
                [*batch.schema.names[:-1], "score", "predicted"],
            )

    schema = frame.drop("_text").schema.add("score", "double").add("predicted", "integer")
    return frame.mapInArrow(run, schema)


def keep_good(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of ``docs``, all columns, that the model does not reject (score 0.5 or more)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.array([features(t.as_py()) for t in batch.column("text")]).reshape(-1, FEATURES)
            yield batch.filter(pa.array(model.scores(rows) >= 0.5))

    return docs if model is None else docs.mapInArrow(run, docs.schema)

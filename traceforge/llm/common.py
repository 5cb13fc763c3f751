"""Words, batches and lineage cuts that the operators of this folder share."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from traceforge.workspace import release as release, scratch_root

# A hash of bytes sums a random number per byte value times a power of an odd number.
BASE = 0x9E3779B97F4A7C15
BYTES = np.random.default_rng(1).integers(1, 1 << 63, 256).astype(np.uint64)
_POWERS = {BASE: np.ones(1, np.uint64), pow(BASE, -1, 1 << 64): np.ones(1, np.uint64)}
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[bytes]:
    """Runs of `[^\\x20\\x09-\\x0D]`; bytes split on exactly those six characters."""
    return text.encode().split() if text else []


def scrambled(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(31))) * MULTIPLIER
    return values ^ (values >> np.uint64(29))


def rolled(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` values, by doubling; as many as there are whole runs."""
    out, width, total, at = None, 1, scrambled(hashes), 0
    while True:
        if size & width:
            part = total[at:]
            if out is None:
                out = part
            else:
                n = min(len(out), len(part))
                out = scrambled(out[:n] * MULTIPLIER + part[:n])
            at += width
        if width * 2 > size:
            return out[: max(0, len(hashes) - size + 1)]
        total = scrambled(total[:-width] * MULTIPLIER + total[width:]) if len(total) > width else total[:0]
        width *= 2


def _powers(base: int, n: int) -> np.ndarray:
    """Powers of an odd number modulo 2^64, kept from call to call."""
    if len(_POWERS[base]) < n:
        factors = np.full(n, base, np.uint64)
        factors[0] = 1
        _POWERS[base] = np.multiply.accumulate(factors)
    return _POWERS[base][:n]


class RangeHashes:
    """Hashes of parts of ``data``; equal bytes have equal hashes in any data."""

    def __init__(self, data: bytes) -> None:
        self.sums = np.zeros(len(data) + 1, np.uint64)
        values = self.sums[1:]  # filled, weighted and summed in place
        np.take(BYTES, np.frombuffer(data, np.uint8), out=values, mode="clip")
        values *= _powers(BASE, len(data))
        np.cumsum(values, out=values)

    def of(self, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
        back = _powers(pow(BASE, -1, 1 << 64), len(self.sums))
        return scrambled((self.sums[ends] - self.sums[begins]) * back[begins])


def word_bounds(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the runs of anything but blanks (byte 32)."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = np.frombuffer(data, np.uint8) != 32
    edges = np.diff(inside)
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def word_hashes(sequence: list[bytes]) -> np.ndarray:
    """One hash per word, as ``RangeHashes`` gives it."""
    joined = b" ".join(sequence)
    return RangeHashes(joined).of(*word_bounds(joined))


def in_chunks(
    batches: Iterable[pa.RecordBatch], key: str, text: str, max_chars: int
) -> Iterator[tuple[list, list]]:
    """Keys and texts of consecutive rows, about ``max_chars`` together; one longer text alone."""
    keys, texts, size = [], [], 0
    for batch in batches:
        for k, t in zip(batch.column(key).to_pylist(), batch.column(text).to_pylist(), strict=True):
            length = len(t or "")
            if keys and size + length > max_chars:
                yield keys, texts
                keys, texts, size = [], [], 0
            keys.append(k)
            texts.append(t)
            size += length
    if keys:
        yield keys, texts


def in_slices(batches: Iterable[pa.RecordBatch], text: str, max_bytes: int) -> Iterator[pa.RecordBatch]:
    """Parts of each batch with about ``max_bytes`` of text, at least one row each."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy().astype(np.int64))
        begin = 0
        while begin < len(ends):
            before = ends[begin - 1] if begin else 0
            stop = max(begin + 1, int(np.searchsorted(ends, before + max_bytes, "right")))
            yield batch.slice(begin, stop - begin)
            begin = stop


def give_back() -> None:
    """Return what earlier tasks of this Python worker have freed to the system, which the worker would keep else."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library
    if trim:
        trim(0)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1024) -> Iterator[None]:
    """Arrow batches of whole texts in fewer rows, for what is executed inside."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def in_sizes(texts: list[str], max_chars: int) -> Iterator[list[str]]:
    """Consecutive texts of about ``max_chars`` characters together; one longer text alone."""
    begin, size = 0, 0
    for i, text in enumerate(texts):
        if i > begin and size + len(text) > max_chars:
            yield texts[begin:i]
            begin, size = i, 0
        size += len(text)
    yield texts[begin:]


def settle(df: DataFrame) -> DataFrame:
    """Cut the lineage with a checkpoint in the shared folder, which survives lost executors."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(scratch_root(df.sparkSession))
    return df.checkpoint()

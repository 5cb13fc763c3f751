"""Token sequences of fixed length: concatenate all documents, cut at multiples of the length."""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer

from traceforge.llm.common import give_back, in_slices, small_batches
from traceforge.workspace import materialise

# Pieces between blanks that a worker remembers, the longest of them, pieces
# encoded in one call, and characters cut into pieces at once.
CACHE_PIECES, CACHE_LENGTH, GROUP, CHUNK_CHARS = 1 << 18, 64, 256, 1 << 20
# How a byte-level vocabulary writes a blank.
BLANK = "\u0120"


class BlankCutEncoder:
    """Ids of a byte-level BPE, with the ids of pieces between blanks remembered.

    Such a tokenizer splits a text before every single blank between two
    non-blank characters, and merges nothing across that place, so the text may
    be cut there. Pieces with blank characters at an edge are not cut off.
    """

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        size = max(vocabulary.values()) + 1
        self.kind = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.opens = np.zeros(size, bool)
        self.opens[[i for token, i in vocabulary.items() if token.startswith(BLANK)]] = True
        self.known: dict[str, bytes] = {}

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        encoded = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, self.kind) for e in encoded]

    def _learn(self, pieces: list[str]) -> dict[str, bytes]:
        """Ids of pieces, each after a blank; many in one call, parted where an id opens with a blank."""
        groups = [pieces[i : i + GROUP] for i in range(0, len(pieces), GROUP)]
        out: dict[str, bytes] = {}
        width = self.kind.itemsize
        for group, ids in zip(groups, self._encode(["".join(" " + p for p in g) for g in groups]), strict=True):
            cuts = np.flatnonzero(self.opens[ids])
            if len(cuts) != len(group):
                out.update(zip(group, (i.tobytes() for i in self._encode([" " + p for p in group])), strict=True))
                continue
            data, at = ids.tobytes(), [*(cuts * width).tolist(), len(ids) * width]
            out.update((p, data[a:b]) for p, a, b in zip(group, at[:-1], at[1:], strict=True))
        return out

    def __call__(self, texts: list[str]) -> list[bytes]:
        cut = [text.split(" ") for text in texts]
        heads = self._encode([pieces.pop(0) for pieces in cut])
        distinct = set().union(*cut)
        if len(self.known) > CACHE_PIECES:  # what occurs again is kept
            self.known = {p: self.known[p] for p in distinct & self.known.keys()}
        unknown = distinct.difference(self.known)
        self.known.update(self._learn([p for p in unknown if p and not p[0].isspace() and not p[-1].isspace()]))
        ids_of, out = self.known.__getitem__, []
        for text, pieces, head in zip(texts, cut, heads, strict=True):
            try:
                ids = head.tobytes() + b"".join(map(ids_of, pieces))
            except KeyError:  # blanks in a row or at an edge
                ids = self._slowly(text)
            else:
                if pieces and (text[0] == " " or text[: text.index(" ")][-1].isspace()):
                    ids = self._slowly(text)
            out.append(ids)
        for piece in unknown:
            if len(piece) > CACHE_LENGTH:
                self.known.pop(piece, None)
        return out

    def _slowly(self, text: str) -> bytes:
        """Join pieces again where a blank is not alone, then encode piece by piece."""
        parts: list[list[str]] = []
        for piece in text.split(" "):
            last = parts[-1][-1] if parts else ""
            if last and piece and not last[-1].isspace() and not piece[0].isspace():
                parts.append([piece])
            elif parts:
                parts[-1].append(piece)
            else:
                parts.append([piece])
        joined = [" " * (i > 0) + " ".join(p) for i, p in enumerate(parts)]
        return b"".join(ids.tobytes() for ids in self._encode(joined))


@lru_cache(maxsize=2)
def encoder(path: str) -> BlankCutEncoder:
    # a task has one core; threads of its own would only take those of others
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return BlankCutEncoder(path)


def token_table(docs: DataFrame, tokenizer_path: str, end_id: int | None = 1) -> DataFrame:
    """``doc_id, ids, n_tokens, part, before`` as a written table.

    ``ids`` holds little-endian integers (see ``BlankCutEncoder.kind``); ``part``
    numbers the task that wrote a row, ``before`` counts the ids ahead of it in
    that task. Both are read back, never computed twice.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, before = encoder(tokenizer_path), TaskContext.get().partitionId(), 0
        end = b"" if end_id is None else np.array([end_id], encode.kind).tobytes()
        give_back()
        for batch in in_slices(batches, "text", CHUNK_CHARS):
            ids = [i + end for i in encode([t or "" for t in batch.column("text").to_pylist()])]
            sizes = np.array([len(i) // encode.kind.itemsize for i in ids], np.int64)
            starts = before + np.cumsum(sizes) - sizes
            before += int(sizes.sum())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").cast(pa.int64()),
                    pa.array(ids, pa.binary()),
                    pa.array(sizes),
                    pa.array(np.full(len(ids), part, np.int64)),
                    pa.array(starts),
                ],
                ["doc_id", "ids", "n_tokens", "part", "before"],
            )

    rows = docs.select(F.col("doc_id").cast("long"), "text")
    done = rows.mapInArrow(run, "doc_id long, ids binary, n_tokens long, part long, before long")
    with small_batches(docs.sparkSession):
        return materialise(done, "tokens")


def pack(
    docs: DataFrame, tokenizer_path: str, length: int = 2048, end_id: int | None = 1, with_ids: bool = True
) -> DataFrame:
    """Pieces of all documents, laid end to end and cut into sequences of ``length`` ids.

    Columns: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset,
    boundary and, ``with_ids``, ids. Only the last sequence may be short. ``boundary`` marks the
    pieces of sequences that two or more tasks share; all others lie in one task.
    A null text is empty and holds only the end id; without an end id a document
    without ids has no piece. Rows with a null or repeated doc_id are packed like
    any other.

    First pass: ids are written once, with running counts per task. Second pass:
    the totals of the tasks (one number each) give every task's offset, and the
    windows follow without any shuffle.
    """
    tokens = token_table(docs, tokenizer_path, end_id)
    totals = tokens.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()
    offsets, at = {}, 0
    for row in totals:
        offsets[row["part"]] = (at, at + row["n"])
        at += row["n"]
    shared = tokens.sparkSession.sparkContext.broadcast(offsets)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        kind = encoder(tokenizer_path).kind
        for batch in in_slices(batches, "ids", CHUNK_CHARS):
            size = batch.column("n_tokens").to_numpy()
            bounds = [shared.value[p] for p in batch.column("part").to_pylist()]
            lows, highs = np.array(bounds, np.int64).reshape(-1, 2).T
            first = lows + batch.column("before").to_numpy()
            cuts = np.where(size > 0, (first + size - 1) // length - first // length + 1, 0)
            row = np.repeat(np.arange(len(size)), cuts)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
            sequence = first[row] // length + nth
            begin = np.maximum(first[row], sequence * length)
            stop = np.minimum((first + size)[row], (sequence + 1) * length)
            start, count = begin - first[row], stop - begin
            ids = [np.frombuffer(b.as_buffer(), kind).astype("<u4") for b in batch.column("ids")]
            pieces = [ids[r][s : s + n] for r, s, n in zip(row.tolist(), start.tolist(), count.tolist(), strict=True)]
            boundary = (sequence * length < lows[row]) | ((sequence + 1) * length > highs[row])
            lists = []
            if with_ids:
                flat = np.concatenate(pieces) if pieces else np.zeros(0, "<u4")
                edges = pa.array(np.concatenate(([0], np.cumsum(count))), pa.int32())
                lists = [pa.ListArray.from_arrays(edges, pa.array(flat.astype(np.int32)))]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(row)),
                    pa.array(start),
                    pa.array(count),
                    pa.array([zlib.crc32(p.tobytes()) for p in pieces], pa.int64()),
                    pa.array(size[row]),
                    pa.array(sequence),
                    pa.array(begin - sequence * length),
                    pa.array(boundary),
                    *lists,
                ],
                names + ["boundary"] + ["ids"] * with_ids,
            )

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    schema = [f"{name} long" for name in names] + ["boundary boolean"] + ["ids array<int>"] * with_ids
    return tokens.mapInArrow(run, ", ".join(schema))


def sequences(pieces: DataFrame) -> DataFrame:
    """``sequence_id, ids``: the pieces of each sequence joined in order, at most its length of them."""
    ordered = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return pieces.groupBy("sequence_id").agg(
        F.flatten(F.transform(ordered, lambda piece: piece["ids"])).alias("ids")
    )

"""Personal data: candidate spans, boosted trees over format and context, calibrated thresholds."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, functions as F

from traceforge.llm.common import settle

# The order decides between spans with equal start.
KINDS = ("email", "ip", "card", "phone")
# Trees, their depth, most rows of counts that the driver holds; slopes are summed as multiples of 1 / UNIT.
TREES, DEPTH, LOCAL_ROWS, UNIT = 40, 3, 50_000, 1 << 30
# Least share of true spans among those above a threshold, characters of context, steps of a chance.
PRECISION, CONTEXT, STEPS = 0.95, 40, 10_000

ANY = re.compile(r"[0-9@]|\bat\b|\(at\)|\[at\]", re.I)
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# Further spellings that are proposed, never taken without the model.
WIDER = {
    "email": re.compile(
        r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\s?(?:[(\[{]\s?at\s?[)\]}]|@)\s?[A-Za-z0-9-]{1,63}"
        r"(?:\s?(?:[(\[{]\s?dot\s?[)\]}]|\.)\s?[A-Za-z0-9-]{1,63}){1,4}",
        re.I,
    ),
    "ip": re.compile(r"(?<![0-9.])[0-9]{1,3}(?:(?:\[\.\]|\(\.\)|\s\.\s)[0-9]{1,3}){3}(?![0-9.])"),
    "card": re.compile(r"(?<![0-9])[0-9]{4}(?:[./_:]|\s{2}|\s-\s)[0-9]{4}(?:(?:[./_:]|\s{2}|\s-\s)[0-9]{4}){2}(?![0-9])"),
    "phone": re.compile(r"(?<![\w+.-])(?:00[1-9][0-9]{0,2}[ .-])?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![\w-])"),
}
CUES = {
    "email": re.compile(r"mail|contact|write|address|correo|kontakt|courriel", re.I),
    "ip": re.compile(r"\bip\b|host|server|addr|login|network|client", re.I),
    "card": re.compile(r"card|visa|master|amex|credit|pay|karte|tarjeta|carte", re.I),
    "phone": re.compile(r"phone|tel|call|fax|mobile|cell|telefon|m[oó]vil", re.I),
}


def luhn(digits: str) -> bool:
    total = 0
    for i, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + i % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def small_parts(text: str) -> bool:
    parts = [p.lstrip("0") for p in re.split("[^0-9]+", text) if p]
    return len(parts) == 4 and all(len(p) <= 3 and int(p or 0) <= 255 for p in parts)


def holds(kind: str, text: str) -> bool:
    if kind == "ip":
        return small_parts(text)
    digits = digits_of(text) if kind != "email" else ""
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def _emails(text: str) -> Iterator[tuple[int, int]]:
    last = 0
    for match in DOMAIN.finditer(text):
        start = match.start()
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        if start < match.start():
            last = match.end()
            yield start, last


def proposals(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base spans, base matches that fail their check, and wider spellings apart from the base spans."""
    base: list[tuple[int, int, str]] = []
    failed: list[tuple[int, int, str]] = []
    if not ANY.search(text):
        return base, failed, []
    base += [(s, e, "email") for s, e in _emails(text)] if "@" in text else []
    for kind, pattern in (("ip", IP), ("card", CARD), ("phone", PHONE)):
        for match in pattern.finditer(text):
            (base if holds(kind, match[0]) else failed).append((match.start(), match.end(), kind))
    base.sort(key=lambda s: (s[0], KINDS.index(s[2])))
    found = [(m.start(), m.end(), kind) for kind in KINDS for m in WIDER[kind].finditer(text)]
    covered = _Cover(base)
    wider = [s for s in sorted(found, key=lambda s: (s[0], KINDS.index(s[2]))) if not covered.meets(s)]
    return base, [s for s in failed if not covered.meets(s) and s[1] - s[0] > 6], wider


class _Cover:
    """Whether a span meets any of given spans, by their merged extents."""

    def __init__(self, spans: list[tuple[int, int, str]]) -> None:
        starts, ends = [], []
        for start, end, _ in sorted(spans):
            if ends and start < ends[-1]:
                ends[-1] = max(ends[-1], end)
            else:
                starts.append(start)
                ends.append(end)
        self.starts, self.ends = np.array(starts, np.int64), np.array(ends, np.int64)

    def meets(self, span: tuple[int, int, str]) -> bool:
        at = int(np.searchsorted(self.ends, span[0], "right"))
        return at < len(self.starts) and int(self.starts[at]) < span[1]


def describe(text: str, span: tuple[int, int, str]) -> list[float]:
    """Format and context of a candidate."""
    start, end, kind = span
    part, before, after = text[start:end], text[max(0, start - CONTEXT) : start], text[end : end + CONTEXT]
    digits = digits_of(part)
    groups = re.findall("[0-9]+", part)
    tail = re.split(r"[^A-Za-z0-9-]+", part.strip())[-1] or ""
    others = {c for c in part if not c.isalnum()}
    return [
        *(float(kind == k) for k in KINDS),
        len(part),
        len(digits),
        sum(c.isalpha() for c in part),
        len(others),
        len(groups),
        max(map(len, groups), default=0) - min(map(len, groups), default=0),
        float(12 <= len(digits) <= 19 and luhn(digits)),
        float(small_parts(part)),
        float(kind == "email" and tail.isalpha() and 2 <= len(tail) <= 10),
        float(9 <= len(digits) <= 15),
        float(part.startswith(("+", "00", "("))),
        float(before[-1:].isalnum() or before[-1:] in ("_", "#", "$", "=", '"')),
        float(after[:1].isalnum() or after[:1] in ("_", "%", '"')),
        float(bool(CUES[kind].search(before))),
        sum("0" <= c <= "9" for c in before + after) / (1 + len(before) + len(after)),
    ]


def spoiled(text: str, span: tuple[int, int, str]) -> tuple[str, tuple[int, int, str]] | None:
    """The same context with the span changed so that it breaks the rule of its kind."""
    start, end, kind = span
    part = text[start:end]
    if kind == "email":
        new = part.rpartition(".")[0].replace(".", "-")
    elif kind == "ip":
        new = re.sub("^[0-9]+", lambda m: str(300 + int(m[0][:4]) % 600), part)
    elif kind == "card":
        new = part[:-1] + str((int(part[-1]) + 3) % 10)
    else:
        new = part[: max(4, len(part) // 2)]
    if not new or new == part or kind != "email" and holds(kind, new):
        return None
    left, right = max(0, start - CONTEXT), end + CONTEXT
    context = text[left:start] + new + text[end:right]
    return context, (start - left, start - left + len(new), kind)


def _leaf(tree: list[tuple[int, float, int, int, float]], rows: np.ndarray) -> np.ndarray:
    """The node of the tree that each row ends in."""
    at = np.zeros(len(rows), np.int64)
    feature, cut, left, right, _ = (np.array(c) for c in zip(*tree, strict=True))
    for _ in range(DEPTH):
        low = rows[np.arange(len(rows)), np.maximum(feature[at], 0)] <= cut[at]
        at = np.where(feature[at] >= 0, np.where(low, left[at], right[at]), at)
    return at


@dataclass
class Trees:
    """Boosted regression trees on logits: per node feature, cut, children; leaves hold a value."""

    start: float = 0.0
    nodes: list[list[tuple[int, float, int, int, float]]] = field(default_factory=list)

    def logits(self, rows: np.ndarray) -> np.ndarray:
        out = np.full(len(rows), self.start)
        for tree in self.nodes:
            out += np.array([node[4] for node in tree])[_leaf(tree, rows)]
        return out

    def chances(self, rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.logits(rows)))


# Where a feature of ``describe`` may be cut: yes or no, counts, shares. A row's bin is the first cut not below it.
FLAG, SIZES, SHARES = (0.0,), (0, 1, 2, 3, 4, 5, 6, 8, 10, 12, 15, 16, 19, 24, 32, 48), tuple(i / 16 for i in range(16))
CUTS = [np.array(c, float) for c in (*[FLAG] * 4, *[SIZES] * 6, *[FLAG] * 8, SHARES)]
BINS = 1 + max(map(len, CUTS))


def binned(values: list[float]) -> bytes:
    return bytes(int(np.searchsorted(cuts, v)) for cuts, v in zip(CUTS, values, strict=True))


def _from_bins(column: pa.Array) -> np.ndarray:
    """The bins of each row."""
    joined = b"".join(column.to_pylist())
    return np.frombuffer(joined, np.uint8).reshape(-1, len(CUTS)).astype(np.int64)


def _as_values(bins: np.ndarray) -> np.ndarray:
    """Values that every tree cuts as it would the rows' own."""
    return np.stack([np.append(cuts, np.inf)[b] for cuts, b in zip(CUTS, bins.T, strict=True)], axis=1)


class Counts:
    """``bins, truth, held, n`` rows; sums over them are made on the driver if they are few, else in tasks."""

    def __init__(self, rows: DataFrame) -> None:
        self.rows = settle(rows)
        self.local = self.rows.toArrow() if self.rows.count() <= LOCAL_ROWS else None

    def sums(self, of: Callable[[np.ndarray, np.ndarray, np.ndarray], tuple], held: bool) -> dict[int, tuple[int, int]]:
        """Per code, the sums of two whole numbers; ``of`` gives codes and both from bins, truths and n."""

        def total(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                batch = batch.filter(pc.equal(batch["held"], held))
                if not batch.num_rows:
                    continue
                codes, *parts = of(_from_bins(batch["bins"]), batch["truth"].to_numpy(), batch["n"].to_numpy())
                found, at = np.unique(codes.astype(np.int64), return_inverse=True)
                added = np.zeros((2, len(found)), np.int64)
                for row, part in zip(added, parts, strict=True):
                    np.add.at(row, at, part)
                yield pa.RecordBatch.from_arrays([pa.array(found), *map(pa.array, added)], ["code", "x", "y"])

        if self.local is not None:
            parts = [r for b in total(self.local.to_batches()) for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        else:
            spread = self.rows.mapInArrow(total, "code long, x long, y long")
            parts = spread.groupBy("code").agg(F.sum("x"), F.sum("y")).collect()
        out: dict[int, tuple[int, int]] = {}
        for code, x, y in parts:
            before = out.get(code, (0, 0))
            out[code] = (before[0] + x, before[1] + y)
        return out


def boost(counts: Counts, rate: float = 0.3, ridge: float = 1.0) -> Trees | None:
    """Newton boosting of small trees, level by level from sums per leaf, feature and bin; None without both truths.

    Whole numbers are summed, so the trees do not depend on how the rows lie.
    """
    both = counts.sums(lambda bins, truth, n: (truth, n, n), held=False)
    if len(both) < 2:
        return None
    model = Trees(float(np.log((both[1][0] + 1) / (both[0][0] + 1))))
    for _ in range(TREES):
        tree: list[tuple[int, float, int, int, float]] = [(-1, 0.0, 0, 0, 0.0)]
        leaves = [0]
        for level in range(DEPTH + 1):

            def slopes(bins: np.ndarray, truth: np.ndarray, n: np.ndarray) -> tuple:
                values = _as_values(bins)
                p, at = model.chances(values), _leaf(tree, values)
                g = np.rint((truth - p) * UNIT).astype(np.int64) * n
                h = np.rint(p * (1 - p) * UNIT).astype(np.int64) * n
                codes = (at[:, None] * len(CUTS) + np.arange(len(CUTS))) * BINS + bins
                return codes.ravel(), np.repeat(g, len(CUTS)), np.repeat(h, len(CUTS))

            tables = np.zeros((len(tree), len(CUTS), BINS, 2))
            for code, sums in counts.sums(slopes, held=False).items():
                tables.reshape(-1, 2)[code] = sums
            tables /= UNIT
            grown = []
            for leaf in leaves:
                g, h = tables[leaf, 0].sum(axis=0)
                tree[leaf] = (-1, 0.0, 0, 0, float(rate * g / (h + ridge)))
                gl, hl = np.moveaxis(np.cumsum(tables[leaf], axis=1), 2, 0)
                gains = gl**2 / (hl + ridge) + (g - gl) ** 2 / (h - hl + ridge) - g**2 / (h + ridge)
                gains[(hl < 1 / UNIT) | (h - hl < 1 / UNIT)] = 0
                j, cut = np.unravel_index(int(np.argmax(gains)), gains.shape)
                if level < DEPTH and gains[j, cut] > 1e-6:
                    tree[leaf] = (int(j), float(CUTS[j][cut]), len(tree), len(tree) + 1, 0.0)
                    grown += [len(tree), len(tree) + 1]
                    tree += [(-1, 0.0, 0, 0, 0.0)] * 2
            if not grown:
                break
            leaves = grown
        model.nodes.append(tree)
    return model


@dataclass
class Model:
    """Trees and the least chance at which a wider spelling of a kind is taken; none without a threshold."""

    trees: Trees
    thresholds: dict[str, float]

    def spans(self, text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
        """Base spans, and all spans: a wider one joins if it meets none taken before it."""
        base, _, wider = proposals(text)
        if not wider or not self.thresholds:
            return base, base
        chances = self.trees.chances(np.array([describe(text, s) for s in wider]))
        taken: list[tuple[int, int, str]] = []
        for loss, span in sorted(zip((-chances).tolist(), wider, strict=True)):
            if -loss >= self.thresholds.get(span[2], 2) and not _Cover(taken).meets(span):
                taken.append(span)
        return base, sorted([*base, *taken], key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def examples(docs: DataFrame) -> DataFrame:
    """``bins, truth, held, n``: all different candidates of all documents, counted by their bins.

    The base patterns with their checks label the candidates: matches that pass
    are personal data, matches that fail are not, and every match that passes is
    also shown once with its check broken in the same context. Equal candidates
    count once, so a copied text does not weigh more. A quarter, by hash, is held.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[bytes, int, int]] = []
            for text in batch.column("text").to_pylist():
                base, failed, _ = proposals(text)
                shown = [(text, s, 1) for s in base] + [(text, s, 0) for s in failed]
                shown += [(*bad, 0) for s in base if (bad := spoiled(text, s))]
                for context, span, truth in shown:
                    values = describe(context, span)
                    draw = xxhash.xxh64_intdigest(f"{context[span[0] : span[1]]} {values}") >> 1
                    out.append((binned(values), truth, draw))
            columns = zip(*out, strict=True) if out else ([], [], [])
            types = (pa.binary(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], ["bins", "truth", "draw"]
            )

    rows = docs.select("text").where(F.rlike("text", F.lit("[0-9@]")))
    found = rows.mapInArrow(run, "bins binary, truth int, draw long").distinct()
    held = (F.col("draw") % 4 == 0).alias("held")
    return found.groupBy("bins", "truth", held).agg(F.count(F.lit(1)).alias("n"))


def fit(docs: DataFrame) -> Model:
    """Learn from every candidate of every document; see ``examples``.

    The trees are trained on those not held. The held ones set each kind's
    threshold at the least chance, in steps of 1 / ``STEPS``, above which
    ``PRECISION`` of the candidates are true.
    """
    counts = Counts(examples(docs))
    trees = boost(counts)
    if trees is None:
        return Model(Trees(), {})

    def judged(bins: np.ndarray, truth: np.ndarray, n: np.ndarray) -> tuple:
        steps = np.floor(trees.chances(_as_values(bins)) * STEPS).astype(np.int64)
        return np.argmax(bins[:, : len(KINDS)], axis=1) * (STEPS + 1) + steps, n * truth, n

    thresholds: dict[str, float] = {}
    right, every = np.zeros((2, len(KINDS), STEPS + 1), np.int64)
    for code, (good, number) in counts.sums(judged, held=True).items():
        right.flat[code], every.flat[code] = good, number
    for i, kind in enumerate(KINDS):
        # one imagined error, so that a handful of candidates proves nothing
        share = np.cumsum(right[i][::-1]) / (np.cumsum(every[i][::-1]) + 1)
        good = np.flatnonzero((share >= PRECISION) & (every[i][::-1] > 0))
        if len(good):
            thresholds[kind] = max(0.5, (STEPS - int(good[-1])) / STEPS)
    return Model(trees, thresholds)


def _written(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def find(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id``, counts by kind of the base spans, ``base`` and ``spans`` written as kind:start:end.

    Positions are code points, ends exclusive. A null text is empty; repeated
    rows and rows without doc_id are reported like any other.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [f"n_{kind}" for kind in KINDS]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, base, every = [], [], []
            for text in batch.column("text"):
                own, spans = shared.value.spans(text.as_py() or "")
                counts.append([sum(s[2] == kind for s in own) for kind in KINDS])
                base.append(_written(own))
                every.append(_written(spans))
            columns = np.array(counts, np.int64).reshape(-1, len(KINDS)).T
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *map(pa.array, columns), pa.array(base, pa.string()), pa.array(every, pa.string())],
                ["doc_id", *names, "base", "spans"],
            )

    rows = docs.select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(run, ", ".join(["doc_id long", *(f"{n} long" for n in names), "base string", "spans string"]))


def redacted(text: str, spans: list[tuple[int, int, str]]) -> str:
    """Spans replaced by their kind in capitals; overlapping ones together by the first one's."""
    out, at = [], 0
    for start, end, kind in spans:
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with the text's spans replaced, and ``n_chars`` counted anew where there is such a column."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    counted = "n_chars" in docs.columns

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for value in batch.column("text").to_pylist():
                spans = shared.value.spans(value)[1] if value else []
                texts.append(redacted(value, spans) if spans else value)
            at = batch.schema.get_field_index("text")
            batch = batch.set_column(at, "text", pa.array(texts, batch.schema.field(at).type))
            if counted:
                at = batch.schema.get_field_index("n_chars")
                sizes = [n if t is None else len(t) for t, n in zip(texts, batch.column(at).to_pylist(), strict=True)]
                batch = batch.set_column(at, "n_chars", pa.array(sizes, batch.schema.field(at).type))
            yield batch

    return docs.mapInArrow(run, docs.schema)

"""Near-duplicate groups by SimHash fingerprints and meet-in-the-middle ball hashing."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from traceforge.llm.common import release, settle, small_batches, words
from traceforge.llm.components import connected_components
from traceforge.operators.lookup import attach_bounded

SEED = 42
# Shingles whose bits are spread out at once.
BLOCK = 1 << 14
# Odd multipliers from which further 64-bit words of a fingerprint are drawn.
GOLDEN, MIX = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9
# Share of differing bits of two equally large sets at a Jaccard similarity of 0.8: arccos(2J / (1 + J)) / pi.
SHARE = math.acos(1.6 / 1.8) / math.pi
# Nodes under one key that meet pair by pair; tables of keys.
FEW, TABLES = 16, 4
# Classes of shingles by hash, counted one at a time; sets of one shingle that are counted.
CLASSES, MOST = 8, 100_000


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """XXH64 of each run of ``size`` words, A-Z lower-cased, repeats included; of all words if fewer."""
    sequence = words(text.encode().lower().decode()) if text else []
    if not sequence:
        return np.zeros(0, np.uint64)
    size = min(size, len(sequence))
    joined = b" ".join(sequence)
    ends = np.cumsum(np.fromiter(map(len, sequence), np.int64, len(sequence)) + 1)
    starts = np.concatenate(([0], ends[: len(sequence) - size]))
    spans = zip(starts.tolist(), (ends[size - 1 :] - 1).tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[s:e], SEED) for s, e in spans), np.uint64, len(starts))


def majority(hashes: np.ndarray, parts: int) -> bytes:
    """Fingerprint of 64 × ``parts`` bits, the first 64 from the hashes themselves; big-endian words."""
    ones = np.zeros(64 * parts, np.int64)
    for at in range(0, len(hashes), BLOCK):
        block = hashes[at : at + BLOCK]
        wide = np.empty((len(block), parts), "<u8")
        wide[:, 0] = block
        for part in range(1, parts):
            mixed = (block + np.uint64(GOLDEN * part % 2**64)) * np.uint64(MIX)
            wide[:, part] = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(GOLDEN)
        ones += np.unpackbits(wide.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    value = np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")
    return value.astype(">u8").tobytes()


def fingerprints(docs: DataFrame, shingle_words: int = 3, parts: int = 1) -> DataFrame:
    """``doc_id, fingerprint`` (binary, 8 × ``parts`` bytes). Rows without doc_id are left out."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [
                majority(shingle_hashes(text.as_py(), shingle_words), parts) for text in batch.column("text")
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array(values, pa.binary())],
                ["doc_id", "fingerprint"],
            )

    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(run, "doc_id long, fingerprint binary")


def _bits(width: int, table: Column) -> Column:
    """Table ``table``'s key: its ``width`` bits of the hex form of a fingerprint, as a long."""
    digits = width // 4
    part = F.substr(F.hex("fingerprint"), table * digits + 1, F.lit(digits))
    return F.conv(part, 16, -10).cast("long")


def _ball(keys: DataFrame, width: int) -> DataFrame:
    """Each row of ``keys`` (table, key, ...) at its key and at all keys one bit away, as ``place``."""
    ball = f"concat(array(key), transform(sequence(0, {width - 1}), j -> key ^ shiftleft(1L, j)))"
    place = F.col("variant") if width == 64 else F.shiftleft(F.col("table").cast("long"), width).bitwiseOR(F.col("variant"))
    return keys.withColumn("variant", F.explode(F.expr(ball))).withColumn("place", place).drop("variant")


def _ball_links(keys: DataFrame, width: int, neighbours: bool) -> DataFrame:
    """Candidate links ``a, b`` of ``table, key, node`` rows with distinct (table, key).

    Each key emits itself and all keys one bit away; two keys at most two bits
    apart meet at the key in between. At most ``width + 1`` keys meet there, all
    within two bits of each other, so a link to the smallest node of a meeting
    place joins them all; with ``neighbours``, for callers whose verification
    may refuse some, every two of them are linked. Keys of several tables must
    leave room for the table's number above them.
    """
    emitted = _ball(keys, width).select("place", "node")
    if neighbours:
        order = Window.partitionBy("place").orderBy("node")  # most places hold one key: they go before any list is made
        shared = emitted.withColumn("near", F.coalesce(F.lag("node").over(order), F.lead("node").over(order)))
        met = shared.where("near is not null").groupBy("place").agg(F.collect_list("node").alias("met"))
        met = met.select(F.explode("met").alias("a"), "met").select("a", F.explode("met").alias("b"))
        return met.where("a > b").distinct()
    found = emitted.withColumn("other", F.first("node").over(Window.partitionBy("place").orderBy("node")))
    return found.where("other <> node").select(F.col("node").alias("a"), F.col("other").alias("b")).distinct()


def key_width(documents: int) -> int:
    """Bits of a key, so many that unrelated documents rarely meet, whatever their number."""
    return min(56, 4 * math.ceil(math.log2(500 * max(documents, 2)) / 4))


def near_duplicates(docs: DataFrame, shingle_words: int = 3) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every document with an id.

    64-bit fingerprints link at two or fewer differing bits, and every link is
    found. A null or empty text has fingerprint zero and links like any other.
    Rows that share a doc_id are reported once each, in one group. Copies are
    collapsed by fingerprint before anything is emitted.
    """
    marked = settle(fingerprints(docs, shingle_words))
    nodes = marked.groupBy("fingerprint").agg(F.min("doc_id").alias("node"))
    keys = nodes.select(F.lit(0).alias("table"), _bits(64, F.lit(0)).alias("key"), "node")
    groups = connected_components(_ball_links(keys, 64, neighbours=False))
    named = nodes.join(groups, nodes["node"] == groups["node"], "left").select(
        "fingerprint", F.coalesce("component", nodes["node"]).alias("component_id")
    )
    return marked.join(named, "fingerprint").select("doc_id", "fingerprint", "component_id")


def _marks(docs: DataFrame, shingle_words: int, parts: int) -> DataFrame:
    """``doc_id, hash, shingles, fingerprint`` of rows with an id: digest and fingerprint of the set of shingles."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingle_hashes(text.as_py(), shingle_words)) for text in batch.column("text")]
            digests = [xxhash.xxh3_128_digest(found.tobytes()) for found in sets]
            values = [majority(found, parts) for found in sets]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(digests, pa.binary()), pa.array(values, pa.binary())],
                ["doc_id", "hash", "shingles", "fingerprint"],
            )

    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("hash"), "text")
    return rows.mapInArrow(run, "doc_id long, hash long, shingles binary, fingerprint binary")


def _near(pairs: DataFrame, nodes: DataFrame, parts: int) -> DataFrame:
    """``pairs`` (a, b, ...) with ``apart``, the share of differing bits of their fingerprints."""
    left = nodes.select(F.col("node").alias("a"), F.col("fingerprint").alias("fa"))
    right = nodes.select(F.col("node").alias("b"), F.col("fingerprint").alias("fb"))
    words_of = lambda f, i: F.conv(F.substr(F.hex(f), F.lit(16 * i + 1), F.lit(16)), 16, -10).cast("long")
    differing = sum(F.bit_count(words_of("fa", i).bitwiseXOR(words_of("fb", i))) for i in range(parts))
    return pairs.join(left, "a").join(right, "b").withColumn("apart", differing / (64.0 * parts)).drop("fa", "fb")


def _candidates(nodes: DataFrame, width: int, tables: range, parts: int, max_distance: float) -> list[DataFrame]:
    """Pairs ``a, b`` whose keys are at most two bits apart in one of ``tables`` and whose fingerprints are near.

    Under one key, nodes near a leader stand behind it in this table, and those
    that it refuses go on among themselves, until no more than ``FEW`` are left
    and meet pair by pair. The first leaders of keys one or two bits apart meet
    by ball hashing, one table after the other. Another table draws other leaders.
    """
    each = nodes.withColumn("table", F.explode(F.array(*map(F.lit, tables))))
    rest = settle(each.select("table", _bits(width, F.col("table")).alias("key"), "node"))
    found, met = [], None
    rank = F.struct(F.xxhash64("table", "node").alias("rank"), "node")
    while True:
        groups = rest.groupBy("table", "key").agg(F.count("*").alias("n"), F.min(rank)["node"].alias("b"))
        if met is None:
            groups = settle(groups)
            for table in tables:
                first = groups.where(F.col("table") == table).select("table", "key", F.col("b").alias("node"))
                met = _near(_ball_links(first, width, neighbours=True), nodes, parts)
                found.append(settle(met.where(F.col("apart") <= max_distance)))
                release(nodes.sparkSession)
        small, large = groups.where(f"n <= {FEW}"), settle(groups.where(f"n > {FEW}"))
        few = rest.join(small.select("table", "key", "n"), ["table", "key"])
        two = few.where("n > 1").select("table", "key", F.col("node").alias("a"))
        two = two.join(two.select("table", "key", F.col("a").alias("b")), ["table", "key"]).where("a > b")
        found.append(settle(_near(two.select("a", "b").distinct(), nodes, parts).where(F.col("apart") <= max_distance)))
        if large.isEmpty():
            break
        led = rest.join(large.drop("n"), ["table", "key"]).where("node <> b").withColumnRenamed("node", "a")
        led = settle(_near(led, nodes, parts))
        found.append(led.where(F.col("apart") <= max_distance))
        rest = led.where(F.col("apart") > SHARE).select("table", "key", F.col("a").alias("node"))
    return [part.select("a", "b") for part in found]


def _sets(nodes: DataFrame, docs: DataFrame, shingle_words: int) -> DataFrame:
    """``node, size, shingles``: each node's set of shingles, as sorted 64-bit hashes."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingle_hashes(text.as_py(), shingle_words)) for text in batch.column("text")]
            columns = [batch["node"], pa.array(map(len, sets), pa.int64())]
            binary = pa.array([x.tobytes() for x in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([*columns, binary], ["node", "size", "shingles"])

    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("hash"), "text")
    found = rows.join(nodes.select("node", "doc_id", "hash"), ["doc_id", "hash"])
    once = found.groupBy("doc_id", "hash").agg(F.any_value("node").alias("node"), F.any_value("text").alias("text"))
    return once.select("node", "text").mapInArrow(run, "node long, size long, shingles binary")


def _shared(sets: DataFrame, part: int) -> DataFrame:
    """``node, token, df`` of the shingles of this class that several sets hold; ``df`` says how many, ``MOST`` at most."""

    def spread(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = np.frombuffer(b"".join(batch["shingles"].to_pylist()), np.int64)
            nodes = np.repeat(batch["node"].to_numpy(), batch["size"].to_numpy())
            mine = tokens % CLASSES == part
            yield pa.RecordBatch.from_arrays([pa.array(tokens[mine]), pa.array(nodes[mine])], ["token", "node"])

    def counted(tokens: np.ndarray, nodes: np.ndarray) -> pa.RecordBatch:
        starts = np.flatnonzero(np.concatenate(([True], tokens[1:] != tokens[:-1]))) if len(tokens) else np.zeros(0, np.int64)
        sizes = np.diff(np.append(starts, len(tokens)))
        df = np.minimum(np.repeat(sizes, sizes), MOST).astype(np.int32)
        keep = df > 1
        return pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (nodes, tokens, df)], ["node", "token", "df"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the last token of a batch may go on in the next; of one held by MOST sets no more is kept back
        tokens, nodes, many = np.zeros(0, np.int64), np.zeros(0, np.int64), None
        for batch in batches:
            new, theirs = batch["token"].to_numpy(), batch["node"].to_numpy()
            if many is not None:
                at = int(np.searchsorted(new, many, "right"))
                full = np.full(at, MOST, np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(theirs[:at]), pa.array(new[:at]), pa.array(full)], ["node", "token", "df"])
                new, theirs = new[at:], theirs[at:]
            if not len(new):
                continue
            tokens, nodes, many = np.concatenate((tokens, new)), np.concatenate((nodes, theirs)), None
            last = int(np.searchsorted(tokens, tokens[-1]))
            if len(tokens) - last >= MOST:
                many, last = tokens[-1], len(tokens)
            yield counted(tokens[:last], nodes[:last])
            tokens, nodes = tokens[last:], nodes[last:]
        yield counted(tokens, nodes)

    rows = sets.mapInArrow(spread, "token long, node long")
    return rows.repartition("token").sortWithinPartitions("token").mapInArrow(run, "node long, token long, df int")


def _prefixes(sets: DataFrame, similarity: float) -> DataFrame:
    """``token, node, size, place``: the shingles of a set under which it must meet every set of this Jaccard similarity.

    Similar sets have at least similarity × size shingles in common, so with
    all shingles in one order they share one of the first
    size - similarity × size + 1. The order starts with those held by few sets,
    so that what many have in common stands behind; ``place`` is that in it.
    Shingles of one set alone come first and meet nothing, and most sets have
    nothing else in their prefix.
    """
    length = F.col("size") - F.ceil(F.col("size") * similarity - 1e-9) + 1
    of, parts = Window.partitionBy("node"), []
    for part in range(CLASSES):
        parts.append(settle(_shared(sets, part)))
        release(sets.sparkSession)
    ranked = reduce(DataFrame.unionByName, parts).select(
        "token", "node", F.count("*").over(of).alias("shared"), F.row_number().over(of.orderBy("df", "token")).alias("rank")
    )
    place = F.col("rank") + F.col("size") - F.col("shared")
    placed = ranked.join(sets.select("node", "size"), "node").withColumn("place", place)
    return placed.where(F.col("place") <= length).select("token", "node", "size", "place")


def _alike(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The ``pairs`` (a, b) whose sets of shingles have at least this Jaccard similarity."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch["sa"].to_pylist(), batch["sb"].to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(both >= similarity * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    pairs = settle(pairs)
    ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    asked = attach_bounded(sets, ends, ["node"])
    left, right = (asked.select(F.col("node").alias(n), F.col("shingles").alias(f"s{n}")) for n in "ab")
    return pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def _grouped(entries: DataFrame, groups: DataFrame) -> DataFrame:
    """``entries`` with the ``group`` of their node."""
    named = groups.withColumnRenamed("component", "_c")
    return entries.join(named, "node", "left").withColumn("group", F.coalesce("_c", "node")).drop("_c")


def _led(entries: DataFrame, groups: DataFrame, similarity: float, lead: Callable) -> DataFrame:
    """Pairs ``a, b`` of each node and the least or largest one under its token, if their groups differ and their sizes allow the similarity."""
    placed = _grouped(entries, groups)
    other = placed.groupBy("token").agg(lead(F.struct("node", "size", "group")).alias("other")).select(
        "token", *[F.col(f"other.{c}").alias(f"_{c}") for c in ("node", "size", "group")]
    )
    fits = F.least("size", "_size") >= F.greatest("size", "_size") * similarity - 1e-9
    met = placed.join(other, "token").where((F.col("group") != F.col("_group")) & fits)
    return met.select(F.greatest("node", "_node").alias("a"), F.least("node", "_node").alias("b")).distinct()


def _apart(entries: DataFrame, groups: DataFrame, similarity: float) -> DataFrame:
    """Pairs ``a, b`` of different groups whose first common shingle, going by its places, allows the similarity.

    Of two sets, no more is in common than what stands from there on in either,
    and a similar pair has (size + size) × similarity / (1 + similarity) in
    common. That binds the smaller one to ``early`` places. Under each token the
    largest group does not meet itself, however many copies it has.
    """
    share = similarity / (1 + similarity)
    early = F.col("size") - F.col("place") + 1 >= 2 * share * F.col("size") - 1e-9
    placed = _grouped(entries, groups).withColumn("early", early)
    each = placed.groupBy("token", "group").agg(F.count("*").alias("n"), F.max("early").alias("early"))
    mixed = each.groupBy("token").agg(
        F.max_by("group", F.struct("n", "group")).alias("main"), F.count("*").alias("n"), F.max("early").alias("early")
    )
    met = placed.join(mixed.where("n > 1 and early").select("token", "main"), "token")
    met = settle(met.withColumn("odd", F.col("group") != F.col("main")).drop("main"))
    asked = F.when(F.col("odd"), F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(True)))
    small = met.where("early").withColumn("odd", F.explode(asked)).drop("early")
    large = met.drop("early").withColumnsRenamed({c: f"_{c}" for c in ("node", "size", "place", "group")})
    in_order = F.struct("size", "node") < F.struct(F.col("_size").alias("size"), F.col("_node").alias("node"))
    left = F.least(F.col("size") - F.col("place"), F.col("_size") - F.col("_place")) + 1
    enough = left >= (F.col("size") + F.col("_size")) * share - 1e-9
    fits = (F.col("size") >= F.col("_size") * similarity - 1e-9) & enough
    pairs = small.join(large, ["token", "odd"]).where((F.col("group") != F.col("_group")) & in_order & fits)
    return pairs.select(F.greatest("node", "_node").alias("a"), F.least("node", "_node").alias("b")).distinct()


def _meeting(entries: DataFrame, groups: DataFrame, similarity: float, lead: Callable | None) -> DataFrame:
    """Pairs ``a, b`` of different groups to compare, with ``lead`` those of one node per token only."""
    return _led(entries, groups, similarity, lead) if lead else _apart(entries, groups, similarity)


def near_copies(
    docs: DataFrame, shingle_words: int = 5, parts: int = 5, max_distance: float = 0.23, similarity: float = 0.8
) -> DataFrame:
    """``doc_id, hash`` (of the text) of the texts with an id that have a near copy before them.

    Two texts are near copies if their sets of shingles have this Jaccard
    similarity; no such link between different groups is missed. Fingerprints of
    the sets, of at least 64 × ``parts`` bits, propose the first links, at that
    share of differing bits. The rest is proposed by shared shingles, see
    ``_prefixes``: first each text with the least and the last one under each
    shingle, then all that still are in different groups and have enough behind
    that shingle, so that neither the copies of one text nor texts that share a
    long passage meet pair by pair. The exact similarity decides. Texts with
    equal sets count as one, that of the smallest doc_id.
    """
    spark, width = docs.sparkSession, key_width(docs.count())
    parts = max(parts, -(-width * TABLES // 64))
    with small_batches(spark):
        marked = settle(_marks(docs, shingle_words, parts))
        least = F.min(F.struct("doc_id", "hash"))
        nodes = marked.groupBy("shingles").agg(least.alias("least"), F.any_value("fingerprint").alias("fingerprint"))
        nodes = nodes.select("least.*", "shingles", "fingerprint").repartitionByRange("doc_id", "hash")
        nodes = settle(nodes.sortWithinPartitions("doc_id", "hash").withColumn("node", F.monotonically_increasing_id()))
        sets = settle(_sets(nodes, docs, shingle_words))
        release(spark)
        found = reduce(DataFrame.unionByName, _candidates(nodes, width, range(TABLES), parts, max_distance))
        pairs = found.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        groups = connected_components(_alike(pairs, sets, similarity))
        release(spark)
        entries = settle(_prefixes(sets, similarity))
        release(spark)
        for lead in (F.min, F.max, None):
            good = _alike(_meeting(entries, groups, similarity, lead), sets, similarity)
            groups = connected_components(good.unionByName(groups.toDF("a", "b")))
            release(spark)
    stay = nodes.join(groups, "node", "left_anti").select("doc_id", "hash")
    return marked.select("doc_id", "hash").distinct().join(stay, ["doc_id", "hash"], "left_anti")


def keep_first(docs: DataFrame, **settings) -> DataFrame:
    """One document of each near-duplicate group, the one with the smallest doc_id.

    Rows that repeat a doc_id and its text count as copies; different texts of
    one doc_id are judged each by itself.
    """
    gone = near_copies(docs, **settings)
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("hash"), F.struct("*").alias("row"))
    once = rows.groupBy("doc_id", "hash").agg(F.any_value("row").alias("row"))
    return once.join(gone, ["doc_id", "hash"], "left_anti").select("row.*")

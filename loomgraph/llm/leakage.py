"""Evaluation passages in training text: spaced-seed hashing, a join of hashes, and verification around the hits.

A spaced seed is a fixed mask over a window of words; only the words under its ones are hashed, so a substitution
under a zero leaves the hash alone. The seeds' span is no longer than the passage length asked for, so every run of
that many equal words holds a full window of each seed: no exact passage is missed, and passages with scattered
substitutions are found as well.

Both sides give one row for each window and seed, and the rows are joined by hash; which side is broadcast, if any, is
the planner's choice by their sizes. A bit for each test window's hash (a table of bounded size) goes to the corpus
tasks first, so of the corpus only windows that may meet one leave their task. What the join finds is a diagonal of a
document and an item; each is verified word by word, document after document, as a stream.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.staging import stage
from loomgraph.llm.words import hash_words

#: Characters of documents whose words are held at once by a task; a longer text is held alone.
SLICE = 2_000_000
#: The bit table: bits for each test window, bounds on its size as powers of two, bits of a piece (collected apart).
BITS_EACH, LEAST_BITS, MOST_BITS, PIECE = 32, 16, 28, 16


@dataclass(frozen=True)
class LeakSpec:
    """``seeds``: masks with a span of at most ``run`` words. ``run``: equal words in a row that make a leak.

    ``equal``: least share of equal words in an overlap, as a fraction of integers.
    """

    run: int = 12
    seeds: tuple[str, ...] = ("110110110111", "111010110011", "101101011101")
    equal: tuple[int, int] = (4, 5)

    def covers(self) -> bool:
        """Whether windows of all seeds at one place look at every word of a run: then all of them meet only in runs."""
        return all(len(s) == self.run for s in self.seeds) and all(any(s[i] == "1" for s in self.seeds) for i in range(self.run))


def seed_hashes(flat: np.ndarray, seed: str, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the seed's windows; 0 is no word (the gap between texts), and no window lies over one."""
    ones = [i for i, c in enumerate(seed) if c == "1"]
    n = len(flat) - len(seed) + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    gaps = np.r_[0, np.cumsum(flat == 0)]
    at = np.flatnonzero(gaps[len(seed) :] == gaps[:n])
    h = np.full(len(at), (0x243F6A8885A308D3 + salt * 0x13198A2E03707345) & (2**64 - 1), np.uint64)
    for i in ones:
        h = (h ^ flat[at + i]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(31)
    return at, h


def flat_words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word hashes with a 0 after each text, first position of each text, its number of words)."""
    h, n = hash_words(texts)
    start = np.r_[0, np.cumsum(n + 1)[:-1]] if len(n) else np.zeros(0, np.int64)
    out = np.zeros(len(h) + len(n), np.uint64)
    out[np.arange(len(h)) + np.repeat(np.arange(len(n)), n)] = h
    return out, start, n


def _slices(rb: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """The batch in parts of bounded text."""
    size = np.cumsum([len(t or "") for t in rb.column(column).to_pylist()])
    lo = 0
    while lo < rb.num_rows:
        hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + SLICE, side="right")))
        yield rb.slice(lo, hi - lo)
        lo = hi


def item_words(items: DataFrame, item_id: str, text: str, spec: LeakSpec) -> DataFrame:
    """(item_id, same, words): word hashes of the items with a window; items of equal words share ``same``."""
    least = min(map(len, spec.seeds))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for rb in batches for part in _slices(rb, 1)):
            flat, start, n = flat_words(b.column(1).to_pylist())
            some = np.flatnonzero(n >= least)
            lists = [flat[start[i] : start[i] + n[i]].view(np.int64) for i in some]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(some)), pa.array(lists, pa.list_(pa.int64()))], names=["item_id", "words"])

    rows = items.where(F.col(item_id).isNotNull() & F.col(text).isNotNull()).select(F.col(item_id).cast("long").alias("item_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "item_id long, words array<long>").select("item_id", F.xxhash64("words").alias("same"), "words")


def item_windows(classes: DataFrame, spec: LeakSpec) -> DataFrame:
    """(hash, seed, same, item_at) of all windows of the items' distinct texts (same, words)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for same, ws in zip(b.column(0).to_pylist(), b.column(1)):
                flat = ws.values.to_numpy().astype(np.int64).view(np.uint64)
                for k, seed in enumerate(spec.seeds):
                    at, h = seed_hashes(flat, seed, k)
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.full(len(h), k, np.int32)), pa.array(np.full(len(h), same, np.int64)), pa.array(at.astype(np.int32))], names=["hash", "seed", "same", "item_at"])

    return classes.select("same", "words").mapInArrow(run, "hash long, seed int, same long, item_at int")


def bit_table(windows: DataFrame) -> tuple[np.ndarray, int]:
    """(bits set at the top ``power`` bits of the windows' hashes, power): at most 2^MOST_BITS bits, joined piece by piece."""
    n = windows.count()
    power = int(min(MOST_BITS, max(LEAST_BITS, np.ceil(np.log2(max(n, 1) * BITS_EACH)))))

    def pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            at = (b.column(0).to_numpy().view(np.uint64) >> np.uint64(64 - power)).astype(np.int64)
            for p in np.unique(at >> PIECE):
                bits = held.setdefault(int(p), np.zeros(1 << PIECE, bool))
                bits[at[at >> PIECE == p] & ((1 << PIECE) - 1)] = True
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([np.packbits(x).tobytes() for x in held.values()], pa.binary())], names=["piece", "bits"])

    def joined(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for p, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                held[p] = held[p] | np.frombuffer(raw, np.uint8) if p in held else np.frombuffer(raw, np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([x.tobytes() for x in held.values()], pa.binary())], names=["piece", "bits"])

    schema = "piece int, bits binary"
    out = np.zeros(1 << (power - 3), np.uint8)
    width = 1 << (PIECE - 3)
    for p, raw in windows.select("hash").mapInArrow(pieces, schema).repartition("piece").mapInArrow(joined, schema).collect():
        out[p * width : (p + 1) * width] = np.frombuffer(bytes(raw), np.uint8)
    return out, power


def corpus_windows(source: DataFrame, bits: np.ndarray, power: int, spec: LeakSpec, together: bool) -> DataFrame:
    """(hash, seed, doc, doc_at) of the windows of ``source`` (doc, text) whose bit is set; ``together``: only where all
    seeds' windows at a place are."""
    shared = source.sparkSession.sparkContext.broadcast((bits, power))  # at most 2^MOST_BITS bits

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, top = shared.value
        for b in (part for rb in batches for part in _slices(rb, 1)):
            flat, start, n = flat_words(b.column(1).to_pylist())
            found = []
            for k, seed in enumerate(spec.seeds):
                at, h = seed_hashes(flat, seed, k)
                bit = (h >> np.uint64(64 - top)).astype(np.int64)
                hit = (table[bit >> 3] >> (7 - (bit & 7)).astype(np.uint8)) & 1 > 0
                found.append((at[hit], h[hit]))
            if together:
                common = found[0][0]
                for at, _ in found[1:]:
                    common = common[np.isin(common, at, assume_unique=True)]
                found = [(at[keep], h[keep]) for at, h in found for keep in [np.isin(at, common, assume_unique=True)]]
            for k, (at, h) in enumerate(found):
                doc = np.searchsorted(start, at, side="right") - 1
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.full(len(h), k, np.int32)), b.column(0).take(pa.array(doc)), pa.array((at - start[doc]).astype(np.int64))], names=["hash", "seed", "doc", "doc_at"])

    return source.select("doc", "text").mapInArrow(run, "hash long, seed int, doc long, doc_at long")


def overlap(same: np.ndarray, equal: tuple[int, int]) -> tuple[int, int, int]:
    """(longest exact run, words of the longest overlap, equal words in it) of a diagonal's equal places.

    An overlap starts and ends with an equal word, and at least ``equal`` of its words are.
    """
    if not same.any():
        return 0, 0, 0
    edge = np.flatnonzero(np.diff(np.r_[False, same, False].astype(np.int8)))
    exact = int((edge[1::2] - edge[::2]).max())
    num, den = equal
    sums = np.r_[0, np.cumsum(np.where(same, den - num, -num))]
    count = np.r_[0, np.cumsum(same)]
    lowest = np.minimum.accumulate(np.where(same, sums[:-1], np.iinfo(np.int64).max))
    end = np.flatnonzero(same) + 1
    begin = np.searchsorted(-lowest, -sums[end], side="left")
    k = int((end - begin).argmax())
    return exact, int(end[k] - begin[k]), int(count[end[k]] - count[begin[k]])


VERIFIED = "doc long, doc_id long, same long, exact_run int, overlap_words int, equal_words int"


def verified(diagonals: DataFrame, source: DataFrame, classes: DataFrame, spec: LeakSpec) -> DataFrame:
    """Each diagonal (doc, same, shift) compared word by word: see VERIFIED.

    Documents and diagonals meet sorted by document, its text first, and stream through: a task holds one text's words.
    """
    texts = source.join(diagonals.select("doc").distinct(), "doc", "left_semi").select("doc", F.lit(0).alias("kind"), "doc_id", "text", F.lit(None).cast("long").alias("same"), F.lit(None).cast("long").alias("shift"), F.lit(None).cast("array<long>").alias("words"))
    tasks = diagonals.join(classes, "same").select("doc", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"), "same", "shift", "words")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, doc_id, ws = None, None, np.zeros(0, np.uint64)
        for b in batches:
            out: list[tuple[int, int, int, int, int, int]] = []
            docs, kinds, ids, shifts, sames = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(5).to_pylist(), b.column(4).to_pylist()
            for i, doc in enumerate(docs):
                if kinds[i] == 0:
                    if doc != held:  # repeated rows of a document are equal
                        held, doc_id, ws = doc, ids[i], hash_words([b.column(3)[i].as_py()])[0]
                    continue
                item = b.column(6)[i].values.to_numpy().view(np.uint64)
                lo = max(0, -shifts[i])
                n = min(len(item), len(ws) - shifts[i]) - lo
                if n > 0:
                    out.append((doc, doc_id, sames[i], *overlap(ws[lo + shifts[i] : lo + shifts[i] + n] == item[lo : lo + n], spec.equal)))
            columns = list(zip(*out)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if j < 3 else pa.int32()) for j, c in enumerate(columns)], names=["doc", "doc_id", "same", "exact_run", "overlap_words", "equal_words"])

    return texts.unionByName(tasks).repartition("doc").sortWithinPartitions("doc", "kind").mapInArrow(run, VERIFIED)


def overlaps(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", spec: LeakSpec = LeakSpec(), exact: bool = False) -> DataFrame:
    """(doc_id, item_id, exact_run, overlap_words, equal_words): for each pair that a seed hit, the longest exact run and
    the longest overlap (see :func:`overlap`) on any diagonal with a hit.

    ``exact``: only pairs with ``spec.run`` equal words in a row are wanted; then diagonals are verified only where
    windows of all seeds meet. Whole texts are read. Null texts and ids and items shorter than a seed match nothing;
    items filed twice are reported under each id, documents filed twice under each of theirs; a repeated row gives a
    row once. No items, no rows.
    """
    if any(len(s) > spec.run for s in spec.seeds):
        raise ValueError("a seed is longer than the run that it must find")
    together = exact and spec.covers()
    known = stage(item_words(items, item_id, text, spec), "leak-items")
    classes = known.groupBy("same").agg(F.first("words").alias("words"))
    windows = stage(item_windows(classes, spec), "leak-windows")
    bits, power = bit_table(windows)
    source = docs.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(F.xxhash64(F.col(doc_id).cast("long"), F.col(text).cast("string")).alias("doc"), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    met = corpus_windows(source, bits, power, spec, together).join(windows, ["hash", "seed"])
    if together:
        met = met.groupBy("doc", "same", "doc_at", "item_at").agg(F.count_distinct("seed").alias("seeds")).where(F.col("seeds") == len(spec.seeds))
    diagonals = stage(met.select("doc", "same", (F.col("doc_at") - F.col("item_at")).alias("shift")).distinct(), "leak-diagonals")
    longest = F.max(F.struct("overlap_words", "equal_words")).alias("o")
    best = verified(diagonals, source, classes, spec).groupBy("doc_id", "same").agg(F.max("exact_run").alias("exact_run"), longest)
    return best.join(known.select("item_id", "same").distinct(), "same").groupBy("doc_id", "item_id").agg(F.max("exact_run").alias("exact_run"), F.max("o").alias("o")).select("doc_id", "item_id", "exact_run", "o.overlap_words", "o.equal_words")


def leaks(docs: DataFrame, items: DataFrame, spec: LeakSpec = LeakSpec()) -> DataFrame:
    """(doc_id, item_id): documents that hold ``spec.run`` words in a row of the item."""
    return overlaps(docs, items, spec=spec, exact=True).where(F.col("exact_run") >= spec.run).select("doc_id", "item_id").distinct()

"""Candidate pairs from an index of (document, key) rows.

Rows are brought together and sorted by key, so a bucket is a run of equal keys; runs stream through numpy in bounded
memory. A run of more than ``hot`` rows is not paired there: its rows come out marked, are cut into blocks of about
``BLOCK`` rows, and block is compared with block in many tasks. Nothing is dropped: one shared bucket is enough for a
pair, however crowded it is. The comparisons grow with the square of a crowded bucket.

Keys that a sample of documents shows to be crowded are never brought together at all: their rows carry a salt, spread
over the tasks and go to the blocks at once. What the sample overlooks is found crowded in its task; the pairs are the same.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.staging import stage
from loomgraph.operators.skew import join_sized

#: Rows held at once by a task while it pairs runs.
CHUNK = 400_000
#: Rows of a block of a crowded bucket, on average; a task holds two.
BLOCK = 16_384
#: Pairs of rows of two blocks compared at once.
AREA = 1 << 18
PAIR_SCHEMA = "a long, b long, key long, sig long, sig2 long, size int"

#: Takes (sig, sig2, size) of the first and of the second documents, gives which pairs to keep; shapes are broadcast.
Keep = Callable[[list[np.ndarray], list[np.ndarray]], np.ndarray]


def pair_runs(doc: np.ndarray, key: np.ndarray, extra: list[np.ndarray], keep: Keep) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs within runs of equal keys that ``keep`` passes, smaller document first."""
    at = np.arange(len(key))
    step = 0
    while len(at):
        step += 1
        at = at[at + step < len(key)]
        at = at[key[at] == key[at + step]]
        to = at + step
        ok = keep([x[at] for x in extra], [x[to] for x in extra]) & (doc[at] != doc[to])
        if ok.any():
            x, y = doc[at[ok]], doc[to[ok]]
            yield np.minimum(x, y), np.maximum(x, y)


def _runs(batches: Iterable[pa.RecordBatch], keep: Keep, hot: int | None) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64()] * 5 + [pa.int32()]
    names = ["a", "b", "key", "sig", "sig2", "size"]

    def found(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), *[pa.nulls(len(a), kind) for kind in kinds[2:]]], names=names)

    def marked(cols: list[np.ndarray]) -> pa.RecordBatch:
        doc, _, *rest = cols
        return pa.RecordBatch.from_arrays([pa.array(doc), pa.nulls(len(doc), pa.int64()), *[pa.array(x) for x in rest]], names=names)

    def finish(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        known = cols[1] < 0
        if known.any():
            yield marked([c[known] for c in cols])
            cols = [c[~known] for c in cols]
        doc, _, key, *extra = cols
        if not len(key):
            return
        if hot:
            start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            length = np.diff(np.r_[start, len(key)])
            crowded = np.repeat(length > hot, length)
            if crowded.any():
                yield marked([c[crowded] for c in cols])
                doc, key, *extra = (x[~crowded] for x in (doc, key, *extra))
        for a, b in pair_runs(doc, key, extra, keep):
            yield found(a, b)

    held: list[np.ndarray] | None = None
    flowing: int | None = None  # key of a run that is known to be hot and flows through
    for rb in batches:
        cols = [rb.column(i).to_numpy(zero_copy_only=False) for i in range(6)]
        if flowing is not None:
            n = int(np.searchsorted(cols[2], flowing, side="right"))
            if n:
                yield marked([c[:n] for c in cols])
                cols = [c[n:] for c in cols]
            if not len(cols[0]):
                continue
            flowing = None
        held = cols if held is None else [np.concatenate(x) for x in zip(held, cols)]
        if len(held[0]) >= CHUNK:
            last = int(np.searchsorted(held[2], held[2][-1], side="left"))
            yield from finish([c[:last] for c in held])
            held = [c[last:] for c in held]
            if hot and len(held[0]) > hot:
                flowing = int(held[2][0])
                yield marked(held)
                held = None
    if held is not None:
        yield from finish(held)


def _pair_blocks(doc: np.ndarray, extra: list[np.ndarray], first: int, keep: Keep) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs that ``keep`` passes of the ``first`` rows with the others, or of all rows if there are no others."""
    own = first == len(doc)
    at = 0
    while at < first:
        low = at + 1 if own else first
        if low == len(doc):
            return
        end = min(first, at + max(1, AREA // (len(doc) - low)))
        ok = keep([x[at:end, None] for x in extra], [x[None, low:] for x in extra]) & (doc[at:end, None] != doc[None, low:])
        i, j = np.nonzero(np.triu(ok) if own else ok)
        if len(i):
            x, y = doc[at + i], doc[low + j]
            yield np.minimum(x, y), np.maximum(x, y)
        at = end


def _blocks(batches: Iterable[pa.RecordBatch], keep: Keep) -> Iterator[pa.RecordBatch]:
    """Pairs of rows (key, i, j, block, doc, sig, sig2, size), sorted by the first four: within each (key, i, j), block i with j."""

    def finish(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        key, i, j, block, doc, *extra = cols
        new = (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
        bounds = np.r_[0, np.flatnonzero(new) + 1, len(key)]
        for s, e in zip(bounds[:-1], bounds[1:]):
            first = int(np.searchsorted(block[s:e], i[s], side="right"))
            if first == e - s and i[s] != j[s]:  # the other block is empty
                continue
            for a, b in _pair_blocks(doc[s:e], [x[s:e] for x in extra], first, keep):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    held: list[np.ndarray] | None = None
    for rb in batches:
        cols = [rb.column(i).to_numpy(zero_copy_only=False) for i in range(8)]
        if not len(cols[0]):
            continue
        held = cols if held is None else [np.concatenate(x) for x in zip(held, cols)]
        other = (held[0] != held[0][-1]) | (held[1] != held[1][-1]) | (held[2] != held[2][-1])
        last = int(np.count_nonzero(other))
        if last:
            yield from finish([c[:last] for c in held])
            held = [c[last:] for c in held]
    if held is not None:
        yield from finish(held)


def crowded_pairs(crowded: DataFrame, keep: Keep) -> DataFrame:
    """(a, b): all pairs of (doc, key, sig, sig2, size) rows of one key that ``keep`` passes, block against block."""
    sizes = crowded.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    blocks = F.ceil(F.col("n") / F.lit(BLOCK)).cast("int")
    rows = join_sized(crowded, sizes, "key", "n", crowded.count()).withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int"))
    # Each block goes to its meeting with every other one, and with itself.
    met = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "doc", "sig", "sig2", "size")
    # A stated number of partitions, or small blocks with much to compare would be merged into one task.
    meetings = sizes.agg(F.sum(blocks.cast("long") * (blocks + 1) / 2)).first()[0] or 0
    n = max(int(crowded.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(int(meetings), 50_000))
    return met.repartition(n, "key", "i", "j").sortWithinPartitions("key", "i", "j", "block").mapInArrow(lambda batches: _blocks(batches, keep), "a long, b long")


#: Documents whose keys are looked at to find crowded buckets beforehand, and salts that spread such a bucket's rows.
LOOK, SALTS = 16_384, 64


def looked_at(documents: DataFrame, doc: str, n: int) -> tuple[DataFrame, float]:
    """(a pseudorandom sample of about LOOK documents, the same in every run, and the share of all ``n`` that it is)."""
    share = min(1.0, LOOK / max(n, 1))
    return documents.where(F.pmod(F.xxhash64(doc, F.lit(1)), F.lit(1 << 30)) < F.lit(max(1, int(share * (1 << 30))))), share


def crowded_keys(index: DataFrame, share: float, hot: int) -> np.ndarray:
    """Keys, ascending, that the index rows of a sample (``share`` of all documents) show to have over ``hot`` rows in all."""
    least = max(8, math.ceil(hot * share)) if share < 1 else hot + 1
    found = index.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("key")
    return np.sort(np.array([r[0] for r in found.collect()], np.int64))  # at most LOOK x parts / 8 keys


def salted_parts(doc: np.ndarray, key: np.ndarray, part: int, crowded: np.ndarray) -> np.ndarray:
    """The part of each index row, or a negative salt for rows of crowded keys."""
    out = np.full(len(key), part, np.int32)
    if len(crowded):
        at = np.minimum(np.searchsorted(crowded, key), len(crowded) - 1)
        hot = crowded[at] == key
        spread = (doc[hot].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
        out[hot] = -1 - (spread % np.uint64(SALTS)).astype(np.int32)
    return out


def bucket_pass(keys: DataFrame, keep: Keep, hot: int | None) -> DataFrame:
    """(a, b, nulls) pairs and, for crowded buckets, (document, null, key, sig, sig2, size) rows."""
    rows = keys.select("doc", "part", "key", "sig", "sig2", "size").repartition("key", "part").sortWithinPartitions("key")
    return rows.mapInArrow(lambda batches: _runs(batches, keep, hot), PAIR_SCHEMA)


def candidate_pairs(keys: DataFrame, keep: Keep, hot: int = 256) -> DataFrame:
    """Distinct (a, b) with a < b that share a bucket and pass ``keep``.

    ``keys`` has the index rows (doc, part, key, sig, sig2, size) of all documents. Documents are 64-bit numbers.
    """
    done = stage(bucket_pass(keys, keep, hot), "buckets")
    pairs = done.where(F.col("b").isNotNull()).select("a", "b")
    crowded = done.where(F.col("b").isNull()).select(F.col("a").alias("doc"), "key", "sig", "sig2", "size")
    if crowded.limit(1).count():
        pairs = pairs.unionByName(crowded_pairs(crowded, keep))
    return pairs.distinct()

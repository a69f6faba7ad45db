"""Mixing sources to target weights by the token.

Each source's documents, in a pseudorandom order, are one stream of tokens cut into blocks of fixed length. The output
is a row of shards of equal size; each shard draws how many of its blocks come from each source by a multinomial law
with the target shares. A source's draws are numbered through all shards; number s stands for the block at place
s mod N of that pass's pseudorandom permutation of the source's N blocks, pass s div N being a repetition. Numbers
beyond the last allowed repetition stay empty and show in the report. Every step is keyed by source and index, so the
selection is the same in every run and no step holds a source's documents in one task.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.staging import stage

#: Fixed value: the split pattern that belongs to the public 50k byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@dataclass(frozen=True)
class MixSpec:
    """``block``: tokens in a block; ``shard``: blocks in an output shard; ``vocabulary``: a tiktoken rank file.

    ``most_sources``: more target sources than that are refused, since their list goes to every task.
    """

    block: int = 1024
    shard: int = 1024
    seed: int = 11
    most_sources: int = 10_000
    vocabulary: str = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def source_name(column: Column) -> Column:
    """Source names are compared trimmed and lower-cased; null is a source of its own ('')."""
    return F.lower(F.trim(F.coalesce(column, F.lit(""))))


def token_counts(docs: DataFrame, spec: MixSpec) -> DataFrame:
    """(doc_id, source, tokens): one row per non-null doc_id; a null text has no tokens, repeated rows count once."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        with open(spec.vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encode = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        for b in batches:
            n = [len(encode(t)) if t else 0 for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64())], names=["doc_id", "source", "tokens"])

    rows = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long"), source_name(F.col("source")).alias("source"), F.col("text").cast("string"))
    counted = rows.mapInArrow(count, "doc_id long, source string, tokens long")
    return counted.groupBy("doc_id").agg(F.min(F.struct("source", "tokens")).alias("s")).select("doc_id", "s.source", "s.tokens")


def mix_plan(counts: DataFrame, targets: DataFrame, spec: MixSpec) -> DataFrame:
    """One row per target source: share, tokens, blocks, capacity and whether the capacity reaches the target.

    The goal is a total as large as all documents together. Null or negative weights and repeats count as 0; a source
    named twice has its weights added and the larger cap. No positive weight: all shares are 0.
    """
    size = counts.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("documents"))
    goal = size.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("goal"))
    wanted = targets.groupBy(source_name(F.col("source")).alias("source")).agg(
        F.sum(F.greatest(F.coalesce(F.nanvl(F.col("target_weight").cast("double"), F.lit(0.0)), F.lit(0.0)), F.lit(0.0))).alias("weight"),
        F.max(F.greatest(F.coalesce(F.col("max_repeats"), F.lit(0)), F.lit(0))).cast("long").alias("max_repeats"),
    )
    total = wanted.agg(F.sum("weight").alias("all_weight"))
    named = wanted.join(size, "source", "left").join(F.broadcast(total), F.lit(True)).join(F.broadcast(goal), F.lit(True))  # two single rows
    share = F.when(F.col("all_weight") > 0, F.col("weight") / F.col("all_weight")).otherwise(0.0)
    tokens = F.coalesce("tokens", F.lit(0))
    return named.select(
        "source", share.alias("share"), "max_repeats", tokens.alias("tokens"), F.coalesce("documents", F.lit(0)).alias("documents"),
        F.ceil(tokens / F.lit(float(spec.block))).cast("long").alias("blocks"), (tokens * F.col("max_repeats")).alias("capacity"), "goal",
        ((tokens * F.col("max_repeats")) >= share * F.col("goal")).alias("reachable"),
    )


def running_total(rows: DataFrame, group: list[str], piece: str, order: list[str], value: str, out: str) -> DataFrame:
    """Sum of ``value`` over the rows before each one within ``group``; ``piece`` (rising with ``order``) splits a
    group so that no task needs more of it than one piece and the pieces' totals."""
    sums = rows.groupBy(*group, piece).agg(F.sum(value).alias("piece_sum"))
    before = sums.withColumn("before", F.coalesce(F.sum("piece_sum").over(Window.partitionBy(*group).orderBy(piece).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("piece_sum")
    local = F.coalesce(F.sum(value).over(Window.partitionBy(*group, piece).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn(out, local).join(before.hint("merge"), [*group, piece]).withColumn(out, F.col(out) + F.col("before")).drop("before", piece)


def block_pieces(counts: DataFrame, plan: DataFrame, spec: MixSpec) -> DataFrame:
    """(source, block, doc_id, tokens): the part of each document that lies in each block of its source."""
    pieces = max(16, counts.count() // 50_000)
    rows = counts.join(F.broadcast(plan.select("source")), "source", "left_semi").where(F.col("tokens") > 0)
    rows = rows.withColumn("draw", F.xxhash64("doc_id", F.lit(spec.seed)))
    rows = rows.withColumn("piece", F.floor((F.shiftrightunsigned("draw", 1) / F.lit(2.0**63)) * pieces).cast("int")).withColumn("draw", F.shiftrightunsigned("draw", 1))
    placed = running_total(rows, ["source"], "piece", ["draw", "doc_id"], "tokens", "begin")
    end = F.col("begin") + F.col("tokens")
    cut = placed.withColumn("end", end).withColumn("block", F.explode(F.sequence(F.floor(F.col("begin") / spec.block), F.floor((F.col("end") - 1) / spec.block))))
    inside = F.least("end", (F.col("block") + 1) * spec.block) - F.greatest("begin", F.col("block") * spec.block)
    return cut.select("source", F.col("block").cast("long"), "doc_id", inside.cast("long").alias("tokens"))


def permute(index: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Place of each index in a pseudorandom permutation of range(size): a balanced Feistel network, walked until in range."""
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(size, 2).astype(np.float64))).astype(np.int64) + 1) // 2).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, todo = index.astype(np.uint64), np.arange(len(index))
    while len(todo):
        h, m, k = half[todo], mask[todo], key[todo].astype(np.uint64)
        left, right = out[todo] >> h, out[todo] & m
        for r in range(4):
            f = (right ^ (k + np.uint64((r * 0x9E3779B97F4A7C15) & (2**64 - 1)))) * np.uint64(0xFF51AFD7ED558CCD)
            f = (f ^ (f >> np.uint64(32))) * np.uint64(0xC4CEB9FE1A85EC53)
            left, right = right, left ^ ((f >> np.uint64(29)) & m)
        out[todo] = (left << h) | right
        todo = todo[out[todo] >= size[todo].astype(np.uint64)]
    return out.astype(np.int64)


DRAW_SCHEMA = "source string, shard long, n long, piece long, first long"


def draw_counts(plan: DataFrame, spec: MixSpec) -> DataFrame:
    """(source, shard, n, piece, first): blocks that each shard draws from each source, and the source's draws before them."""
    spark = plan.sparkSession
    listed = plan.select("source", "share", "goal").collect()  # at most ``most_sources``
    names = sorted(r["source"] for r in listed)
    by = {r["source"]: r for r in listed}
    shares = np.array([by[s]["share"] for s in names], np.float64)
    goal = max((r["goal"] for r in listed), default=0)
    blocks = -(-goal // spec.block)
    shards = -(-blocks // spec.shard)
    if not names or shares.sum() <= 0 or not blocks:
        return spark.createDataFrame([], DRAW_SCHEMA)
    shares = shares / shares.sum()

    def multinomial(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy()
            n = np.minimum(spec.shard, blocks - ids * spec.shard)
            drawn = np.concatenate([np.random.default_rng([spec.seed, int(i)]).multinomial(int(k), shares) for i, k in zip(ids, n)]) if len(ids) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, len(names))), pa.array(names * len(ids), pa.string()), pa.array(drawn.astype(np.int64))], names=["shard", "source", "n"])

    draws = spark.range(shards).mapInArrow(multinomial, "shard long, source string, n long").withColumn("piece", F.floor(F.col("shard") / 4096))
    return running_total(draws.withColumn("own_piece", F.col("piece")), ["source"], "piece", ["shard"], "n", "first").select("source", "shard", "n", F.col("own_piece").alias("piece"), "first").where(F.col("n") > 0)


def draw_slots(numbered: DataFrame, plan: DataFrame, spec: MixSpec) -> DataFrame:
    """(source, shard, number, pass_no, block): every slot of the output (:func:`draw_counts`) that can be filled."""
    info = F.broadcast(plan.select("source", "max_repeats", "blocks"))
    # Whole passes only: numbers from max_repeats * blocks on stay empty.
    last = F.least(F.col("first") + F.col("n"), F.col("max_repeats") * F.col("blocks"))
    slots = numbered.join(info, "source").withColumn("last", last).where(F.col("first") < F.col("last"))
    slots = slots.select("source", "shard", "blocks", F.explode(F.sequence("first", F.col("last") - 1)).alias("number"))
    slots = slots.withColumn("pass_no", F.expr("number div blocks"))

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, number, passes, key = (b.column(i).to_numpy() for i in (2, 3, 4, 5))
            block = permute(number - passes * size, size, key)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), b.column(4), pa.array(block)], names=["source", "shard", "number", "pass_no", "block"])

    keyed = slots.select("source", "shard", "blocks", "number", "pass_no", F.xxhash64("source", "pass_no", F.lit(spec.seed)).alias("key"))
    return keyed.mapInArrow(place, "source string, shard long, number long, pass_no long, block long")


def mix(docs: DataFrame, targets: DataFrame, spec: MixSpec = MixSpec()) -> tuple[DataFrame, DataFrame]:
    """(selection, report).

    selection: (doc_id, source, uses, tokens_used) per selected document: in how many passes it was used (never more
    than the source's max_repeats) and how many of its tokens were taken in all. report: per target source the
    plan, the blocks ``drawn`` and ``filled``, the ``selected`` tokens and their ``actual_share`` of all selected. Empty documents and sources without
    documents are never selected; sources without a target only count towards the goal.
    """
    counts = stage(token_counts(docs, spec), "tokens")
    plan = stage(mix_plan(counts, targets, spec), "plan")
    if plan.limit(spec.most_sources + 1).count() > spec.most_sources:
        raise ValueError(f"more than {spec.most_sources} target sources")
    pieces = stage(block_pieces(counts, plan, spec), "pieces")
    drawn = stage(draw_counts(plan, spec), "draws")
    slots = stage(draw_slots(drawn, plan, spec), "slots")
    used = slots.groupBy("source", "block").agg(F.count(F.lit(1)).alias("uses"))
    selection = (
        pieces.join(used.hint("merge"), ["source", "block"])
        .groupBy("doc_id", "source")
        .agg(F.max("uses").alias("uses"), F.sum(F.col("tokens") * F.col("uses")).alias("tokens_used"))
    )
    got = selection.groupBy("source").agg(F.sum("tokens_used").alias("selected"))
    total = got.agg(F.sum("selected").alias("all_selected"))
    asked = drawn.groupBy("source").agg(F.sum("n").alias("drawn"))
    filled = slots.groupBy("source").agg(F.count(F.lit(1)).alias("filled"))
    report = plan.join(got, "source", "left").join(asked, "source", "left").join(filled, "source", "left").join(F.broadcast(total), F.lit(True))  # a single row
    selected = F.coalesce("selected", F.lit(0))
    report = report.select(*plan.columns, F.coalesce("drawn", F.lit(0)).alias("drawn"), F.coalesce("filled", F.lit(0)).alias("filled"), selected.alias("selected"), F.when(F.col("all_selected") > 0, selected / F.col("all_selected")).otherwise(0.0).alias("actual_share"))
    return selection, report


def short_sources(report: DataFrame, deviations: float = 6.0) -> DataFrame:
    """The rows of the report of sources that can't reach their share, found by the draw: either blocks that it asked for
    stayed empty, or so few were left that chance alone may have kept them from running out (``deviations`` of the
    draw's spread). Those are then settled by the capacity in tokens."""
    room = F.col("max_repeats") * F.col("blocks") - F.col("drawn")
    doubtful = (F.col("filled") < F.col("drawn")) | (room <= deviations * F.sqrt(F.col("drawn") + 1.0) + deviations * deviations)
    return report.where(doubtful & ~F.col("reachable"))

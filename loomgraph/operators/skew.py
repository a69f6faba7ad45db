"""Per-key aggregation when a few keys hold most of the rows: two-stage salted aggregation.

Stage 1 appends a salt to heavy keys and computes partial results per (key, salt); stage 2 merges the partials by
the original key. The salt is a hash of a second column rather than a draw: rows that share that column share the
salt, so distinct counts over it add up across salts, and a task that is run again after a lost executor gives the
same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.session import free_name


def key_counts(df: DataFrame, key: str) -> DataFrame:
    """(key, n): rows per key. Partial counts are made before the shuffle, so skew costs nothing here."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def heavy_keys(df: DataFrame, key: str, total: int, min_share: float) -> DataFrame:
    """Keys holding at least ``min_share`` of ``total`` rows; never more than 1/min_share rows."""
    return key_counts(df, key).where(F.col("n") >= F.lit(total * min_share))


def salted(df: DataFrame, key: str, by: Column, total: int, min_share: float = 0.002, salts: int = 64) -> tuple[DataFrame, str]:
    """``df`` with a salt column: 0 for ordinary keys, 0..salts-1 by the hash of ``by`` for heavy ones.

    The heavy keys are broadcast: there are at most 1/min_share of them whatever the size of the data. Null keys
    are ordinary. Returns the frame and the salt column's name (chosen so that it clashes with no column).
    """
    salt, mark = free_name(df, "salt"), free_name(df, "heavy_mark")
    heavy = heavy_keys(df, key, total, min_share).select(F.col(key), F.lit(True).alias(mark))
    out = df.join(F.broadcast(heavy), key, "left")
    return out.withColumn(salt, F.when(F.col(mark), F.pmod(F.xxhash64(by), F.lit(salts))).otherwise(0).cast("int")).drop(mark), salt


def two_stage(df: DataFrame, key: str, salt: str, partial: dict[str, Column], merge: dict[str, Column]) -> DataFrame:
    """``partial`` aggregates per (key, salt), then ``merge`` aggregates of those columns per key."""
    first = df.groupBy(key, salt).agg(*[c.alias(n) for n, c in partial.items()])
    return first.groupBy(key).agg(*[c.alias(n) for n, c in merge.items()])


def join_sized(left: DataFrame, right: DataFrame, key: str, size: str, total: int, rows: int = 200_000, share: float = 0.002) -> DataFrame:
    """Inner join on ``key`` where ``size`` of ``right`` says how many rows of ``left`` have the key.

    Keys with more than ``rows`` rows and more than ``share`` of ``total`` are few (at most 1/share) and are joined by
    broadcast, so their rows stay where they are; all others are joined as usual.
    """
    least = max(rows, int(total * share))
    if total <= least:
        return left.join(right, key)
    big = F.broadcast(right.where(F.col(size) > least))
    rest = left.join(F.broadcast(right.where(F.col(size) > least).select(key)), key, "left_anti")
    return left.join(big, key).unionByName(rest.join(right.where(F.col(size) <= least), key))

"""Orphan references: child rows whose foreign key names no usable parent row.

Plan: the distinct non-null foreign keys (with the earliest time each is used) go through one left anti join
against the parent keys; only the orphan keys are joined back to the child rows. The child table is never joined
to the parent table as a whole, and keys that hold many child rows are spread over salts for the join back.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.ids import clean_id, utc_month

#: A key gets one more salt for each such share of all references; at most 1/SHARE extra salts exist in total.
SALT_SHARE = 0.002
SALT_ROWS = 200_000


@dataclass(frozen=True)
class ForeignKey:
    """``column`` of the child table refers to the parents' ids; ``side`` names it in reports."""

    column: str
    side: str


def current_parents(nodes: DataFrame) -> DataFrame:
    """(id, archived, valid_from): the current row of each cleaned id.

    The row with the latest ``last_accessed_at`` is current (null counts as earliest; equal times are broken by
    archived over live, then the later creation). Null ``is_archived`` counts as false. A null ``created_at``
    means the node exists at any time. Blank and null ids name no parent.
    """
    state = F.struct(
        F.col("last_accessed_at").alias("seen"),
        F.coalesce(F.col("is_archived"), F.lit(False)).alias("archived"),
        F.col("created_at").alias("born"),
    )
    return (
        nodes.select(clean_id(F.col("id")).alias("id"), state.alias("state"))
        .where(F.col("id") != "")
        .groupBy("id")
        .agg(F.max("state").alias("state"))
        .select("id", F.col("state.archived").alias("archived"), F.col("state.born").alias("valid_from"))
    )


def references(child: DataFrame, keys: list[ForeignKey], at: str, keep: list[Column] | None = None) -> DataFrame:
    """One row per non-blank reference of ``child``: (ref_key, side, ref_at, *keep). One scan serves all keys."""
    sides = F.array(*[F.struct(F.lit(k.side).alias("side"), clean_id(F.col(k.column)).alias("ref_key")) for k in keys])
    return (
        child.select(F.explode(sides).alias("ref"), F.col(at).cast("timestamp").alias("ref_at"), *(keep or []))
        .select("ref.side", "ref.ref_key", "ref_at", *[F.col(n) for n in _names(child, keep)])
        .where(F.col("ref_key") != "")
    )


def _names(child: DataFrame, keep: list[Column] | None) -> list[str]:
    return child.select(*keep).columns if keep else []


def find_orphans(refs: DataFrame, parents: DataFrame, n_refs: int) -> DataFrame:
    """The rows of ``refs`` that are orphans, with ``reason`` missing, archived or not_yet_created.

    ``refs`` has ref_key, ref_at; ``parents`` is the result of :func:`current_parents`; ``n_refs`` is an upper bound
    on the number of references (a metadata count), used to size salts. A reference without a time is never
    not_yet_created. Empty inputs give empty results; with no parents every reference is missing. Repeated child
    rows stay repeated.
    """
    keys = refs.groupBy("ref_key").agg(F.min("ref_at").alias("first_at"), F.count(F.lit(1)).alias("n"))
    live = parents.where(~F.col("archived")).select(F.col("id").alias("live_id"), F.col("valid_from").alias("live_from"))
    usable = F.col("live_from").isNull() | F.col("first_at").isNull() | (F.col("first_at") >= F.col("live_from"))
    orphan_keys = keys.join(live, (F.col("ref_key") == F.col("live_id")) & usable, "left_anti")
    per_salt = max(SALT_ROWS, int(n_refs * SALT_SHARE))
    known = orphan_keys.join(parents.withColumnRenamed("id", "ref_key"), "ref_key", "left").select(
        "ref_key",
        F.when(F.col("archived").isNull(), "missing").when(F.col("archived"), "archived").otherwise("not_yet_created").alias("reason"),
        F.when(~F.col("archived"), F.col("valid_from")).alias("valid_from"),
        F.ceil(F.col("n") / F.lit(float(per_salt))).cast("int").alias("salts"),
    )
    if n_refs <= per_salt:  # no key can be that large
        return _join_back(refs, known, ["ref_key"])
    # The salt is a running number, so equal rows part as well; every salt has its key on the other side, and a scan
    # that is read again numbers its rows alike. Keys above per_salt number at most 1/SALT_SHARE by counting, so this side may be broadcast.
    heavy = orphan_keys.where(F.col("n") > per_salt).select("ref_key", F.ceil(F.col("n") / F.lit(float(per_salt))).cast("int").alias("heavy_salts"))
    salted = refs.join(F.broadcast(heavy), "ref_key", "left").withColumn(
        "salt", F.when(F.col("heavy_salts").isNull(), 0).otherwise(F.pmod(F.monotonically_increasing_id(), F.col("heavy_salts"))).cast("int")
    ).drop("heavy_salts")
    spread = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    return _join_back(salted, spread, ["ref_key", "salt"]).drop("salt")


def _join_back(refs: DataFrame, known: DataFrame, on: list[str]) -> DataFrame:
    joined = refs.join(known.drop("salts"), on)
    return joined.where((F.col("reason") != "not_yet_created") | (F.col("ref_at") < F.col("valid_from"))).drop("valid_from")


def orphan_report(orphans: DataFrame, table_name: str) -> DataFrame:
    """Counts per table, side, month and reason: orphan references and distinct orphan keys."""
    per_key = orphans.groupBy("side", utc_month(F.col("ref_at")).alias("month"), "reason", "ref_key").agg(F.count(F.lit(1)).alias("n"))
    return (
        per_key.groupBy("side", "month", "reason")
        .agg(F.sum("n").alias("n_refs"), F.count(F.lit(1)).alias("n_keys"))
        .select(F.lit(table_name).alias("table_name"), "side", "month", "reason", "n_refs", "n_keys")
    )


EDGE_KEYS = [ForeignKey("source_id", "source"), ForeignKey("target_id", "target")]


def edge_orphans(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Orphan references of the edge table with the edge's own cleaned endpoints and relation type."""
    keep = [clean_id(F.col("source_id")).alias("source_id"), clean_id(F.col("target_id")).alias("target_id"), F.col("relation_type")]
    refs = references(edges, EDGE_KEYS, "created_at", keep)
    return find_orphans(refs, current_parents(nodes), 2 * edges.count())

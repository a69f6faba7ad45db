"""Forgetting: exponential decay of stability, archiving, protection by anchors and importance, pruning of edges."""

from __future__ import annotations

import math
from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.config import DecayConfig, ScopedDecay

#: Kinds and wordings of transient nodes.
TRANSIENT_TYPES = ("sensory_fact", "telemetry", "telemetry_chunk", "telemetry_rule", "episodic_event", "noise")
TRANSIENT_WORDS = "transient|noise|jitter"
SCOPED_EDGE_THRESHOLD = 0.05


def idle_seconds(now: Column) -> Column:
    last = F.greatest("last_accessed_at", "last_reinforced_at")
    return F.greatest(F.lit(0.0), F.coalesce((F.unix_micros(now) - F.unix_micros(last)) / 1e6, F.lit(0.0)))


def decayed(stability: Column, idle: Column, half_life: timedelta) -> Column:
    return stability * F.exp(F.lit(-math.log(2) / half_life.total_seconds()) * idle)


def periodic(nodes: DataFrame, now: Column, cfg: DecayConfig = DecayConfig()) -> DataFrame:
    """One decay cycle. Stability is overwritten and the last use isn't, so cycles compound; anchors protect nothing."""
    live = ~F.col("is_archived")
    idle = idle_seconds(now)
    new = F.when(live, decayed(F.col("stability_score"), idle, cfg.half_life)).otherwise(F.col("stability_score"))
    gone = live & (new < cfg.archive_below) & (idle >= cfg.grace.total_seconds())
    return nodes.select("*", new.alias("_s"), gone.alias("_gone")).withColumn("stability_score", F.col("_s")).withColumn("archived_at", F.when(F.col("_gone"), now).otherwise(F.col("archived_at"))).withColumn("is_archived", F.col("is_archived") | F.col("_gone")).drop("_s", "_gone")


def prune_edges(edges: DataFrame, archived: DataFrame, below: float = 0.05) -> DataFrame:
    """Edges of at least the weight whose endpoints are both not among ``archived`` (id)."""
    out = edges.where(F.col("weight") >= below)
    for side in ("source_id", "target_id"):
        out = out.join(archived.select(F.col("id").alias(side)).distinct(), side, "left_anti")
    return out.select(edges.columns)


def session_nodes(rows: DataFrame) -> DataFrame:
    """(id): nodes that the traces of a session gave, from their goals, steps and chunks (id)."""
    return rows.select("id").distinct()


def scoped(nodes: DataFrame, anchors: DataFrame, now: Column, req: ScopedDecay, of_session: DataFrame | None = None) -> DataFrame:
    """``nodes`` with ``action``: protected, out_of_scope, archived or decayed, and the new stability.

    Archived nodes get inactive. Nodes with an anchor or enough importance are protected whatever the scope; an
    unknown scope means all; a session scope with an empty session id takes in every node.
    """
    threshold = req.min_importance if req.threshold is None else req.threshold
    counts = anchors.where(F.col("node_id").isNotNull()).groupBy(F.col("node_id").alias("id")).agg(F.count(F.lit(1)).alias("_anchors"))
    j = nodes.join(counts, "id", "left")
    scope: Column = F.lit(True)
    if req.scope == "transient":
        scope = (F.col("importance_score") <= 0.5) | F.col("entity_type").isin(*TRANSIENT_TYPES) | F.lower("label").rlike(TRANSIENT_WORDS)
    elif req.scope == "session":
        mentions = F.coalesce(F.col("summary").contains(req.session_id), F.lit(False)) | F.coalesce(F.col("label").contains(req.session_id), F.lit(False))
        if of_session is not None:
            j = j.join(of_session.select("id", F.lit(True).alias("_mine")).distinct(), "id", "left")
            mentions = mentions | F.coalesce("_mine", F.lit(False))
        scope = mentions
    idle = idle_seconds(now)
    new = decayed(F.col("stability_score"), idle, req.half_life)
    gone = (idle >= req.grace.total_seconds()) & ((new < threshold) | (F.col("importance_score") < threshold))
    protected = (F.coalesce("_anchors", F.lit(0)) > 0) | (F.col("importance_score") >= req.min_importance)
    action = F.when(F.col("is_archived"), "inactive").when(protected, "protected").when(~F.coalesce(scope, F.lit(False)), "out_of_scope").when(gone, "archived").otherwise("decayed")
    touched = action.isin("archived", "decayed")
    return j.select(*nodes.columns, action.alias("action"), F.when(touched, new).otherwise(F.col("stability_score")).alias("new_stability"))


def apply_scoped(marked: DataFrame, now: Column) -> DataFrame:
    """The node table after a scoped decay."""
    columns = [c for c in marked.columns if c not in ("action", "new_stability")]
    gone = F.col("action") == "archived"
    return marked.withColumn("stability_score", F.col("new_stability")).withColumn("archived_at", F.when(gone, now).otherwise(F.col("archived_at"))).withColumn("is_archived", F.col("is_archived") | gone).select(columns)


def tally(marked: DataFrame) -> DataFrame:
    return marked.groupBy("action").agg(F.count(F.lit(1)).alias("n_nodes"))

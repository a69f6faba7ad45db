"""Fusing extracted entities and relations into the graph.

Read in order, a trace's entity either repeats one of its own, matches a stored node, or is new. Said of sets: per
(natural key, trace) one row holds the first occurrence and the sums of the others; per key one row holds the earliest
trace and the sums over traces. No window runs over a key, so a concept that every trace names costs what partial
aggregation leaves of it.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.config import FusionConfig
from loomgraph.operators.extract import Extraction
from loomgraph.operators.graph import EDGE_KEY, NODE_COLUMNS, best_match, boost_stability, reinforce_edges
from loomgraph.session import cut


class Fused:
    """What fusion leaves. The mapping of ids, and the edges and anchors that need it, are made when they are asked for."""

    def __init__(self, nodes: DataFrame, created: DataFrame, updated: DataFrame, canonical: DataFrame, edges: Callable[[DataFrame], DataFrame], anchors: Callable[[DataFrame], DataFrame]) -> None:
        self.nodes = nodes
        self.created, self.updated = created, updated  # id of new nodes, of boosted stored nodes
        self._canonical, self._edges, self._anchors = canonical, edges, anchors

    @functools.cached_property
    def canonical(self) -> DataFrame:
        """(trace_id, id, canonical_id)"""
        return cut(self._canonical, "canonical")

    @property
    def edges(self) -> DataFrame:
        return self._edges(self.canonical)

    @property
    def anchors(self) -> DataFrame:
        """(node_id, anchor_tag, created_at): each trace's tags on all nodes that it names"""
        return self._anchors(self.canonical)


def _key(df: DataFrame) -> DataFrame:
    return df.withColumn("k_label", F.lower(F.trim("label"))).withColumn("k_type", F.lower(F.trim("entity_type")))


def fuse(nodes: DataFrame, edges: DataFrame, found: Extraction, cfg: FusionConfig = FusionConfig()) -> Fused:
    """Nodes and edges after the traces, each taken at its own time, in the order of their times.

    A stored match is boosted once by every trace that names it; a new node starts from its first occurrence, gains
    from repetitions within that trace (which may raise its importance) and once from every later trace. Importance
    of stored nodes stays. Relations reinforce edges between canonical ids; self-loops are left out. Every node that
    an anchored trace names gets the trace's anchors.
    """
    keys = ["k_label", "k_type"]
    e = cut(_key(found.entities), "entities")
    order = F.struct("section", "o1", "o2")
    per_trace = e.groupBy(*keys, "trace_id").agg(
        F.min("at").alias("at"), F.min_by(F.struct("id", "label", "entity_type", "summary", "salience", "importance", "is_secret"), order).alias("first"),
        F.sum("salience").alias("all_salience"), F.count(F.lit(1)).alias("rows"), F.max("importance").alias("top_importance"),
    )
    when = F.struct("at", "trace_id")
    per_key = per_trace.groupBy(*keys).agg(
        F.min_by(F.struct("first", "all_salience", "rows", "top_importance", "at"), when).alias("c"), F.sum("first.salience").alias("firsts"), F.count(F.lit(1)).alias("traces"), F.max("at").alias("last_at"),
    )
    matched = best_match(nodes, per_key.select(F.col("c.first.label").alias("label"), F.col("c.first.entity_type").alias("entity_type"), "c", "firsts", "traces", "last_at", *keys))
    matched = cut(matched)
    stored = matched.where(F.col("match_id").isNotNull())
    fresh = matched.where(F.col("match_id").isNull())
    # One boost row per node stands for the sum of its traces' boosts.
    gains = stored.groupBy("match_id").agg(F.sum("firsts").alias("salience"), F.sum("traces").alias("n"), F.max("last_at").alias("at"))
    boosted = boost_stability(nodes, gains.select(F.col("match_id").alias("id"), (F.col("salience") * cfg.rate).alias("delta"), "at"))
    boosted = boosted.join(gains.select(F.col("match_id").alias("id"), (F.col("n") - 1).alias("_more")), "id", "left").withColumn("access_count", F.col("access_count") + F.coalesce("_more", F.lit(0))).drop("_more")
    start = F.least(F.lit(1.0), F.when(F.col("c.first.importance") > 0, F.col("c.first.importance")).otherwise(0.5 + 0.5 * F.col("c.first.salience")))
    repeats = F.col("c.all_salience") - F.col("c.first.salience")
    later = F.col("firsts") - F.col("c.first.salience")
    moved = F.when((F.col("traces") > 1), F.col("last_at"))
    new = fresh.select(
        F.col("c.first.id").alias("id"), F.col("c.first.entity_type").alias("entity_type"), F.col("c.first.label").alias("label"), F.col("c.first.summary").alias("summary"), F.lit(None).cast("array<float>").alias("embedding"),
        F.col("c.at").alias("created_at"), F.coalesce(moved, F.col("c.at")).alias("last_accessed_at"), F.coalesce(moved, F.col("c.at")).alias("last_reinforced_at"), F.lit(None).cast("timestamp").alias("archived_at"),
        (1 + (F.col("c.rows") - 1) + (F.col("traces") - 1)).cast("long").alias("access_count"), F.least(F.lit(1.0), start + cfg.rate * (repeats + later)).alias("stability_score"),
        F.col("c.top_importance").alias("importance_score"), F.lit(False).alias("is_archived"), F.col("c.first.is_secret").alias("is_secret"),
    )
    # A new node whose hash names an archived one takes its place but keeps its age and count.
    known = boosted.select("id", F.col("created_at").alias("old_created"), F.col("access_count").alias("old_count"), F.col("importance_score").alias("old_importance"), F.col("embedding").alias("old_vector"))
    one = new.groupBy("id").agg(F.min_by(F.struct(*[c for c in NODE_COLUMNS if c != "id"]), F.struct("created_at", "label")).alias("s")).select("id", "s.*")
    merged = one.join(known, "id", "left").select(
        "id", *[c for c in NODE_COLUMNS if c not in ("id", "created_at", "access_count", "importance_score", "embedding")],
        F.coalesce("old_created", "created_at").alias("created_at"), F.coalesce("old_count", "access_count").alias("access_count"), F.greatest("importance_score", "old_importance").alias("importance_score"), F.coalesce("embedding", "old_vector").alias("embedding"),
    )
    all_nodes = boosted.join(one.select("id"), "id", "left_anti").select(NODE_COLUMNS).unionByName(merged.select(NODE_COLUMNS))
    mapping = e.select("trace_id", "id", *keys).distinct().join(matched.select(*keys, F.coalesce("match_id", "c.first.id").alias("canonical_id")), keys)
    mapping = mapping.groupBy("trace_id", "id").agg(F.min("canonical_id").alias("canonical_id"))
    goals = e.where(F.col("section") == 0)

    def new_edges(canonical: DataFrame) -> DataFrame:
        r = found.relations.join(goals.groupBy("trace_id").agg(F.max("salience").alias("trace_salience")), "trace_id")
        for side in ("source_id", "target_id"):
            names = canonical.select("trace_id", F.col("id").alias(side), F.col("canonical_id").alias(f"c_{side}"))
            r = r.join(names, ["trace_id", side], "left").withColumn(side, F.coalesce(f"c_{side}", side)).drop(f"c_{side}")
        deltas = r.where(F.col("source_id") != F.col("target_id")).select(*EDGE_KEY, (cfg.rate * F.col("weight") * F.col("trace_salience")).alias("delta"), "at")
        return reinforce_edges(edges, deltas, cfg.max_weight)

    def tagged(canonical: DataFrame) -> DataFrame:
        named = found.anchors.join(canonical.select("trace_id", F.col("canonical_id").alias("node_id")).distinct(), "trace_id")
        return named.join(goals.select("trace_id", F.col("at").alias("created_at")), "trace_id").groupBy("node_id", "anchor_tag").agg(F.min("created_at").alias("created_at"))

    return Fused(all_nodes, one.select("id"), stored.select(F.col("match_id").alias("id")).distinct(), mapping, new_edges, tagged)

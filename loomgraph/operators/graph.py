"""Reads and upserts of the graph tables: nodes, edges, anchors, traces.

Every upsert is one aggregation over stored and incoming rows together (stored rows first), never a join: rows of a
key meet once, in one shuffle, with partial aggregation before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.text import content_id, normal_anchor

NODE_COLUMNS = ["id", "entity_type", "label", "summary", "embedding", "created_at", "last_accessed_at", "last_reinforced_at", "archived_at", "access_count", "stability_score", "importance_score", "is_archived", "is_secret"]


def with_defaults(df: DataFrame, columns: dict[str, tuple[str, object]]) -> DataFrame:
    """``df`` with missing columns added and nulls replaced: name to (type, default)."""
    for name, (kind, value) in columns.items():
        base = F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)
        df = df.withColumn(name, base if value is None else F.coalesce(base, F.lit(value).cast(kind)))
    return df


NODE_DEFAULTS = {"access_count": ("bigint", 0), "stability_score": ("double", 1.0), "importance_score": ("double", 0.5), "is_archived": ("boolean", False), "is_secret": ("boolean", False), "archived_at": ("timestamp", None), "last_reinforced_at": ("timestamp", None)}


def current_nodes(nodes: DataFrame) -> DataFrame:
    """The row of each id with the latest ``last_accessed_at`` (then the higher counters)."""
    newest = Window.partitionBy("id").orderBy(F.desc_nulls_last("last_accessed_at"), F.desc_nulls_last("access_count"), F.desc_nulls_last("stability_score"))
    return nodes.where(F.col("id").isNotNull()).withColumn("_rn", F.row_number().over(newest)).where(F.col("_rn") == 1).drop("_rn")


def anchors_by_node(anchors: DataFrame) -> DataFrame:
    """(node_id, anchors): the distinct normalised tags of each node in ascending order."""
    clean = anchors.select("node_id", normal_anchor(F.col("anchor_tag")).alias("tag")).where((F.col("tag") != "") & F.col("node_id").isNotNull())
    return clean.groupBy("node_id").agg(F.sort_array(F.collect_set("tag")).alias("anchors"))


def nodes_for_anchors(anchors: DataFrame, tags: list[str]) -> DataFrame:
    """(node_id): nodes with any of the tags."""
    wanted = sorted({t if t.startswith("#") else "#" + t for t in (x.strip().lower() for x in tags) if t not in ("", "#")})
    return anchors.where(normal_anchor(F.col("anchor_tag")).isin(wanted)).select("node_id").distinct()


def active_headers(nodes: DataFrame, anchors: DataFrame, unique: bool = False) -> DataFrame:
    """Slim rows of the active nodes for indexing, with anchors and the vector's length.

    ``unique``: there is one row for each id already."""
    slim = nodes.select("id", "entity_type", "label", "summary", "embedding", "last_accessed_at", "access_count", "stability_score", "importance_score", "is_archived", "is_secret")
    slim = slim if unique else current_nodes(slim)
    norm = F.sqrt(F.aggregate(F.coalesce("embedding", F.array().cast("array<float>")), F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    joined = slim.where(~F.col("is_archived")).join(anchors_by_node(anchors).withColumnRenamed("node_id", "id"), "id", "left")
    return joined.withColumn("magnitude", norm).withColumn("anchors", F.coalesce("anchors", F.array().cast("array<string>"))).drop("is_archived")


def active_nodes(nodes: DataFrame, anchors: DataFrame) -> DataFrame:
    """All columns of the active nodes, with their anchors."""
    return with_anchors(current_nodes(nodes).where(~F.coalesce("is_archived", F.lit(False))), anchors)


def with_anchors(nodes: DataFrame, anchors: DataFrame) -> DataFrame:
    """``nodes`` with ``anchors``: normalised tags in ascending order, empty without any."""
    joined = nodes.join(anchors_by_node(anchors).withColumnRenamed("node_id", "id"), "id", "left")
    return joined.withColumn("anchors", F.coalesce("anchors", F.array().cast("array<string>")))


def get_nodes(nodes: DataFrame, anchors: DataFrame, ids: DataFrame) -> DataFrame:
    """The current rows, archived ones too, of the ids (id), with anchors; unknown ids give no rows."""
    wanted = ids.select("id").distinct()
    mine = anchors.join(wanted.withColumnRenamed("id", "node_id"), "node_id", "left_semi")
    return with_anchors(current_nodes(nodes.join(wanted, "id", "left_semi")), mine)


def get_node(nodes: DataFrame, anchors: DataFrame, node_id: str) -> DataFrame:
    """The current row of one id, or no row: filters that reach the scans, and no join of whole tables."""
    return with_anchors(current_nodes(nodes.where(F.col("id") == node_id)), anchors.where(F.col("node_id") == node_id))


def incident_edges(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with an endpoint among ``ids`` (id), each row once: two equi-joins, not one on a disjunction."""
    marked = edges.join(ids.select(F.col("id").alias("source_id"), F.lit(True).alias("_s")).distinct(), "source_id", "left").join(
        ids.select(F.col("id").alias("target_id"), F.lit(True).alias("_t")).distinct(), "target_id", "left"
    )
    return marked.where(F.col("_s") | F.col("_t")).select(edges.columns)


def best_match(nodes: DataFrame, probes: DataFrame) -> DataFrame:
    """``probes`` (label, entity_type) with match_id: the active node of the same trimmed, case-blind label and type with
    the highest stability (then the lowest id). Blank labels match nothing; a null type matches any type."""
    key = F.lower(F.trim(F.col("label")))
    live = nodes.where(~F.col("is_archived") & (key != "")).select(key.alias("k"), F.col("entity_type").alias("t"), F.struct((-F.col("stability_score")).alias("s"), F.col("id").alias("id")).alias("rank"))
    typed = live.groupBy("k", "t").agg(F.min("rank").alias("rank"))
    anyway = typed.groupBy("k").agg(F.min("rank").alias("any_rank"))
    p = probes.withColumn("k", F.lower(F.trim(F.col("label"))))
    found = p.join(typed.withColumnRenamed("t", "entity_type"), ["k", "entity_type"], "left").join(anyway, "k", "left")
    return found.select(*[F.col(c) for c in probes.columns], F.when(F.col("entity_type").isNull(), F.col("any_rank.id")).otherwise(F.col("rank.id")).alias("match_id"))


def _last(name: str, order: Column) -> Column:
    return F.max_by(F.col(name), order)


def _last_known(name: str, order: Column) -> Column:
    return F.max_by(F.col(name), F.when(F.col(name).isNotNull(), order))


def upsert_nodes(stored: DataFrame, incoming: DataFrame, order: str = "last_accessed_at") -> DataFrame:
    """Stored nodes with the incoming ones merged in, in the order of ``order``.

    New state wins, but vector and reinforcement time fall back to what is known, importance never falls, and
    creation time and access count stay those of the first row. Empty ids are skipped; a stability or importance
    that isn't positive becomes 1 or 0.5.
    """
    new = incoming.where(F.coalesce("id", F.lit("")) != "")
    new = new.withColumn("stability_score", F.when(F.col("stability_score") > 0, F.col("stability_score")).otherwise(1.0)).withColumn("importance_score", F.when(F.col("importance_score") > 0, F.col("importance_score")).otherwise(0.5))
    both = stored.select("*", F.lit(0).alias("_new")).unionByName(new.select("*", F.lit(1).alias("_new")))
    o = F.struct("_new", order, "access_count", "stability_score")
    latest = ["entity_type", "label", "summary", "stability_score", "last_accessed_at", "archived_at", "is_archived", "is_secret"]
    merged = both.groupBy("id").agg(
        *[_last(c, o).alias(c) for c in latest],
        *[_last_known(c, o).alias(c) for c in ("embedding", "last_reinforced_at")],
        F.max("importance_score").alias("importance_score"),
        *[F.min_by(F.col(c), o).alias(c) for c in ("created_at", "access_count")],
    )
    return merged.select(NODE_COLUMNS)


EDGE_KEY = ["source_id", "target_id", "relation_type"]


def clean_edges(edges: DataFrame) -> DataFrame:
    """Insertable edges: both endpoints given, a default relation, a positive weight (1 otherwise)."""
    kept = edges.where((F.coalesce("source_id", F.lit("")) != "") & (F.coalesce("target_id", F.lit("")) != ""))
    relation = F.when(F.coalesce("relation_type", F.lit("")) == "", "relates_to").otherwise(F.col("relation_type"))
    return kept.withColumn("relation_type", relation).withColumn("weight", F.when(F.col("weight") > 0, F.col("weight")).otherwise(1.0))


def upsert_edges(stored: DataFrame, incoming: DataFrame, order: str = "created_at") -> DataFrame:
    """One row per (source, target, relation): the last weight and creation time, the last known reinforcement."""
    both = stored.select("*", F.lit(0).alias("_new")).unionByName(clean_edges(incoming).select("*", F.lit(1).alias("_new")))
    o = F.struct("_new", order, "weight")
    return both.groupBy(*EDGE_KEY).agg(_last("weight", o).alias("weight"), _last("created_at", o).alias("created_at"), _last_known("last_reinforced_at", o).alias("last_reinforced_at"))


def attach_anchors(stored: DataFrame, incoming: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node_id, anchor_tag, created_at): normalised pairs of existing nodes, each with its earliest time."""
    both = stored.unionByName(incoming).select("node_id", normal_anchor(F.col("anchor_tag")).alias("anchor_tag"), "created_at").where(F.col("anchor_tag") != "")
    pairs = both.groupBy("node_id", "anchor_tag").agg(F.min("created_at").alias("created_at"))
    return pairs.join(nodes.select(F.col("id").alias("node_id")).distinct(), "node_id", "left_semi")


def record_access(nodes: DataFrame, hits: DataFrame, at: Column) -> DataFrame:
    """``nodes`` with one access more for each row of ``hits`` (id)."""
    counts = hits.groupBy("id").agg(F.count(F.lit(1)).alias("_hits"))
    joined = nodes.join(counts, "id", "left")
    hit = F.col("_hits").isNotNull()
    return joined.withColumn("access_count", F.col("access_count") + F.coalesce("_hits", F.lit(0))).withColumn("last_accessed_at", F.when(hit, at).otherwise(F.col("last_accessed_at"))).select(nodes.columns)


def reinforce_edges(edges: DataFrame, deltas: DataFrame, max_weight: float = 5.0) -> DataFrame:
    """``edges`` with the deltas (key, delta, at) added: new edges start at 1, no weight exceeds ``max_weight``.

    The steps' caps commute with addition of non-negative deltas, so one sum per key replaces them.
    """
    cap = max_weight if max_weight > 0 else 5.0
    add = deltas.where((F.coalesce("source_id", F.lit("")) != "") & (F.coalesce("target_id", F.lit("")) != "")).groupBy(*EDGE_KEY).agg(F.sum("delta").alias("_d"), F.max("at").alias("_at"))
    both = edges.withColumn("_old", F.lit(True)).join(add, EDGE_KEY, "full_outer")
    weight = F.when(F.col("_d").isNull(), F.col("weight")).otherwise(F.least(F.lit(cap), F.coalesce("weight", F.lit(1.0)) + F.col("_d")))
    return both.select(*EDGE_KEY, weight.alias("weight"), F.coalesce("created_at", "_at").alias("created_at"), F.coalesce("_at", "last_reinforced_at").alias("last_reinforced_at"))


def boost_stability(nodes: DataFrame, boosts: DataFrame) -> DataFrame:
    """``nodes`` with the boosts (id, delta, at) applied: stability up to 1, accesses counted, archived nodes revived."""
    add = boosts.groupBy("id").agg(F.sum("delta").alias("_d"), F.count(F.lit(1)).alias("_n"), F.max("at").alias("_at"))
    j = nodes.join(add, "id", "left")
    hit = F.col("_n").isNotNull()
    out = (
        j.withColumn("stability_score", F.when(hit, F.least(F.lit(1.0), F.col("stability_score") + F.col("_d"))).otherwise(F.col("stability_score")))
        .withColumn("access_count", F.col("access_count") + F.coalesce("_n", F.lit(0)))
        .withColumn("is_archived", F.when(hit, False).otherwise(F.col("is_archived")))
        .withColumn("archived_at", F.when(~hit, F.col("archived_at")))
    )
    for c in ("last_accessed_at", "last_reinforced_at"):
        out = out.withColumn(c, F.when(hit, F.col("_at")).otherwise(F.col(c)))
    return out.select(nodes.columns)


def queue_traces(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Traces by id: goal, outcome and payload of the last row; session, creation time and state of the first.

    Of rows of one time the consolidated ones count as first. An incoming trace without an id gets one from its
    content, so a trace that is sent again is the same one; stored rows without an id are left out.
    """
    seed = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("session_id", "task_goal", "trace_payload", "created_at")])
    incoming = incoming.withColumn("id", F.when(F.trim(F.coalesce("id", F.lit(""))) == "", content_id("trace", seed)).otherwise(F.col("id")))
    outcome = F.when(F.coalesce("outcome", F.lit("")) == "", "neutral").otherwise(F.col("outcome"))
    both = stored.select("*", F.lit(0).alias("_new")).unionByName(incoming.withColumn("outcome", outcome).select("*", F.lit(1).alias("_new")))
    o = F.struct("_new", "created_at", "outcome", "task_goal")
    first = F.struct("_new", "created_at", (~F.coalesce("consolidated", F.lit(False))).alias("open"), "consolidated_at", "session_id")
    return both.where(F.col("id").isNotNull()).groupBy("id").agg(
        *[F.min_by(F.col(c), first).alias(c) for c in ("session_id", "consolidated", "created_at", "consolidated_at")], *[_last(c, o).alias(c) for c in ("task_goal", "outcome", "trace_payload")]
    ).select(stored.columns)


def open_traces(traces: DataFrame) -> DataFrame:
    """All traces not yet consolidated, in no order."""
    return traces.where(~F.coalesce("consolidated", F.lit(False)))


def pending_traces(traces: DataFrame, limit: int = 100) -> DataFrame:
    """The oldest traces not yet consolidated, first come first served; a limit of 0 or less means 100."""
    return open_traces(traces).orderBy("created_at", "id").limit(limit if limit > 0 else 100)


def mark_consolidated(traces: DataFrame, done: DataFrame, at: Column) -> DataFrame:
    flags = done.select("id", F.lit(True).alias("_done")).distinct()
    j = traces.join(flags, "id", "left")
    return j.withColumn("consolidated", F.coalesce("_done", "consolidated")).withColumn("consolidated_at", F.when(F.col("_done"), at).otherwise(F.col("consolidated_at"))).select(traces.columns)


def graph_summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(total_nodes, total_edges, avg_degree, density): archived nodes count as well."""
    n, e = nodes.agg(F.count(F.lit(1)).alias("total_nodes")), edges.agg(F.count(F.lit(1)).alias("total_edges"))
    both = n.join(F.broadcast(e), F.lit(True))  # two single rows
    v, d = F.col("total_nodes"), F.col("total_edges")
    return both.select("total_nodes", "total_edges", F.when(v > 0, 2.0 * d / v).otherwise(0.0).alias("avg_degree"), F.when(v > 1, d / (v * (v - 1))).otherwise(0.0).alias("density"))


def entity_histogram(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("entity_type").agg(F.count(F.lit(1)).alias("n_nodes"))


def consolidation_stats(nodes: DataFrame, edges: DataFrame, traces: DataFrame) -> DataFrame:
    live = ~F.col("is_archived")
    a = nodes.agg(F.count_if(live).alias("active_nodes"), F.count_if(F.col("is_archived")).alias("archived_nodes"), F.coalesce(F.avg(F.when(live, F.col("stability_score"))), F.lit(0.0)).alias("avg_stability"))
    b = edges.agg(F.count(F.lit(1)).alias("total_edges"), F.coalesce(F.avg("weight"), F.lit(0.0)).alias("avg_weight"))
    c = traces.agg(F.count_if(F.coalesce("consolidated", F.lit(False))).alias("consolidated_traces"), F.count_if(~F.coalesce("consolidated", F.lit(False))).alias("pending_traces"))
    return a.join(F.broadcast(b), F.lit(True)).join(F.broadcast(c), F.lit(True))  # single rows

"""Queries of the graph engine over the project's tables."""

from __future__ import annotations

from dataclasses import replace
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.config import RecallConfig, RecallRequest, ResolvedRequest, ScopedDecay
from loomgraph.functions import secure
from loomgraph.functions import text as T
from loomgraph.operators import decay as D
from loomgraph.operators import graph as G
from loomgraph.operators import recall as R
from loomgraph.plans.graph_sql import CUTOFF, EXPANDING, LEXICAL_QUERY, MIXED, MODES, N_VECTORS, OWN, REF, REQUESTS, WALKING
from loomgraph.session import spread, table

NOW = datetime.fromisoformat(REF).replace(tzinfo=timezone.utc)


def now() -> Column:
    return F.lit(NOW).cast("timestamp")


def cut() -> Column:
    return F.lit(datetime.fromisoformat(CUTOFF).replace(tzinfo=timezone.utc)).cast("timestamp")


def _early(time: str = "created_at") -> Column:
    """What is stored before the other half comes in; rows without a time are."""
    return F.coalesce(F.col(time) < cut(), F.lit(True))


def _cur(spark: SparkSession, d: str) -> DataFrame:
    return G.current_nodes(table(spark, d, "nodes"))


def _joined(tags: str) -> Column:
    return F.array_join(F.coalesce(tags, F.array().cast("array<string>")), " ")


def active_headers(spark: SparkSession, d: str) -> DataFrame:
    h = G.active_headers(table(spark, d, "nodes"), table(spark, d, "node_anchors"))
    return h.select("id", "entity_type", "access_count", F.round("importance_score", 6).alias("importance_score"), _joined("anchors").alias("anchors"), F.round("magnitude", 4).alias("magnitude"))


def multi_get(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "scored_nodes").select(F.col("node_id").alias("id"))
    found = G.get_nodes(table(spark, d, "nodes"), table(spark, d, "node_anchors"), ids)
    return found.select("id", "entity_type", "label", "is_archived", _joined("anchors").alias("anchors"))


def incident_edges(spark: SparkSession, d: str) -> DataFrame:
    """The edges at any anchored node."""
    return _edges_at(spark, d, "node_anchors")


def incident_edges_scored(spark: SparkSession, d: str) -> DataFrame:
    """The edges at any scored node."""
    return _edges_at(spark, d, "scored_nodes")


def _edges_at(spark: SparkSession, d: str, name: str) -> DataFrame:
    ids = table(spark, d, name).select(F.col("node_id").alias("id")).where(F.col("id").isNotNull()).distinct()
    return G.incident_edges(table(spark, d, "edges"), ids).select("source_id", "target_id", "relation_type", "weight")


def find_matching_node(spark: SparkSession, d: str) -> DataFrame:
    return G.best_match(_cur(spark, d), table(spark, d, "nodes").select(F.trim("label").alias("label"), "entity_type").distinct())


def anchors_by_node(spark: SparkSession, d: str) -> DataFrame:
    return G.anchors_by_node(table(spark, d, "node_anchors")).select("node_id", _joined("anchors").alias("anchors"))


def nodes_by_anchor(spark: SparkSession, d: str) -> DataFrame:
    return G.nodes_for_anchors(table(spark, d, "node_anchors"), [" Project:griipwyn", "#pattern:breinwyn"])


def anchor_normalize(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "node_anchors").select("anchor_tag", T.normal_anchor(F.col("anchor_tag")).alias("normal")).distinct()


def upsert_nodes(spark: SparkSession, d: str) -> DataFrame:
    nodes = table(spark, d, "nodes").select(G.NODE_COLUMNS)
    merged = G.upsert_nodes(nodes.where(_early("last_accessed_at")), nodes.where(~_early("last_accessed_at")))
    return merged.select("id", "label", "is_archived", "last_accessed_at", F.round("stability_score", 6).alias("stability_score"), "importance_score", "access_count", "created_at", "last_reinforced_at")


def _edge_halves(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    edges = table(spark, d, "edges").select("source_id", "target_id", "relation_type", "weight", "created_at", "last_reinforced_at")
    empty = edges.limit(0)
    return G.upsert_edges(empty, edges.where(_early())), edges.where(~_early())


def upsert_edges(spark: SparkSession, d: str) -> DataFrame:
    return G.upsert_edges(*_edge_halves(spark, d))


def attach_anchors(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "node_anchors").select("node_id", "anchor_tag", "created_at")
    return G.attach_anchors(a.where(_early()), a.where(~_early()), table(spark, d, "nodes"))


def record_access(spark: SparkSession, d: str) -> DataFrame:
    hits = table(spark, d, "scored_nodes").select(F.col("node_id").alias("id"))
    return G.record_access(_cur(spark, d), hits, now()).select("id", "access_count", "last_accessed_at")


def reinforce_edges(spark: SparkSession, d: str) -> DataFrame:
    stored, new = _edge_halves(spark, d)
    deltas = G.clean_edges(new).select(*G.EDGE_KEY, (0.1 * F.col("weight")).alias("delta"), F.col("created_at").alias("at"))
    return G.reinforce_edges(stored, deltas).select(*G.EDGE_KEY, F.round("weight", 6).alias("weight"))


def boost_stability(spark: SparkSession, d: str) -> DataFrame:
    hits = table(spark, d, "scored_nodes").where(F.col("hop_distance") == 0).select(F.col("node_id").alias("id"), (0.15 * F.col("importance_score")).alias("delta"), now().alias("at"))
    return G.boost_stability(_cur(spark, d), hits).select("id", F.round("stability_score", 6).alias("stability_score"), "access_count", "is_archived")


def decay_periodic(spark: SparkSession, d: str) -> DataFrame:
    return D.periodic(_cur(spark, d), now()).select("id", F.round("stability_score", 9).alias("stability_score"), "is_archived")


def prune_edges(spark: SparkSession, d: str) -> DataFrame:
    archived = D.periodic(_cur(spark, d), now()).where("is_archived").select("id")
    edges = table(spark, d, "edges").where(F.col("source_id").isNotNull() & F.col("target_id").isNotNull())
    return D.prune_edges(edges, archived).select("source_id", "target_id", "relation_type", "weight")


def _scoped(req: ScopedDecay):  # noqa: ANN202
    def run(spark: SparkSession, d: str) -> DataFrame:
        marked = D.scoped(_cur(spark, d), table(spark, d, "node_anchors"), now(), req)
        return marked.select("id", "action", F.round("new_stability", 9).alias("new_stability"))

    return run


def pending_traces(spark: SparkSession, d: str) -> DataFrame:
    traces = table(spark, d, "episodic_traces").select("id", "session_id", "created_at", "consolidated").distinct()
    return G.pending_traces(traces).select("id", "session_id", "created_at")


def queue_traces(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "episodic_traces").select("id", "session_id", "task_goal", "outcome", "trace_payload", "consolidated", "created_at", "consolidated_at")
    return G.queue_traces(t.where(_early()), t.where(~_early())).select("id", "session_id", "consolidated", "created_at", "outcome")


def mark_consolidated(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "episodic_traces").select("id", "session_id", "consolidated", "created_at", "consolidated_at")
    done = G.mark_consolidated(t, t.where(_early()).select("id"), now())
    return done.groupBy("id").agg(F.count(F.lit(1)).alias("n_rows"), F.every("consolidated").alias("consolidated"))


def graph_summary(spark: SparkSession, d: str) -> DataFrame:
    s = G.graph_summary(table(spark, d, "nodes").select("id").distinct(), table(spark, d, "edges"))
    return s.select("total_nodes", "total_edges", F.round("avg_degree", 9).alias("avg_degree"), F.round("density", 12).alias("density"))


def entity_histogram(spark: SparkSession, d: str) -> DataFrame:
    return G.entity_histogram(_cur(spark, d))


def consolidation_stats(spark: SparkSession, d: str) -> DataFrame:
    s = G.consolidation_stats(_cur(spark, d), table(spark, d, "edges"), table(spark, d, "episodic_traces"))
    return s.withColumn("avg_stability", F.round("avg_stability", 9)).withColumn("avg_weight", F.round("avg_weight", 6))


def tokens(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", F.explode(T.tokens(F.col("text"))).alias("token"))


def _index(spark: SparkSession, d: str) -> DataFrame:
    return R.build_index(table(spark, d, "nodes"), table(spark, d, "node_anchors"))


def doc_freq(spark: SparkSession, d: str) -> DataFrame:
    return R.document_frequency(_index(spark, d))


def doc_length(spark: SparkSession, d: str) -> DataFrame:
    return R.length_stats(_index(spark, d)).withColumn("avg_len", F.round("avg_len", 9))


def top_keywords(pools: DataFrame, key: list[str], text: str, most: Column) -> DataFrame:
    """(key, keyword, n, first_pos): the most frequent keywords of each text, ties to the earlier one."""
    rows = pools.select(*key, most.alias("_most"), F.posexplode(T.keyword_tokens(F.col(text))).alias("pos", "keyword"))
    counted = rows.groupBy(*key, "keyword").agg(F.first("_most").alias("_most"), F.count(F.lit(1)).alias("n"), F.min("pos").alias("first_pos"))
    w = Window.partitionBy(*key).orderBy(F.desc("n"), "first_pos")
    return counted.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= F.col("_most")).drop("_rank", "_most")


def keyword_topn(spark: SparkSession, d: str) -> DataFrame:
    docs = spread(table(spark, d, "documents").select("doc_id", "text"))
    return top_keywords(docs, ["doc_id"], "text", T.keyword_limit(F.octet_length("text"))).select("doc_id", "keyword", "n")


def notable_lines(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_no, line, kind, label): trimmed lines of at least eight bytes, numbered within their text."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: F.octet_length(x) >= 8)
    rows = texts.select(key, F.posexplode(lines).alias("line_no", "line"))
    return rows.withColumn("kind", T.line_kind(F.col("line"))).withColumn("label", T.event_label(F.col("line")))


def trace_line_class(spark: SparkSession, d: str) -> DataFrame:
    docs = spread(table(spark, d, "documents").select("doc_id", "text"))
    return notable_lines(docs, "doc_id", "text").select("doc_id", F.col("line_no").cast("long"), "kind", "label")


def outcome_salience(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "episodic_traces")
    return t.groupBy("outcome", F.round(T.salience(F.col("outcome")), 3).alias("salience")).agg(F.count(F.lit(1)).alias("n_traces"))


def goal_text(goal: Column, session: Column) -> Column:
    clean = F.trim(F.coalesce(goal, F.lit("")))
    return F.when(clean == "", F.concat(F.lit("Episodic Task Session "), F.coalesce(session, F.lit("")))).otherwise(clean)


def content_ids(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "episodic_traces")
    return t.select("session_id", T.content_id("task", goal_text(F.col("task_goal"), F.col("session_id"))).alias("goal_id")).distinct()


def importance_score(spark: SparkSession, d: str) -> DataFrame:
    j = _cur(spark, d).join(G.anchors_by_node(table(spark, d, "node_anchors")).withColumnRenamed("node_id", "id"), "id", "left")
    return j.select("id", F.round(T.importance(F.col("entity_type"), F.col("label"), F.col("summary"), F.col("anchors").isNotNull()), 6).alias("importance"))


def lexical_score(spark: SparkSession, d: str) -> DataFrame:
    live = _cur(spark, d).where(~F.col("is_archived"))
    return live.select("id", T.lexical_score(LEXICAL_QUERY, F.col("label"), F.col("summary")).alias("lexical"))


def freq_score(spark: SparkSession, d: str) -> DataFrame:
    """The operator's own score of one request, for every active node."""
    return R.scored(_index(spark, d), [RecallRequest(query="").resolved()], NOW).select("id", F.round("frequency_score", 9).alias("frequency"))


def recency_score(spark: SparkSession, d: str) -> DataFrame:
    cfg = replace(RecallConfig(), tau=timedelta(days=30))
    return R.scored(_index(spark, d), [RecallRequest(query="").resolved()], NOW, cfg).select("id", F.round("recency_score", 9).alias("recency"))


def with_vectors(spark: SparkSession, d: str, requests: list[RecallRequest]) -> list[ResolvedRequest]:
    """Request i gets the vector of the i-th lowest node id that has 64 dimensions; a handful of rows to the driver."""
    nodes = table(spark, d, "nodes").where(F.col("id").isNotNull() & (F.size("embedding") == 64) & F.exists("embedding", lambda x: x != 0)).select("id", "embedding")
    first = [r["id"] for r in nodes.select("id").distinct().orderBy("id").limit(N_VECTORS).collect()]
    rows = nodes.where(F.col("id").isin(first)).dropDuplicates(["id"]).orderBy("id").collect()  # the rows of an id agree in their vectors
    named = [replace(r, entity_id=x["id"]) if r.entity_id == OWN else r for r, x in zip(requests, rows)]
    return [r.resolved().with_vector(tuple(x["embedding"])) for r, x in zip(named, rows)] if len(rows) >= len(requests) else [r.resolved() for r in requests]


SCORES = ("sim_score", "dense_score", "bm25_score", "frequency_score", "recency_score", "importance_score", "anchor_score", "base_score", "total_score")


def _rounded() -> list[Column]:
    return [F.round(c, 6).alias(c) for c in SCORES]


def _ranked(scores: DataFrame, k: int, *extra: str) -> DataFrame:
    return R.best(scores, k).select("query_no", "id", F.col("place").cast("long"), *_rounded(), *extra)


def recall_full_score(spark: SparkSession, d: str) -> DataFrame:
    return R.scored(_index(spark, d), with_vectors(spark, d, REQUESTS), NOW).select("query_no", "id", *_rounded())


def recall_batch_rank(spark: SparkSession, d: str) -> DataFrame:
    return _ranked(R.scored(_index(spark, d), with_vectors(spark, d, REQUESTS), NOW, keep=20), 20)


def recall_anchor_filter(spark: SparkSession, d: str) -> DataFrame:
    req = RecallRequest(query="threshold of the sensor", anchors=("project:griipwyn", "#pattern:breinwyn"), anchor_mode="filter", top_k=30)
    return _ranked(R.scored(_index(spark, d), with_vectors(spark, d, [req]), NOW, keep=30), 30)


def _expanded(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return R.expand(_index(spark, d), table(spark, d, "edges"), with_vectors(spark, d, EXPANDING), NOW, 10)


def _mode(requests: list[RecallRequest]):  # noqa: ANN202
    def run(spark: SparkSession, d: str) -> DataFrame:
        return _ranked(R.scored(_index(spark, d), with_vectors(spark, d, requests), NOW, keep=25), 25)

    return run


def expand_relation_filter(spark: SparkSession, d: str) -> DataFrame:
    grown, _ = R.expand(_index(spark, d), table(spark, d, "edges"), with_vectors(spark, d, WALKING), NOW, 15)
    return _ranked(grown, 15, "hop_distance")


def recall_expanded(spark: SparkSession, d: str) -> DataFrame:
    return _ranked(_expanded(spark, d)[0], 10, "hop_distance")


def expand_edges_gated(spark: SparkSession, d: str) -> DataFrame:
    return _expanded(spark, d)[1].select("source_id", "target_id", "relation_type", F.round("weight", 6).alias("weight")).distinct()


def subgraph_edges(spark: SparkSession, d: str) -> DataFrame:
    grown, used = _expanded(spark, d)
    return R.subgraph_edges(used, R.best(grown, 10)).select("query_no", "source_id", "target_id", "relation_type")


def recall_mixed_batch(spark: SparkSession, d: str) -> DataFrame:
    """Requests of different gates, limits, fields and permissions in one batch, as each may see its nodes."""
    nodes, edges, anchors = (table(spark, d, t) for t in ("nodes", "edges", "node_anchors"))
    top = R.recall(nodes, edges, anchors, _mixed(spark, d), NOW)
    return top.select("query_no", "id", F.col("place").cast("long"), "hop_distance", "total_score", "summary", "label", F.col("embedding").isNotNull().alias("has_vector"), F.col("anchors").isNotNull().alias("has_anchors"), "last_accessed_at")


def _mixed(spark: SparkSession, d: str) -> list[RecallRequest]:
    resolved = with_vectors(spark, d, MIXED)
    return [replace(r, embedding=x.embedding) for r, x in zip(MIXED, resolved)]


def recall_mixed_edges(spark: SparkSession, d: str) -> DataFrame:
    """The edges of the same batch: each request's own gate, and only where its returned nodes are touched."""
    nodes, edges, anchors = (table(spark, d, t) for t in ("nodes", "edges", "node_anchors"))
    used = R.recall_graph(nodes, edges, anchors, _mixed(spark, d), NOW)[1]
    return used.select("query_no", "source_id", "target_id", "relation_type")


def recall_dense_topk(spark: SparkSession, d: str) -> DataFrame:
    """The vectors whose id is divisible by 20 against all vectors, in blocks of one matrix product each."""
    e = spread(table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding"))
    found = R.dense_top(e, e.where(F.col("id") % 20 == 0), 20)
    return found.select("query_id", F.col("id").alias("vec_id"), "cosine", F.col("place").cast("long"))


def secret_mask(spark: SparkSession, d: str) -> DataFrame:
    return _cur(spark, d).select("id", secure.mask(F.col("summary"), F.col("is_secret")).alias("summary"))


_PLAIN = (active_headers, multi_get, incident_edges, incident_edges_scored, find_matching_node, anchors_by_node, nodes_by_anchor, anchor_normalize, upsert_nodes, upsert_edges, attach_anchors, record_access, reinforce_edges, boost_stability, decay_periodic, prune_edges, pending_traces, queue_traces, mark_consolidated, graph_summary, entity_histogram, consolidation_stats, tokens, doc_freq, doc_length, keyword_topn, trace_line_class, outcome_salience, content_ids, importance_score, lexical_score, freq_score, recency_score, recall_batch_rank, recall_full_score, recall_anchor_filter, recall_expanded, expand_relation_filter, expand_edges_gated, subgraph_edges, recall_mixed_batch, recall_mixed_edges, recall_dense_topk, secret_mask)
QUERIES = {f.__name__: f for f in _PLAIN} | {name: _mode(requests) for name, requests in MODES.items()} | {
    "decay_scope_all": _scoped(ScopedDecay("all")),
    "decay_scope_unanchored": _scoped(ScopedDecay("unanchored", half_life=timedelta(hours=240), grace=timedelta(days=60), threshold=0.5)),
    "decay_scope_transient": _scoped(ScopedDecay("transient", half_life=timedelta(hours=480), grace=timedelta(days=30), threshold=0.4)),
    "decay_scope_session": _scoped(ScopedDecay("session", session_id="breewyn")),
}

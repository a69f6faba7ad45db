"""Queries of extraction, fusion and secrets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions import secure
from loomgraph.operators import graph as G
from loomgraph.operators.extract import extract, log_events
from loomgraph.operators.fuse import fuse
from loomgraph.plans import consolidation_sql
from loomgraph.plans.graph_sql import CUR
from loomgraph.session import spread, table


def extract_entities(spark: SparkSession, d: str) -> DataFrame:
    e = extract(table(spark, d, "episodic_traces")).entities
    return e.select("trace_id", "section", "o1", "o2", "id", "entity_type", "label", "summary", F.round("salience", 6).alias("salience"), F.round("importance", 6).alias("importance"), "is_secret")


def extract_relations(spark: SparkSession, d: str) -> DataFrame:
    r = extract(table(spark, d, "episodic_traces")).relations
    return r.select("trace_id", "source_id", "target_id", "relation_type", F.round("weight", 6).alias("weight"))


def trace_line_sample(spark: SparkSession, d: str) -> DataFrame:
    """The lines that would become events, were each document a log."""
    docs = spread(table(spark, d, "documents").select("doc_id", "text", "created_at"))
    shaped = docs.select(F.col("doc_id").alias("trace_id"), F.col("created_at").alias("at"), F.lit("").alias("goal_id"), F.lit(1.0).alias("s"), F.lit(False).alias("trace_secret"), F.lit(False).alias("anchored"), F.col("text").alias("log_text"))
    return log_events(shaped).select(F.col("trace_id").alias("doc_id"), F.col("i").cast("long").alias("line_no"), "kind", "label", F.col("id").alias("event_id"))


def _graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    edges = table(spark, d, "edges").select("source_id", "target_id", "relation_type", "weight", "created_at", "last_reinforced_at")
    return G.current_nodes(table(spark, d, "nodes")).select(G.NODE_COLUMNS), G.upsert_edges(edges.limit(0), edges)


def fuse_nodes(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = _graph(spark, d)
    out = fuse(nodes, edges, extract(table(spark, d, "episodic_traces"))).nodes
    return out.select("id", "entity_type", "label", "access_count", F.round("stability_score", 6).alias("stability_score"), F.round("importance_score", 6).alias("importance_score"), "is_archived", "created_at", "last_accessed_at")


def fuse_edges(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = _graph(spark, d)
    return fuse(nodes, edges, extract(table(spark, d, "episodic_traces"))).edges.select(*G.EDGE_KEY, F.round("weight", 10).alias("weight"))


def fuse_anchors(spark: SparkSession, d: str) -> DataFrame:
    """The tags that anchored traces leave on the nodes that they name."""
    nodes, edges = _graph(spark, d)
    return fuse(nodes, edges, extract(table(spark, d, "episodic_traces"))).anchors


def secret_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Summaries that aren't sealed yet, encrypted and read again: the same under the key, null under another one.

    Vault references stay as they are and open without a key."""
    key = "round-trip-key"
    rows = G.current_nodes(table(spark, d, "nodes")).where(~F.coalesce(F.col("summary").startswith(secure.PREFIX), F.lit(False))).select("id", F.coalesce("summary", F.lit("")).alias("summary"))
    sealed = rows.withColumn("sealed", secure.encrypt(F.col("summary"), key))
    return sealed.select("id", (secure.decrypt(F.col("sealed"), key) == F.col("summary")).alias("same"), F.col("sealed").startswith(secure.PREFIX).alias("sealed"), secure.decrypt(F.col("sealed"), key + "x").isNull().alias("closed"))


QUERIES = {f.__name__: f for f in (extract_entities, extract_relations, trace_line_sample, fuse_nodes, fuse_edges, fuse_anchors, secret_roundtrip)}
ORACLE = {
    **consolidation_sql.ORACLE,
    "secret_roundtrip": f"""WITH {CUR}, t AS (SELECT id, coalesce(summary, '') AS s FROM cur WHERE NOT coalesce(summary LIKE 'enc:v1:%', FALSE)),
        k AS (SELECT id, s <> '' AND NOT (s LIKE 'vault://%' OR s LIKE 'env://%') AS sealed FROM t) SELECT id, TRUE AS same, sealed, sealed AS closed FROM k""",
}

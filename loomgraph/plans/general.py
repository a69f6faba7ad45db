"""Queries of the general data problems (orphan references, nested records, skewed keys) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions.ids import utc_month
from loomgraph.operators import references as R
from loomgraph.operators import shred as S
from loomgraph.operators import sources_profile as P
from loomgraph.plans import nested_sql as N
from loomgraph.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    orphans = R.edge_orphans(table(spark, d, "edges"), table(spark, d, "nodes"))
    return orphans.select("source_id", "target_id", "relation_type", "side", utc_month(F.col("ref_at")).alias("edge_month")).distinct()


def p1_orphan_report(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges, anchors = (table(spark, d, t) for t in ("nodes", "edges", "node_anchors"))
    by_edge = R.orphan_report(R.edge_orphans(edges, nodes), "edges")
    refs = R.references(anchors, [R.ForeignKey("node_id", "node")], "created_at")
    by_anchor = R.orphan_report(R.find_orphans(refs, R.current_parents(nodes), anchors.count()), "node_anchors")
    return by_edge.unionByName(by_anchor)


def _traces(spark: SparkSession, d: str) -> DataFrame:
    return S.shred(table(spark, d, "episodic_traces"), "id", "trace_payload", S.TRACE_SPEC)


STEPS = {"step_index": "stepindex", "thought": "thought", "action": "action", "observation": "observation", "status": "status", "at": "timestamp", "plain_value": "value"}
SENSORY = {"item_id": "id", "item_text": "text", "salience": "salience", "origin": "source", "at": "timestamp", "plain_value": "value"}
ACTIONS = {"action_id": "id", "action_type": "type", "committed": "committed", "at": "createdat", "plain_value": "value"}


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return S.found_elements(_traces(spark, d))


def p2_steps(spark: SparkSession, d: str) -> DataFrame:
    return S.flat_table(_traces(spark, d), "trajectory", STEPS)


def p2_sensory(spark: SparkSession, d: str) -> DataFrame:
    return S.flat_table(_traces(spark, d), "sensorycontext", SENSORY)


def p2_actions(spark: SparkSession, d: str) -> DataFrame:
    return S.flat_table(_traces(spark, d), "candidateactions", ACTIONS)


def p2_payload(spark: SparkSession, d: str) -> DataFrame:
    return S.entry_table(_traces(spark, d), "payload")


def p2_elements(spark: SparkSession, d: str) -> DataFrame:
    """The leaves of all repeated elements that have no query of their own, those within payloads among them."""
    return S.element_leaves(_traces(spark, d), S.TRACE_SPEC.lists | S.TRACE_SPEC.entries)


def p2_schema_graph(spark: SparkSession, d: str) -> DataFrame:
    return S.schema_graph(table(spark, d, "episodic_traces"), "trace_payload")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return P.dominant_sources(table(spark, d, "edges"))


def p5_source_stats(spark: SparkSession, d: str) -> DataFrame:
    return P.source_stats(table(spark, d, "edges")).select(
        "source_id", "n_edges", F.round("total_weight", 6).alias("total_weight"), "max_weight", "n_neighbours"
    )


def p5_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return P.neighbours(table(spark, d, "edges")).withColumn("total_weight", F.round("total_weight", 6))


QUERIES = {f.__name__: f for f in (p1_found, p1_orphan_report, p2_found, p2_steps, p2_sensory, p2_actions, p2_payload, p2_elements, p2_schema_graph, p5_found, p5_source_stats, p5_neighbours)}

_ID = "lower(regexp_replace(coalesce({0}, ''), '^[\\s\\x1c-\\x1f\\x0b\\x85\\p{{Z}}]+|[\\s\\x1c-\\x1f\\x0b\\x85\\p{{Z}}]+$', '', 'g'))"


def _id(column: str) -> str:
    return _ID.format(column)


_ORPHANS = f"""
WITH node_state AS (
  SELECT {_id('id')} AS id, coalesce(is_archived, false) AS archived, created_at AS born,
         row_number() OVER (PARTITION BY {_id('id')} ORDER BY last_accessed_at DESC NULLS LAST, coalesce(is_archived, false) DESC, created_at DESC NULLS LAST) AS rn
  FROM nodes WHERE {_id('id')} <> ''),
parents AS (SELECT id, archived, born FROM node_state WHERE rn = 1),
refs AS (
  SELECT 'edges' AS table_name, 'source' AS side, {_id('source_id')} AS ref_key, created_at AS at, {_id('source_id')} AS source_id, {_id('target_id')} AS target_id, relation_type FROM edges
  UNION ALL
  SELECT 'edges', 'target', {_id('target_id')}, created_at, {_id('source_id')}, {_id('target_id')}, relation_type FROM edges
  UNION ALL
  SELECT 'node_anchors', 'node', {_id('node_id')}, created_at, NULL, NULL, NULL FROM node_anchors),
orphans AS (
  SELECT r.*, strftime(r.at AT TIME ZONE 'UTC', '%Y-%m') AS month,
         CASE WHEN p.id IS NULL THEN 'missing' WHEN p.archived THEN 'archived' ELSE 'not_yet_created' END AS reason
  FROM refs r LEFT JOIN parents p ON r.ref_key = p.id
  WHERE r.ref_key <> '' AND (p.id IS NULL OR p.archived OR p.born > r.at))
"""

_CLEAN = f"""
WITH e AS (SELECT {_id('source_id')} AS source_id, {_id('target_id')} AS target_id,
                  CASE WHEN NOT isnan(weight) THEN weight END AS weight FROM edges)
"""

ORACLE = {
    "p1_found": _ORPHANS + "SELECT DISTINCT source_id, target_id, relation_type, side, month AS edge_month FROM orphans WHERE table_name = 'edges'",
    "p1_orphan_report": _ORPHANS + "SELECT table_name, side, month, reason, count(*) AS n_refs, count(DISTINCT ref_key) AS n_keys FROM orphans GROUP BY ALL",
    "p2_found": N.FOUND,
    "p2_steps": N.flat("trajectory", STEPS),
    "p2_sensory": N.flat("sensorycontext", SENSORY),
    "p2_actions": N.flat("candidateactions", ACTIONS),
    "p2_payload": N.PAYLOAD,
    "p2_elements": N.ELEMENTS,
    "p2_schema_graph": N.SCHEMA,
    "p5_found": _CLEAN + "SELECT source_id FROM e WHERE source_id <> '' GROUP BY source_id HAVING count(*) >= 0.01 * (SELECT count(*) FROM edges)",
    "p5_source_stats": _CLEAN
    + """SELECT source_id, count(*) AS n_edges, round(coalesce(sum(weight), 0), 6) AS total_weight, max(weight) AS max_weight,
                count(DISTINCT CASE WHEN target_id <> '' THEN target_id END) AS n_neighbours
         FROM e WHERE source_id <> '' GROUP BY source_id""",
    "p5_neighbours": _CLEAN
    + """SELECT source_id, target_id, count(*) AS n_edges, round(coalesce(sum(weight), 0), 6) AS total_weight
         FROM e WHERE source_id <> '' AND target_id <> '' GROUP BY source_id, target_id""",
}

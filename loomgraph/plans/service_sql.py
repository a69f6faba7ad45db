"""SQL of the service's queries: embeddings, cycles, requests, imports, the store."""

from __future__ import annotations

from loomgraph.config import RecallRequest
from loomgraph.functions import embed as E
from loomgraph.plans.consolidation_sql import EXTRACTED, FUSED
from loomgraph.plans.graph_sql import CUR, REF, TAGS, all_toks, anchor, in_order, quoted, scoped_sql, scores_sql

_REF = f"TIMESTAMPTZ '{REF}+00'"
DIM = 64


def _stem(w: str) -> str:
    n = f"length({w})"
    cases = " ".join(f"WHEN {w} LIKE '%{s}' AND {n} - {len(s)} >= 3 THEN left({w}, {n} - {len(s)}){" || 'y'" if s == 'ies' else ''}" for s in E.SUFFIXES)
    return f"(CASE WHEN {n} <= 3 THEN {w} ELSE (SELECT CASE WHEN length(x) > 3 AND x LIKE '%e' THEN left(x, length(x) - 1) ELSE x END FROM (SELECT CASE {cases} ELSE {w} END AS x)) END)"


def embeddings(rows: str) -> str:
    """CTEs up to vectors(id, i, value, norm): the embedding of each (id, text), element by element, before it is divided."""
    phrases = ", ".join(f"({quoted(p)}, {quoted('concept:' + c)})" for c, ps in E.SYNONYMS.items() for p in ps)
    word = "1.0 + 0.15 * least(5, length(w))"
    return f"""given AS (SELECT id, lower(trim(coalesce(text, ''))) AS text FROM ({rows})),
word_list AS (SELECT id, {in_order('raw')} AS ws FROM (SELECT id, {all_toks('text')} AS raw FROM given)),
words_of AS (SELECT id, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos FROM word_list),
met AS (SELECT DISTINCT g.id, p.f, {E.CONCEPT_WEIGHT} AS weight FROM given g JOIN (VALUES {phrases}) p(phrase, f) ON contains(g.text, p.phrase)),
parts AS (SELECT * FROM met
  UNION ALL SELECT id, 's:' || {_stem('w')}, ({word}) * {E.STEM_WEIGHT} FROM words_of
  UNION ALL SELECT id, 'w:' || w, ({word}) * {E.WORD_WEIGHT} FROM words_of
  UNION ALL SELECT id, 'ng4:' || substr(w, k, 4), {E.GRAM_WEIGHT} FROM (SELECT id, w, unnest(range(1, length(w) - 2)) AS k FROM words_of WHERE length(w) >= 5)
  UNION ALL SELECT a.id, 'bi:' || a.w || '_' || b.w, {E.PAIR_WEIGHT} FROM words_of a JOIN words_of b ON a.id = b.id AND b.pos = a.pos + 1
  UNION ALL SELECT id, 'raw:' || text, {E.RAW_WEIGHT} FROM given WHERE text <> '' AND id NOT IN (SELECT id FROM words_of) AND id NOT IN (SELECT id FROM met)),
features AS (SELECT id, f, sum(weight) AS weight FROM parts GROUP BY 1, 2),
names AS (SELECT DISTINCT f, list_transform(range(1, length(hex(encode(f))) // 2 + 1), lambda i: ('0x' || substr(hex(encode(f)), 2 * i - 1, 2))::INTEGER::UHUGEINT) AS bytes FROM features),
seeded AS (SELECT f, list_reduce(list_concat([{E.FNV_OFFSET}::UHUGEINT], bytes), lambda h, b: (xor(h, b) * {E.FNV_PRIME}::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT AS h FROM names),
states AS (SELECT f, 0 AS i, CASE WHEN h = 0 THEN {E.ZERO_SEED}::UBIGINT ELSE h END AS s FROM seeded
  UNION ALL SELECT f, i + 1, xor(b, b >> 27) FROM (SELECT f, i, xor(a, ((a::UHUGEINT * 33554432::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT) AS b FROM (SELECT f, i, xor(s, s >> 12) AS a FROM states WHERE i < {DIM}))),
directions AS (SELECT f, i - 1 AS i, (CASE WHEN v >= 2147483648 THEN v - 4294967296 ELSE v END)::FLOAT::DOUBLE / 2147483648.0 AS d
  FROM (SELECT f, i, (((s::UHUGEINT * {E.MULTIPLIER}::UHUGEINT) % 18446744073709551616::UHUGEINT) // 4294967296::UHUGEINT)::BIGINT AS v FROM states WHERE i > 0)),
sums AS (SELECT x.id, d.i, sum(x.weight * d.d) AS value FROM features x JOIN directions d USING (f) GROUP BY 1, 2),
vectors AS (SELECT id, i, value, sqrt(sum(value * value) OVER (PARTITION BY id)) AS norm FROM sums)"""


_NO_VECTOR = f"SELECT id, concat_ws(' ', label, summary) AS text FROM cur WHERE embedding IS NULL"
_ALL = f"SELECT g.id, r.i::INTEGER AS i, round(coalesce((v.value / v.norm)::FLOAT, 0)::DOUBLE, 4) + 0.0 AS value FROM given g CROSS JOIN (SELECT unnest(range({DIM})) AS i) r LEFT JOIN vectors v ON v.id = g.id AND v.i = r.i"

BIGGEST = "(SELECT session_id FROM episodic_traces WHERE session_id IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"
_IDS = f"x AS (SELECT DISTINCT id FROM entities WHERE entity_type IN ('task_goal', 'decision', 'sensory_fact') AND trace_id IN (SELECT id FROM episodic_traces WHERE lower(trim(coalesce(session_id, ''))) = {BIGGEST}))"
_MINE = scoped_sql("session", 0.8, 259200.0, 0.0).replace("contains(coalesce(summary, ''), 'breewyn') OR contains(coalesce(label, ''), 'breewyn')", f"contains(coalesce(summary, ''), {BIGGEST}) OR contains(coalesce(label, ''), {BIGGEST}) OR id IN (SELECT id FROM x)")
_MINE = EXTRACTED + ", " + _IDS + ", " + _MINE.removeprefix("WITH ")

_DECAY = f"greatest(0.0, coalesce((epoch_us({_REF}) - epoch_us(last_use)) / 1e6, 0.0))"


def cycled(fused: str, extra: str = "") -> str:
    """Fusion followed by one decay cycle: CTEs up to after(id, entity_type, stability_score, is_archived, access_count)."""
    return f"""{fused}{extra},
uses AS (SELECT f.*, CASE WHEN f.id IN (SELECT match_id FROM gains) OR f.id IN (SELECT id FROM fresh) THEN f.last_accessed_at ELSE greatest(f.last_accessed_at, c.last_reinforced_at) END AS last_use FROM fused_nodes f LEFT JOIN cur c ON c.id = f.id),
faded AS (SELECT *, CASE WHEN is_archived THEN stability_score ELSE stability_score * exp(-ln(2.0) / 259200.0 * {_DECAY}) END AS s FROM uses),
after AS (SELECT id, entity_type, s AS stability_score, is_archived OR (s < 0.1 AND {_DECAY} >= 604800) AS is_archived, access_count FROM faded),
after_edges AS (SELECT * FROM fused_edges WHERE weight >= 0.05 AND source_id NOT IN (SELECT id FROM after WHERE is_archived) AND target_id NOT IN (SELECT id FROM after WHERE is_archived))"""


_EMPTY = FUSED.replace(CUR, "\ncur AS (SELECT * FROM nodes WHERE FALSE)").replace("FROM edges WHERE coalesce(source_id, '') <> ''", "FROM edges WHERE FALSE AND coalesce(source_id, '') <> ''")
#: The oldest traces that a cycle of 500 takes.
_QUEUED = "queued AS (SELECT id, min(created_at) AS first_at, arg_min(consolidated, (created_at, NOT consolidated)) AS done FROM episodic_traces WHERE id IS NOT NULL GROUP BY id), pending AS (SELECT id FROM queued WHERE NOT coalesce(done, FALSE) ORDER BY first_at, id LIMIT 500)"
_CYCLE = cycled(FUSED.replace("WITH RECURSIVE one AS", f"WITH RECURSIVE {_QUEUED}, one AS").replace("FROM episodic_traces WHERE id IS NOT NULL) WHERE rn = 1)", "FROM episodic_traces WHERE id IN (SELECT id FROM pending)) WHERE rn = 1)"))

_QUERY = "coalesce(label, '') || ' ' || coalesce(anchor_tag, '')"
_WORDS = "list_filter(regexp_split_to_array(trim(q), '[\\s\\x1c-\\x1f\\x85\\p{Z}]+'), lambda x: x <> '')"
_PARSED = f"""SELECT id, tag, list_filter({_WORDS}, lambda x: x LIKE '#%') AS tags, array_to_string(list_filter({_WORDS}, lambda x: x NOT LIKE '#%'), ' ') AS rest, trim(q) AS q
  FROM (SELECT DISTINCT n.id, a.anchor_tag AS tag, {_QUERY} AS q FROM nodes n JOIN node_anchors a ON a.node_id = n.id WHERE a.anchor_tag IS NOT NULL)"""

FIELD_REQUESTS = [RecallRequest(query="retry policy of the decay scheduler", fields=("ID", "entity_type", "label", "summary", "embedding", "anchors", "created_at", "last_accessed_at", "last_reinforced_at", "archived_at", "access_count", "stability_score", "is_archived", "is_secret", "score", "sim_score", "dense_score", "bm25_score", "frequency_score", "recency_score", "importance_score", "anchor_score", "hop_distance", "unknown"), top_k=50)]
_SCORE_FIELDS = ("sim_score", "dense_score", "bm25_score", "frequency_score", "recency_score", "anchor_score")
_SEEN = "CASE WHEN cur.is_secret OR coalesce(cur.summary LIKE 'enc:v1:%', FALSE) THEN '[REDACTED_SECRET]' ELSE cur.summary END"


def _top(requests: list[RecallRequest], k: int) -> str:
    return scores_sql(requests) + f", top AS (SELECT *, row_number() OVER (PARTITION BY query_no ORDER BY round(total_score, 9) DESC, id) AS place FROM scores QUALIFY place <= {k})"


def _imports() -> str:
    return f"""SELECT id, TRY_CAST(created AS TIMESTAMPTZ) AS created_at, coalesce(TRY_CAST(n AS BIGINT), 0) AS access_count, round(coalesce(TRY_CAST(s AS DOUBLE), 1.0), 9) AS stability_score, coalesce(b, FALSE) AS is_archived, len(embedding)::INTEGER AS n_elements
      FROM (SELECT id, CASE WHEN access_count % 7 = 0 THEN 'soon' ELSE strftime(created_at, '%Y-%m-%d %H:%M:%S.%f') END AS created, CASE WHEN access_count % 5 = 0 THEN 'many' ELSE access_count::VARCHAR END AS n, CASE WHEN access_count % 3 = 0 THEN '' ELSE stability_score::VARCHAR END AS s, is_archived AS b, CASE WHEN access_count % 11 = 0 THEN NULL ELSE embedding END AS embedding FROM nodes)"""


ORACLE = {
    "embed_generate": f"WITH RECURSIVE {CUR}, {embeddings(_NO_VECTOR)} {_ALL}",
    "embed_queries": f"WITH RECURSIVE {embeddings('SELECT DISTINCT label AS id, label AS text FROM nodes WHERE label IS NOT NULL')}, stated AS ({_ALL}) SELECT id, i, value FROM stated",
    "active_scan": f"WITH {CUR}, {TAGS} SELECT id, entity_type, label, md5(coalesce(summary, '')) AS summary_md5, len(embedding)::INTEGER AS n_elements, created_at, access_count, array_to_string(coalesce(anchors, []), ' ') AS anchors FROM cur LEFT JOIN tags ON cur.id = tags.node_id WHERE NOT coalesce(is_archived, FALSE)",
    "point_lookup": f"WITH {CUR}, {TAGS} SELECT id, label, is_archived, array_to_string(coalesce(anchors, []), ' ') AS anchors FROM cur LEFT JOIN tags ON cur.id = tags.node_id WHERE id = (SELECT min(id) FROM nodes) OR id = (SELECT min(id) FROM nodes WHERE is_archived)",
    "session_traces": f"SELECT DISTINCT id, md5(coalesce(trace_payload, '')) AS payload_md5 FROM episodic_traces WHERE session_id = {BIGGEST}",
    "decay_scope_session_traces": _MINE,
    "decay_tally": f"SELECT action, count(*) AS n_nodes FROM ({scoped_sql('all', 0.8, 259200.0, 0.0)}) GROUP BY action",
    "import_text": _imports(),
    "vector_codec": "SELECT id, len(embedding)::INTEGER AS n_elements, (4 * len(embedding))::INTEGER AS n_bytes, round(list_sum(embedding::DOUBLE[]), 6) AS total, TRUE AS odd_length_is_null FROM nodes WHERE len(embedding) > 0",
    "request_parse": f"""WITH r AS ({_PARSED}), s AS (SELECT id, tag, tags, CASE WHEN len(tags) > 0 AND rest <> '' THEN rest ELSE q END AS text FROM r)
        SELECT id, tag, text, array_to_string({in_order('raw')}, ' ') AS tokens, array_to_string({in_order('tagged')}, ' ') AS anchors FROM (SELECT *, {all_toks('lower(text)')} AS raw, list_filter(list_transform(tags, lambda x: lower(trim(x))), lambda x: x <> '#') AS tagged FROM s)""",
    "duration_parse": "SELECT DISTINCT access_count, (3600 * access_count + 60 * (access_count % 50) + 0.25 + access_count / 1e9)::DOUBLE AS seconds FROM nodes",
    "recall_fields": _top(FIELD_REQUESTS, 50)
    + f""" SELECT top.query_no, top.place, top.id, cur.entity_type, cur.label, {_SEEN} AS summary, len(cur.embedding)::INTEGER AS n_elements, array_to_string(top.anchors, ' ') AS anchors, cur.created_at, cur.last_accessed_at, cur.last_reinforced_at, cur.archived_at, cur.access_count, round(cur.stability_score, 6) AS stability_score, cur.is_archived, cur.is_secret OR coalesce(cur.summary LIKE 'enc:v1:%', FALSE) AS is_secret, round(total_score, 4) AS score, {', '.join(f'round(top.{c}, 4) AS {c}' for c in _SCORE_FIELDS)}, round(CASE WHEN round(top.importance_score, 4) > 0 THEN round(top.importance_score, 4) ELSE cur.importance_score END, 4) AS importance_score, 0 AS hop_distance
        FROM top JOIN cur ON cur.id = top.id""",
    "recall_json": _top(FIELD_REQUESTS, 50)
    + f""" SELECT top.query_no, top.place, top.id, array_to_string(list_sort(list_filter(['id', CASE WHEN {_SEEN} <> '' THEN 'summary' END, CASE WHEN cur.label <> '' THEN 'label' END, {', '.join(f"CASE WHEN round(top.{c}, 4) <> 0 THEN '{c}' END" for c in _SCORE_FIELDS)}], lambda x: x IS NOT NULL)), ' ') AS keys FROM top JOIN cur ON cur.id = top.id""",
    "stream_consolidate": cycled(_EMPTY) + " SELECT entity_type, count(*) AS n_nodes FROM after GROUP BY 1",
    "stream_nodes": cycled(_EMPTY) + " SELECT id, entity_type, round(stability_score, 6) AS stability_score, is_archived, access_count FROM after",
    "cycle_nodes": _CYCLE + " SELECT id, entity_type, round(stability_score, 6) AS stability_score, is_archived, access_count FROM after",
    "cycle_totals": _CYCLE + " SELECT (SELECT count(*) FROM pending) AS traces, (SELECT count(*) FROM after) AS nodes, (SELECT count(*) FROM after WHERE is_archived) AS archived, (SELECT count(*) FROM after_edges) AS edges, (SELECT count(*) FROM queued WHERE id IN (SELECT id FROM pending) OR coalesce(done, FALSE)) AS consolidated",
    "ingest_notified": FUSED + " SELECT id FROM fresh UNION SELECT match_id FROM gains",
    "ingest_fallbacks": "SELECT DISTINCT id, CASE WHEN coalesce(task_goal, '') = '' THEN 'goal of ' || session_id ELSE task_goal END AS task_goal, CASE WHEN coalesce(outcome, '') = '' THEN 'failed' ELSE outcome END AS outcome FROM (SELECT id, any_value(task_goal ORDER BY created_at DESC, outcome DESC) AS task_goal, any_value(outcome ORDER BY created_at DESC, outcome DESC) AS outcome, any_value(session_id ORDER BY created_at) AS session_id FROM episodic_traces WHERE id IS NOT NULL GROUP BY id)",
    "store_tables": f"""SELECT 'nodes' AS table_name, 2 AS version, count(*) AS n_rows, count(*) FILTER (access_count % 2 = 0) AS n_defaults FROM nodes
        UNION ALL SELECT 'edges', 1, count(*), count(*) FROM edges UNION ALL SELECT 'node_anchors', 1, count(*), 0 FROM node_anchors UNION ALL SELECT 'episodic_traces', 1, count(*), 0 FROM episodic_traces""",
    "service_insert": f"""WITH g AS (SELECT id, count(*) AS c FROM nodes WHERE id <> '' GROUP BY id), e AS (SELECT DISTINCT source_id, target_id, CASE WHEN coalesce(relation_type, '') = '' THEN 'relates_to' ELSE relation_type END AS r FROM edges WHERE coalesce(source_id, '') <> '' AND coalesce(target_id, '') <> ''),
        t AS (SELECT DISTINCT node_id, {anchor('anchor_tag')} AS tag FROM node_anchors WHERE {anchor('anchor_tag')} <> '' AND node_id IN (SELECT id FROM g))
        SELECT (SELECT count(*) FROM g) AS nodes, (SELECT count(*) FROM e) AS edges, (SELECT count(*) FROM t) AS anchors, (SELECT count(*) FROM g) AS with_vector""",
    "service_decay": f"""WITH m AS ({scoped_sql('transient', 0.4, 3600.0 * 480, 86400.0 * 30)}), gone AS (SELECT id FROM m WHERE action = 'archived'), x AS (SELECT * FROM edges WHERE source_id IS NOT NULL AND target_id IS NOT NULL)
        SELECT action AS what, count(*) AS n FROM m GROUP BY 1 UNION ALL SELECT 'edges_pruned', count(*) FROM x WHERE coalesce(weight, 1.0) < 0.05 OR source_id IN (SELECT id FROM gone) OR target_id IN (SELECT id FROM gone)""",
    "service_stats": f"""WITH {CUR}, c AS (SELECT (SELECT count(*) FROM cur) AS v, (SELECT count(*) FROM edges) AS e)
        SELECT 'ok' AS status, v AS nodes, e AS edges, round(2.0 * e / v, 9) AS avg_degree, (SELECT count(*) FROM cur WHERE NOT is_archived) AS active_nodes, TRUE AS has_bytes FROM c""",
}

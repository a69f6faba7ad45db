"""SQL of extraction and fusion, for DuckDB: one trace's rules said as sets over the shredded rows."""

from __future__ import annotations

from loomgraph.operators import extract as X
from loomgraph.plans.graph_sql import CUR, LIMIT_SQL, LINES, SALIENCE, SAMPLED, STAMP, anchor, importance_case, keywords
from loomgraph.plans.nested_sql import GRAPH, WALK, documents

RATE = 0.15


def content_id(prefix: str, seed: str) -> str:
    return f"substr('{prefix}-' || sha256({seed}), 1, 16)"


def cut_off(text: str, most: int) -> str:
    return f"CASE WHEN octet_length(encode({text})) <= {most} THEN {text} ELSE substr({text}, 1, {most}) || '...' END"


def _field(name: str) -> str:
    return f"min_by(val, path) FILTER (tbl = '' AND regexp_matches(path, '(^|\\.){name}$') AND trim(val) <> '')"


_LOG = ", ".join(_field(n) for n in ("executiontrace", "trace", "rawtrace", "logs", "tracepayload"))


def _child(tbl: str, fields: dict[str, str]) -> str:
    picked = ", ".join(f"max(l.val) FILTER (l.path = '{path}') AS {out}" for out, path in fields.items())
    return f"""SELECT c.id, c.row_id, row_number() OVER (PARTITION BY c.id ORDER BY regexp_replace(c.row_id, '\\[[0-9]+\\]$', ''), c.pos) AS o1, {", ".join(fields)}
    FROM cells c LEFT JOIN (SELECT l.id, l.row_id, {picked} FROM leaves l WHERE l.tbl = '{tbl}' GROUP BY 1, 2) l ON l.id = c.id AND l.row_id = c.row_id WHERE c.tbl = '{tbl}' AND c.at_guards = 0"""


def _flag(x: str) -> str:
    return f"coalesce(lower({x}) = 'true', FALSE)"


def _entity(section: int, source: str, kind: str, label: str, summary: str, salience: str, secret: str, ident: str, o1: str = "o1") -> str:
    return f"SELECT trace_id, seen_at, {section} AS section, {o1} AS o1, -1 AS o2, {ident} AS id, {kind} AS entity_type, {label} AS label, {summary} AS summary, {salience} AS salience, {importance_case(kind, label, summary, 'anchored')} AS importance, {secret} AS is_secret FROM {source}"


def _pool(section: int, source: str, owner: str, text: str, most: str, weight: str, salience: str, secret: str, relation: str, note: str, o1: str = "o1", where: str = "TRUE") -> str:
    return f"SELECT trace_id, seen_at, anchored, {section} AS section, {o1} AS o1, {owner} AS owner, {text} AS text, ({most})::INTEGER AS most, {weight} AS weight, {salience} AS salience, {secret} AS secret, '{relation}' AS relation, '{note}' AS note FROM {source} WHERE {where}"


_STEP_TEXT = "concat_ws(' ', thought, action, coalesce(observation, ''))"
_ACT_TEXT = "concat_ws(' ', type, payload_text)"
_WIDE = f"CASE WHEN octet_length(encode(log_text)) > 25000 THEN least(100, floor(({LIMIT_SQL.format('log_text')}) * 1.5)) ELSE {LIMIT_SQL.format('log_text')} END"
_SMALL = f"CASE WHEN regexp_matches(rest, '.') THEN rest ELSE line END"
_OUTCOME = "CASE WHEN lower(trim(coalesce(outcome, ''))) IN ('success', 'completed', 'ok', 'ready') THEN 'success' WHEN lower(trim(coalesce(outcome, ''))) IN ('failure', 'error', 'failed') THEN 'failure' ELSE 'neutral' END"

_ONE = "one AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY created_at NULLS FIRST, session_id NULLS FIRST, task_goal NULLS FIRST, outcome NULLS FIRST, trace_payload NULLS FIRST) AS rn FROM episodic_traces WHERE id IS NOT NULL) WHERE rn = 1)"

#: CTEs up to entities(trace_id, seen_at, section, o1, o2, id, ...), relations(...) and tags(trace_id, anchor_tag).
EXTRACTED = f"""WITH RECURSIVE {_ONE}, {documents("SELECT id, trace_payload AS text FROM one")}, {GRAPH}, {WALK},
head AS (SELECT id, coalesce({_LOG}) AS log_text, coalesce(bool_or(tbl = '' AND regexp_matches(path, '(^|\\.)issecret$') AND lower(val) = 'true'), FALSE) AS secret FROM leaves GROUP BY id),
tags AS (SELECT DISTINCT d.doc_id AS trace_id, {anchor('c.val')} AS anchor_tag FROM cells c JOIN docs d USING (id) WHERE c.tbl = 'anchors' AND c.at_guards = 0 AND {anchor('c.val')} <> ''),
trace AS (SELECT one.id AS trace_id, docs.id, one.created_at AS seen_at, coalesce(session_id, '') AS session_id, CASE WHEN trim(coalesce(task_goal, '')) = '' THEN 'Episodic Task Session ' || coalesce(session_id, '') ELSE trim(task_goal) END AS goal,
  {content_id('task', 'goal')} AS goal_id, {_OUTCOME} AS outcome, ({SALIENCE})::DOUBLE AS s, coalesce(head.secret, FALSE) AS trace_secret, one.id IN (SELECT trace_id FROM tags) AS anchored, head.log_text
  FROM one LEFT JOIN docs ON docs.doc_id = one.id LEFT JOIN head ON head.id = docs.id),
goals AS ({_entity(0, 'trace', "'task_goal'", 'goal', "'Episodic task goal for deliberation session ' || session_id || ' with outcome ' || outcome", 's', 'trace_secret', 'goal_id', '0')}),
steps AS (SELECT t.*, o1, coalesce(thought, '') AS thought, coalesce(action, '') AS action, observation, CASE WHEN regexp_matches(trim(step_index), '^[+-]?[0-9]+$') THEN coalesce(TRY_CAST(step_index AS INTEGER), 0) ELSE 0 END AS idx,
  CASE WHEN trim(coalesce(thought, '')) <> '' THEN trim(thought) ELSE trim(coalesce(action, '')) END AS note, {_flag('secret')} OR trace_secret AS is_secret,
  {content_id('dec', "session_id || '-step-' || idx || '-' || coalesce(action, '')")} AS step_id
  FROM ({_child('trajectory', {"step_index": "stepindex", "thought": "thought", "action": "action", "observation": "observation", "secret": "issecret"})}) c JOIN trace t USING (id) WHERE note <> ''),
decisions AS ({_entity(1, 'steps', "'decision'", f"'Step ' || idx || ': ' || {cut_off('action', 48)}", 'note', f's * {X.S_DECISION}', 'is_secret', 'step_id')}),
payloads AS (SELECT id, parent_row AS row_id, array_to_string(list_sort(list(concat_ws(' ', entry, coalesce(val, '')))), ' ') AS payload_text FROM cells WHERE tbl = 'payload' AND at_guards = 1 GROUP BY 1, 2),
acts AS (SELECT t.*, o1, trim(coalesce(c.type, '')) AS type, 'Action: ' || {cut_off("trim(coalesce(c.type, ''))", 40)} AS label, payload_text, {_flag('committed')} AS committed, {_flag('secret')} OR trace_secret AS is_secret,
  {content_id('act', "session_id || '-act-' || coalesce(aid, '') || '-' || trim(coalesce(c.type, ''))")} AS act_id
  FROM ({_child('candidateactions', {"aid": "id", "type": "type", "committed": "committed", "secret": "issecret"})}) c JOIN trace t USING (id) LEFT JOIN payloads p ON p.id = c.id AND p.row_id = c.row_id WHERE trim(coalesce(c.type, '')) <> ''
  QUALIFY row_number() OVER (PARTITION BY trace_id, lower(label) ORDER BY o1) = 1),
candidates AS ({_entity(2, 'acts', "'candidate_action'", 'label', "'Candidate deliberation action ' || type || ' (committed: ' || CASE WHEN committed THEN 'true' ELSE 'false' END || ')'", f's * {X.S_ACTION}', 'is_secret', 'act_id')}),
chunks AS (SELECT t.*, o1, c.text, coalesce(TRY_CAST(c.salience AS DOUBLE), 0.0) AS c, {cut_off('c.text', 40)} AS label, {_flag('secret')} OR trace_secret AS is_secret, {content_id('sensory', 'c.text')} AS chunk_id
  FROM ({_child('sensorycontext', {"text": "text", "salience": "salience", "secret": "issecret"})}) c JOIN trace t USING (id) WHERE coalesce(TRY_CAST(c.salience AS DOUBLE), 0.0) >= {X.MIN_SALIENCE} AND trim(coalesce(c.text, '')) <> ''
  QUALIFY row_number() OVER (PARTITION BY trace_id, lower(label) ORDER BY o1) = 1),
facts AS ({_entity(3, 'chunks', "'sensory_fact'", 'label', 'text', 'c * s', 'is_secret', 'chunk_id')}),
texts AS (SELECT trace_id AS doc_id, log_text AS text FROM trace WHERE trim(coalesce(log_text, '')) <> ''), {LINES} {SAMPLED},
happenings AS (SELECT t.*, e.o1, e.line, e.kind, e.label, e.event_id, CASE WHEN trim(regexp_replace(e.line, {STAMP}, '')) <> '' THEN trim(regexp_replace(e.line, {STAMP}, '')) ELSE e.line END AS rest FROM events e JOIN trace t ON t.trace_id = e.doc_id),
happened AS ({_entity(4, 'happenings', 'kind', 'label', 'line', f's * {X.S_EVENT}', 'trace_secret', 'event_id')}),
pools AS ({_pool(1, 'steps', 'step_id', _STEP_TEXT, LIMIT_SQL.format(_STEP_TEXT), f's * {X.W_STEP_CONCEPT}', f's * {X.S_CONCEPT}', 'is_secret', 'associates_with', 'Salient concept extracted from episodic deliberation: ')}
  UNION ALL {_pool(2, 'acts', 'act_id', _ACT_TEXT, LIMIT_SQL.format(_ACT_TEXT), f's * {X.W_ACTION_CONCEPT}', f's * {X.S_ACTION_CONCEPT}', 'is_secret', 'associates_with', 'Concept from action payload: ')}
  UNION ALL {_pool(3, 'chunks', 'chunk_id', 'text', LIMIT_SQL.format('text'), f'c * s * {X.W_CHUNK_CONCEPT}', f'c * s * {X.S_CONCEPT}', 'is_secret', 'context_for', 'Sensory context concept: ', where=f'octet_length(encode(text)) > {X.CHUNK_BYTES}')}
  UNION ALL {_pool(4, 'happenings', 'event_id', 'rest', str(X.INCIDENT_KEYWORDS), f's * {X.W_LOG_CONCEPT}', f's * {X.S_CONCEPT}', 'trace_secret', 'associates_with', 'Execution trace concept: ', where="kind = 'incident'")}
  UNION ALL {_pool(5, 'trace', 'goal_id', 'log_text', _WIDE, f's * {X.W_LOG_CONCEPT}', f's * {X.S_CONCEPT}', 'trace_secret', 'associates_with', 'Execution trace concept: ', '0', "trim(coalesce(log_text, '')) <> ''")}),
spoken AS (SELECT trace_id, section, o1, most, unnest(ks) AS keyword, generate_subscripts(ks, 1) - 1 AS o2 FROM (SELECT trace_id, section, o1, most, {keywords('text')} AS ks FROM pools)),
counted AS (SELECT trace_id, section, o1, keyword, any_value(most) AS budget, count(*) AS n, min(o2) AS first_at FROM spoken GROUP BY 1, 2, 3, 4),
kept AS (SELECT trace_id, section, o1, keyword, first_at AS o2 FROM counted QUALIFY row_number() OVER (PARTITION BY trace_id, section, o1 ORDER BY n DESC, first_at) <= budget),
words AS (SELECT p.* EXCLUDE (text, most), k.keyword, k.o2, {content_id('concept', 'k.keyword')} AS id FROM kept k JOIN pools p USING (trace_id, section, o1)),
concepts AS (SELECT trace_id, seen_at, section, o1, o2, id, 'concept' AS entity_type, keyword AS label, note || keyword AS summary, salience, {importance_case("'concept'", 'keyword', "CASE WHEN section IN (2, 3) THEN keyword ELSE note || keyword END", 'anchored')} AS importance, secret AS is_secret FROM words
  QUALIFY row_number() OVER (PARTITION BY trace_id, keyword ORDER BY section, o1, o2) = 1),
entities AS (SELECT * FROM goals UNION ALL SELECT * FROM decisions UNION ALL SELECT * FROM candidates UNION ALL SELECT * FROM facts UNION ALL SELECT * FROM happened UNION ALL SELECT * FROM concepts),
relations AS (SELECT trace_id, seen_at, step_id AS source_id, goal_id AS target_id, 'subgoal_of' AS relation_type, s * {X.W_SUBGOAL} AS weight FROM steps
  UNION ALL SELECT trace_id, seen_at, prev, step_id, 'precedes', s * {X.W_PRECEDES} FROM (SELECT *, lag(step_id) OVER (PARTITION BY trace_id ORDER BY o1) AS prev FROM steps) WHERE prev IS NOT NULL
  UNION ALL SELECT trace_id, seen_at, act_id, goal_id, 'proposed_for', s * {X.W_PROPOSED} FROM acts
  UNION ALL SELECT trace_id, seen_at, chunk_id, goal_id, 'context_for', c * s FROM chunks
  UNION ALL SELECT trace_id, seen_at, event_id, goal_id, CASE WHEN kind = 'procedure' THEN 'subgoal_of' ELSE 'context_for' END, s * {X.W_EVENT} FROM happenings
  UNION ALL SELECT trace_id, seen_at, owner, id, relation, weight FROM words)"""

#: CTEs up to fused_nodes, fused_edges and fused_tags.
FUSED = f"""{EXTRACTED}, {CUR},
keyed AS (SELECT *, lower(trim(label)) AS k_label, lower(trim(entity_type)) AS k_type FROM entities),
per_trace AS (SELECT k_label, k_type, trace_id, min(seen_at) AS seen_at, arg_min({{'id': id, 'label': label, 'entity_type': entity_type, 'salience': salience, 'importance': importance, 'is_secret': is_secret}}, (section, o1, o2)) AS first, sum(salience) AS all_salience, count(*) AS n_rows, max(importance) AS top_importance FROM keyed GROUP BY 1, 2, 3),
per_key AS (SELECT k_label, k_type, arg_min({{'f': first, 'all_salience': all_salience, 'n_rows': n_rows, 'top_importance': top_importance, 'seen_at': seen_at}}, (seen_at, trace_id)) AS c, sum(first.salience) AS firsts, count(*) AS traces, max(seen_at) AS last_at FROM per_trace GROUP BY 1, 2),
live AS (SELECT lower(trim(label)) AS k, entity_type, id FROM cur WHERE NOT is_archived AND trim(label) <> '' QUALIFY row_number() OVER (PARTITION BY k, entity_type ORDER BY stability_score DESC, id) = 1),
matched AS (SELECT p.*, live.id AS match_id FROM per_key p LEFT JOIN live ON live.k = p.k_label AND live.entity_type = p.c.f.entity_type),
gains AS (SELECT match_id, sum(firsts) AS salience, sum(traces) AS n, max(last_at) AS seen_at FROM matched WHERE match_id IS NOT NULL GROUP BY 1),
boosted AS (SELECT cur.id, entity_type, label, access_count + coalesce(n, 0) AS access_count, CASE WHEN n IS NULL THEN stability_score ELSE least(1.0, stability_score + {RATE} * salience) END AS stability_score, importance_score, is_archived AND n IS NULL AS is_archived, created_at, CASE WHEN n IS NULL THEN last_accessed_at ELSE gains.seen_at END AS last_accessed_at FROM cur LEFT JOIN gains ON gains.match_id = cur.id),
fresh AS (SELECT c.f.id AS id, c.f.entity_type AS entity_type, c.f.label AS label, (c.n_rows + traces - 1)::BIGINT AS access_count, least(1.0, least(1.0, CASE WHEN c.f.importance > 0 THEN c.f.importance ELSE 0.5 + 0.5 * c.f.salience END) + {RATE} * (c.all_salience - c.f.salience + firsts - c.f.salience)) AS stability_score, c.top_importance AS importance_score,
  FALSE AS is_archived, c.seen_at AS created_at, CASE WHEN traces > 1 THEN last_at ELSE c.seen_at END AS last_accessed_at FROM matched WHERE match_id IS NULL QUALIFY row_number() OVER (PARTITION BY c.f.id ORDER BY c.seen_at, c.f.label) = 1),
fused_nodes AS (SELECT b.* FROM boosted b WHERE b.id NOT IN (SELECT id FROM fresh)
  UNION ALL SELECT f.id, f.entity_type, f.label, coalesce(b.access_count, f.access_count), f.stability_score, greatest(f.importance_score, coalesce(b.importance_score, f.importance_score)), f.is_archived, coalesce(b.created_at, f.created_at), f.last_accessed_at FROM fresh f LEFT JOIN boosted b ON b.id = f.id),
named AS (SELECT k.trace_id, k.id, min(coalesce(m.match_id, m.c.f.id)) AS canonical_id FROM (SELECT DISTINCT trace_id, id, k_label, k_type FROM keyed) k JOIN matched m USING (k_label, k_type) GROUP BY 1, 2),
deltas AS (SELECT source_id, target_id, relation_type, sum({RATE} * weight * trace_salience) AS delta, max(seen_at) AS seen_at FROM (SELECT coalesce(a.canonical_id, r.source_id) AS source_id, coalesce(b.canonical_id, r.target_id) AS target_id, r.relation_type, r.weight, g.s AS trace_salience, r.seen_at
    FROM relations r JOIN trace g USING (trace_id) LEFT JOIN named a ON a.trace_id = r.trace_id AND a.id = r.source_id LEFT JOIN named b ON b.trace_id = r.trace_id AND b.id = r.target_id) WHERE source_id <> target_id AND coalesce(source_id, '') <> '' AND coalesce(target_id, '') <> '' GROUP BY 1, 2, 3),
old_edges AS (SELECT source_id, target_id, CASE WHEN coalesce(relation_type, '') = '' THEN 'relates_to' ELSE relation_type END AS relation_type, CASE WHEN weight > 0 THEN weight ELSE 1.0 END AS weight FROM edges WHERE coalesce(source_id, '') <> '' AND coalesce(target_id, '') <> ''
  QUALIFY row_number() OVER (PARTITION BY source_id, target_id, CASE WHEN coalesce(relation_type, '') = '' THEN 'relates_to' ELSE relation_type END ORDER BY created_at DESC NULLS LAST, CASE WHEN weight > 0 THEN weight ELSE 1.0 END DESC) = 1),
fused_edges AS (SELECT source_id, target_id, relation_type, CASE WHEN delta IS NULL THEN weight ELSE least(5.0, coalesce(weight, 1.0) + delta) END AS weight FROM old_edges FULL JOIN deltas USING (source_id, target_id, relation_type)),
fused_tags AS (SELECT n.canonical_id AS node_id, t.anchor_tag, min(tr.seen_at) AS created_at FROM tags t JOIN named n USING (trace_id) JOIN trace tr USING (trace_id) GROUP BY 1, 2)"""

_ENTITY_COLUMNS = "trace_id, section::INTEGER AS section, o1::INTEGER AS o1, o2::INTEGER AS o2, id, entity_type, label, summary, round(salience, 6) AS salience, round(importance, 6) AS importance, is_secret"
ORACLE = {
    "extract_entities": f"{EXTRACTED} SELECT {_ENTITY_COLUMNS} FROM entities",
    "extract_relations": f"{EXTRACTED} SELECT trace_id, source_id, target_id, relation_type, round(weight, 6) AS weight FROM relations",
    "fuse_nodes": f"{FUSED} SELECT id, entity_type, label, access_count, round(stability_score, 6) AS stability_score, round(importance_score, 6) AS importance_score, is_archived, created_at, last_accessed_at FROM fused_nodes",
    "fuse_edges": f"{FUSED} SELECT source_id, target_id, relation_type, round(weight, 10) AS weight FROM fused_edges",
    "fuse_anchors": f"{FUSED} SELECT * FROM fused_tags",
}

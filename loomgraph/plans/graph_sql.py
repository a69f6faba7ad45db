"""SQL of the graph queries, for DuckDB."""

from __future__ import annotations

from loomgraph.config import RecallConfig, RecallRequest
from loomgraph.functions import text as T
from loomgraph.operators.recall import B, K1

REF = "2025-03-01 00:00:00"
CUTOFF = "2024-07-01 00:00:00"
_REF = f"TIMESTAMPTZ '{REF}+00'"
_CUT = f"TIMESTAMPTZ '{CUTOFF}+00'"
#: The batch of recall requests; request i asks with the vector of the i-th of the lowest node ids that have 64 dimensions.
REQUESTS = [
    RecallRequest(query="retry policy of the decay scheduler"),
    RecallRequest(query="write-ahead log failure heap_mb", hybrid_alpha=0.3, top_k=12),
    RecallRequest(query="anchor registry restarted together"),
    RecallRequest(query="thermal sensor threshold #project:griipwyn", top_k=9),
    RecallRequest(query="packet buffer dropped messages", mode="bm25", top_k=15),
    RecallRequest(query="embedding service", mode="dense", top_k=15),
    RecallRequest(query="leader election lost its lease", weights=(0.0, 0.0, 0.0, 0.7)),
    RecallRequest(query="drain queue_id shard_no", weights=(0.6, 0.2, 0.2, 0.2), top_k=20),
]
#: Stands for the id of the node whose vector the request has.
OWN = "@own"
MODES = {
    "recall_bm25_topk": [RecallRequest(query="write-ahead log lost its lease", mode="bm25"), RecallRequest(query="queue_id retry_count", mode="bm25")],
    "recall_hybrid_topk": [RecallRequest(query="the memory graph came back", hybrid_alpha=0.5), RecallRequest(query="packet buffer", hybrid_alpha=0.9)],
    "recall_entity_seed": [RecallRequest(query="unrelated words", entity_id=OWN), RecallRequest(entity_id=OWN)],
    "recall_anchor_boost": [RecallRequest(query="certificate chain #project:griipwyn"), RecallRequest(query="edge gateway", anchors=(" Pattern:Breinwyn ",), w_anchor=0.25)],
    "recall_server_preset": [RecallRequest(query="decay scheduler", weights=(0.6, 0.2, 0.2, 0.2)), RecallRequest(query="decay scheduler", weights=(0.0, 0.0, 0.0, 0.5))],
}
WALKING = [RecallRequest(query="trace store", expand_hops=1, min_edge_weight=0.3, attenuation=0.5, relations=("precedes", " subgoal_of ".strip()), top_k=15), RecallRequest(query="fan governor", expand_hops=2, min_edge_weight=0.3, attenuation=0.5, relations=("precedes", "subgoal_of"), top_k=15)]
EXPANDING = [RecallRequest(**{**r.__dict__, "expand_neighbours": True, "top_k": 10}) for r in REQUESTS]
#: Requests that agree in nothing: gates, limits, fields, secrets in both orders, one without expansion.
MIXED = [
    RecallRequest(query="threshold of the sensor", include_secrets=True, expand_neighbours=True, min_edge_weight=0.9, top_k=40),
    RecallRequest(query="threshold of the sensor", expand_neighbours=True, min_edge_weight=0.1, attenuation=0.5, top_k=40),
    RecallRequest(query="memory graph decay", expand_hops=1, relations=("precedes", "subgoal_of"), min_edge_weight=0.3, include_embeddings=True, top_k=25),
    RecallRequest(query="memory graph decay", include_secrets=True, fields=("id", "summary", "Embedding".lower(), "last_accessed_at"), top_k=25),
    RecallRequest(query="queue_id retry_count", fields=("label", "anchors"), expand_neighbours=True, top_k=30),
]
N_VECTORS = len(REQUESTS)

CUR = """
cur AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY last_accessed_at DESC NULLS LAST, access_count DESC NULLS LAST, stability_score DESC NULLS LAST) AS rn FROM nodes WHERE id IS NOT NULL) WHERE rn = 1)"""


def anchor(col: str) -> str:
    c = f"lower(trim(coalesce({col}, '')))"
    return f"CASE WHEN {c} IN ('', '#') THEN '' WHEN {c} LIKE '#%' THEN {c} ELSE '#' || {c} END"


TAGS = f"""
tags AS (SELECT node_id, list_sort(list_distinct(list(tag))) AS anchors FROM (SELECT node_id, {anchor('anchor_tag')} AS tag FROM node_anchors WHERE node_id IS NOT NULL) WHERE tag <> '' GROUP BY node_id)"""


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def all_toks(col: str) -> str:
    """Index tokens with repetitions, in order."""
    stop = ", ".join(map(quoted, T.INDEX_STOP_WORDS))
    return f"list_filter(list_transform(regexp_extract_all({col}, '[a-zA-Z0-9_\\-.:]{{2,}}'), lambda x: lower(trim(x, '.,:;()[]\"''_-'))), lambda x: length(x) >= 2 AND NOT list_contains([{stop}], x))"


def toks(col: str) -> str:
    return f"list_distinct({all_toks(col)})"


def in_order(column: str) -> str:
    """The distinct elements of a list column in the order of their first occurrence."""
    return f"list_filter({column}, lambda x, i: list_position({column}, x) = i)"


INDEX = f"""
idx AS (SELECT c.*, coalesce(t.anchors, []) AS anchors, lower(coalesce(label, '')) AS ll, lower(coalesce(summary, '')) AS ls,
               {toks("lower(coalesce(label, ''))")} AS lt, {toks("lower(coalesce(summary, ''))")} AS st
        FROM cur c LEFT JOIN tags t ON c.id = t.node_id WHERE NOT is_archived),
docs AS (SELECT *, greatest(1.0, 2.0 * len(lt) + len(st)) AS doc_len FROM idx),
postings AS (SELECT id, doc_len, term, CASE WHEN list_contains(lt, term) THEN 2.0 ELSE 0.0 END + CASE WHEN list_contains(st, term) THEN 1.0 ELSE 0.0 END AS tf
             FROM (SELECT id, doc_len, lt, st, unnest(list_distinct(list_concat(lt, st))) AS term FROM docs)),
corpus AS (SELECT count(*) AS n, avg(doc_len) AS avg_len FROM docs)"""


def scores_sql(requests: list[RecallRequest]) -> str:
    """CTEs up to scores(query_no, id, ..., base_score, total_score, w_anchor)."""
    rows, words = [], []
    for i, r in enumerate(x.resolved(RecallConfig()) for x in requests):
        tags = "[" + ", ".join(map(quoted, r.anchors)) + "]::VARCHAR[]"
        rows.append(f"SELECT {i} AS query_no, {quoted(' '.join(r.tokens))} AS phrase, {len(r.tokens)} AS n_tokens, {tags} AS tags, {r.filter_anchors} AS strict, {r.alpha!r}::DOUBLE AS alpha, {r.w_sim!r}::DOUBLE AS w_sim, {r.w_freq!r}::DOUBLE AS w_freq, {r.w_rec!r}::DOUBLE AS w_rec, {r.w_imp!r}::DOUBLE AS w_imp, {r.w_anchor!r}::DOUBLE AS w_anchor, {r.entity_id == OWN} AS own")
        words += [f"({i}, {quoted(t)})" for t in r.tokens]
    return f"""WITH {CUR}, {TAGS}, {INDEX},
q AS ({' UNION ALL '.join(rows)}),
qt AS (SELECT * FROM (VALUES {', '.join(words or ["(-1, '')"])}) AS v(query_no, term)),
vec AS (SELECT row_number() OVER (ORDER BY id) - 1 AS query_no, id, embedding::DOUBLE[] AS v FROM cur WHERE len(embedding) = 64 AND list_dot_product(embedding, embedding) > 0 QUALIFY query_no < {N_VECTORS}),
df AS (SELECT term, count(*) AS n FROM postings WHERE term IN (SELECT term FROM qt) GROUP BY term),
w AS (SELECT qt.query_no, qt.term, greatest(0.1, ln((c.n - df.n + 0.5) / (df.n + 0.5) + 1.0)) * CASE WHEN regexp_matches(qt.term, '[-_.:0-9]') THEN 2.5 ELSE 1.0 END AS weight FROM qt JOIN df ON qt.term = df.term, corpus c),
top_score AS (SELECT query_no, sum(weight * {K1 + 1.0}) AS best FROM w GROUP BY query_no),
lex AS (SELECT w.query_no, p.id, sum(w.weight * (p.tf * {K1 + 1.0}) / (p.tf + {K1} * (1.0 - {B} + {B} * p.doc_len / c.avg_len))) AS raw FROM w JOIN postings p ON w.term = p.term, corpus c GROUP BY 1, 2),
parts AS (SELECT q.*, d.id, d.anchors, d.is_archived,
    CASE WHEN q.own AND d.id = vec.id THEN 1.0 WHEN len(d.embedding) = 64 AND list_dot_product(d.embedding, d.embedding) > 0
         THEN least(1.0, greatest(0.0, list_dot_product(d.embedding::DOUBLE[], vec.v) / sqrt(list_dot_product(d.embedding::DOUBLE[], d.embedding::DOUBLE[]) * list_dot_product(vec.v, vec.v)))) ELSE 0.0 END AS dense_score,
    CASE WHEN q.own AND d.id = vec.id THEN 1.0 ELSE least(1.0, greatest(0.0, coalesce((lex.raw + CASE WHEN q.n_tokens > 1 AND contains(d.ll, q.phrase) THEN 0.35 * t.best WHEN q.n_tokens > 1 AND contains(d.ls, q.phrase) THEN 0.15 * t.best ELSE 0.0 END) / t.best, 0.0))) END AS bm25_score,
    CASE WHEN d.access_count > 0 THEN least(1.0, ln(1.0 + d.access_count) / ln(101.0)) ELSE 0.0 END AS frequency_score,
    CASE WHEN d.last_accessed_at < {_REF} THEN exp(-(epoch_us({_REF}) - epoch_us(d.last_accessed_at)) / 1e6 / 86400.0) ELSE 1.0 END AS recency_score,
    least(1.0, greatest(0.0, d.importance_score)) AS importance_score,
    CASE WHEN d.stability_score > 0 AND d.stability_score <> 1.0 THEN 0.8 + 0.2 * d.stability_score ELSE 1.0 END AS stable,
    CASE WHEN list_has_any(d.anchors, q.tags) THEN 1.0::DOUBLE ELSE 0.0 END AS anchor_score
  FROM docs d, q LEFT JOIN vec ON q.query_no = vec.query_no LEFT JOIN top_score t ON q.query_no = t.query_no LEFT JOIN lex ON lex.query_no = q.query_no AND lex.id = d.id),
simmed AS (SELECT *, alpha * dense_score + (1.0 - alpha) * bm25_score AS sim_score FROM parts WHERE NOT strict OR anchor_score > 0),
based AS (SELECT *, (w_sim * sim_score + w_rec * recency_score + w_imp * importance_score + w_freq * frequency_score) * stable AS base_score FROM simmed),
scores AS (SELECT *, base_score + w_anchor * anchor_score AS total_score FROM based)"""


def expanded_sql(requests: list[RecallRequest]) -> str:
    cfg = RecallConfig()
    resolved = [r.resolved(cfg) for r in requests]
    gates = " UNION ALL ".join(f"SELECT {i} AS query_no, {r.expand} AS follows, {r.min_edge_weight!r}::DOUBLE AS least_weight, {r.boost!r}::DOUBLE AS boost, {r.top_k} AS most, [{', '.join(map(quoted, r.relations))}]::VARCHAR[] AS allowed" for i, r in enumerate(resolved))
    return scores_sql(requests) + f""",
gates AS ({gates}),
seeds AS (SELECT s.query_no, id AS seed, total_score AS seed_score, max(total_score) OVER (PARTITION BY s.query_no) AS top FROM scores s JOIN gates g ON g.query_no = s.query_no AND g.follows QUALIFY row_number() OVER (PARTITION BY s.query_no ORDER BY round(total_score, 9) DESC, id) <= {cfg.pool}),
gated AS (SELECT DISTINCT g.query_no, g.boost, source_id, target_id, relation_type, weight FROM edges JOIN gates g ON g.follows AND source_id <> target_id AND weight >= g.least_weight AND (len(g.allowed) = 0 OR list_contains(g.allowed, relation_type))),
oriented AS (SELECT query_no, boost, source_id AS seed, target_id AS id, weight FROM gated UNION ALL SELECT query_no, boost, target_id, source_id, weight FROM gated),
lifts AS (SELECT s.query_no, o.id, s.seed_score, s.top, o.boost, least(1.0, o.weight) AS pull FROM oriented o JOIN seeds s ON o.seed = s.seed AND o.query_no = s.query_no),
lifted AS (SELECT l.*, c.base_score, c.sim_score, c.base_score + l.boost * l.pull * l.seed_score + c.w_anchor * c.anchor_score AS new FROM lifts l JOIN scores c ON c.query_no = l.query_no AND c.id = l.id WHERE l.seed_score > c.base_score),
capped AS (SELECT query_no, id, max(CASE WHEN sim_score < 0.5 THEN least(new, 0.85 * least(seed_score, top)) WHEN (base_score < seed_score OR base_score < top) AND (new >= seed_score OR new >= top) THEN 0.95 * CASE WHEN top > 0 THEN least(seed_score, top) ELSE seed_score END ELSE new END) AS new FROM lifted GROUP BY 1, 2),
expanded AS (SELECT s.* REPLACE (CASE WHEN c.new > s.total_score THEN c.new ELSE s.total_score END AS total_score), CASE WHEN c.new > s.total_score THEN 1 ELSE 0 END AS hop_distance FROM scores s LEFT JOIN capped c ON s.query_no = c.query_no AND s.id = c.id)"""


def _asks(r: RecallRequest, name: str) -> bool:
    return name in r.fields if r.fields else name != "embedding" or r.include_embeddings


def subgraph_sql(requests: list[RecallRequest], most: int) -> str:
    return expanded_sql(requests) + f""", ret AS (SELECT e.query_no, id FROM expanded e JOIN gates g ON g.query_no = e.query_no QUALIFY row_number() OVER (PARTITION BY e.query_no ORDER BY round(total_score, 9) DESC, id) <= least({most}, any_value(g.most) OVER (PARTITION BY e.query_no)))
        SELECT DISTINCT query_no, source_id, target_id, relation_type FROM gated g WHERE EXISTS (SELECT 1 FROM ret r WHERE r.query_no = g.query_no AND r.id IN (g.source_id, g.target_id)) AND EXISTS (SELECT 1 FROM seeds s WHERE s.query_no = g.query_no AND s.seed IN (g.source_id, g.target_id))"""


_SCORE_COLUMNS = ", ".join(f"round({c}, 6) AS {c}" for c in ("sim_score", "dense_score", "bm25_score", "frequency_score", "recency_score", "importance_score", "anchor_score", "base_score", "total_score"))


def ranked_sql(ctes: str, source: str, k: int, extra: str = "") -> str:
    return ctes + f" SELECT query_no, id, place, {_SCORE_COLUMNS}{extra} FROM (SELECT *, row_number() OVER (PARTITION BY query_no ORDER BY round(total_score, 9) DESC, id) AS place FROM {source}) WHERE place <= {k}"


_MERGED_EDGES = f"""
WITH e AS (SELECT source_id, target_id, CASE WHEN coalesce(relation_type, '') = '' THEN 'relates_to' ELSE relation_type END AS relation_type, CASE WHEN weight > 0 THEN weight ELSE 1.0 END AS weight, created_at, last_reinforced_at, coalesce(created_at >= {_CUT}, FALSE) AS is_new
           FROM edges WHERE coalesce(source_id, '') <> '' AND coalesce(target_id, '') <> ''),
g AS (SELECT source_id, target_id, relation_type, arg_max(weight, (is_new, created_at, weight)) AS weight, max(created_at) AS created_at, arg_max(last_reinforced_at, (is_new, created_at, weight)) FILTER (last_reinforced_at IS NOT NULL) AS last_reinforced_at FROM e GROUP BY 1, 2, 3)
"""

_IDLE = f"greatest(0.0, coalesce((epoch_us({_REF}) - epoch_us(greatest(last_accessed_at, last_reinforced_at))) / 1e6, 0.0))"
_PERIODIC = f"""WITH {CUR},
s AS (SELECT id, is_archived, {_IDLE} AS idle, stability_score FROM cur),
d AS (SELECT *, CASE WHEN is_archived THEN stability_score ELSE stability_score * exp(-ln(2.0) / 259200.0 * idle) END AS new_stability FROM s),
r AS (SELECT id, new_stability, is_archived OR (new_stability < 0.1 AND idle >= 604800) AS is_archived FROM d)
"""


def scoped_sql(scope: str, threshold: float, half_life: float, grace: float) -> str:
    cond = {"all": "TRUE", "unanchored": "TRUE", "session": "contains(coalesce(summary, ''), 'breewyn') OR contains(coalesce(label, ''), 'breewyn')",
            "transient": "importance_score <= 0.5 OR entity_type IN ('sensory_fact', 'telemetry', 'telemetry_chunk', 'telemetry_rule', 'episodic_event', 'noise') OR regexp_matches(lower(label), 'transient|noise|jitter')"}[scope]
    return f"""WITH {CUR},
tagged_n AS (SELECT node_id, count(*) AS c FROM node_anchors WHERE node_id IS NOT NULL GROUP BY node_id),
idle_n AS (SELECT cur.*, coalesce(tagged_n.c, 0) AS anchored, {_IDLE} AS idle FROM cur LEFT JOIN tagged_n ON cur.id = tagged_n.node_id),
faded_n AS (SELECT *, stability_score * exp(-ln(2.0) / {half_life} * idle) AS decayed FROM idle_n),
marked_n AS (SELECT id, CASE WHEN is_archived THEN 'inactive' WHEN anchored > 0 OR importance_score >= 0.8 THEN 'protected' WHEN NOT coalesce({cond}, FALSE) THEN 'out_of_scope'
                 WHEN idle >= {grace} AND (decayed < {threshold} OR importance_score < {threshold}) THEN 'archived' ELSE 'decayed' END AS action, decayed, stability_score FROM faded_n)
SELECT id, action, round(CASE WHEN action IN ('archived', 'decayed') THEN decayed ELSE stability_score END, 9) AS new_stability FROM marked_n"""


def importance_case(kind: str, label: str, summary: str, anchored: str) -> str:
    a, b, t = f"lower(coalesce({label}, ''))", f"lower(coalesce({summary}, ''))", f"lower(trim(coalesce({kind}, '')))"
    score = f"""CASE WHEN {t} IN ('system_config', 'architecture_rule', 'config', 'rule') OR regexp_matches({a}, 'config|architecture|api_key|ingest_port|network bounds') OR regexp_matches({b}, 'system config|architecture rule') THEN 0.90
  WHEN {t} = 'task_goal' OR contains({a}, 'task goal') THEN 0.85
  WHEN {t} IN ('incident', 'error_state') OR regexp_matches({a}, 'error|fatal|incident') THEN 0.80
  WHEN {t} IN ('decision', 'procedure', 'candidate_action', 'action') OR regexp_matches({a}, 'decision|procedure|^step |^action:') THEN 0.75
  WHEN regexp_matches({a}, 'jitter|transient|noise|ephemeral|speculative|debug log') OR regexp_matches({b}, 'transient|ephemeral|jitter') THEN 0.25
  WHEN {t} IN ('sensory_fact', 'telemetry', 'telemetry_chunk', 'telemetry_rule') OR regexp_matches({a}, 'telemetry|sensor') OR contains({b}, 'telemetry') THEN 0.45
  ELSE 0.50 END"""
    return f"round((CASE WHEN {anchored} THEN least(1.0, {score} + 0.15) ELSE {score} END)::DOUBLE, 6)"


def importance_sql() -> str:
    return f"WITH {CUR}, {TAGS} SELECT id, {importance_case('entity_type', 'label', 'summary', 'len(tags.anchors) > 0')} AS importance FROM cur LEFT JOIN tags ON cur.id = tags.node_id"


_KEYWORDS = """list_filter(list_transform(regexp_extract_all(coalesce({0}, ''), '[a-zA-Z0-9_\\-.:]{{3,}}'), lambda x: regexp_replace(lower(trim(x, '.,:;()[]"''{{}}<>/\\|`=-_')), '([_\\-][0-9]+)+$', '')),
  lambda x: length(x) >= 3 AND NOT list_contains([{1}], x) AND length(regexp_replace(x, '[^a-z]', '', 'g')) >= 3 AND NOT regexp_matches(x, '^[0-9.:]+[a-z]{{1,4}}$') AND NOT regexp_matches(x, '^[0-9a-f]*[0-9][0-9a-f]*$'))"""


def keywords(col: str) -> str:
    return _KEYWORDS.format(col, ", ".join(map(quoted, T.KEYWORD_STOP_WORDS)))


LIMIT_SQL = "CASE WHEN octet_length(encode({0})) <= 200 THEN 8 ELSE least(80, 8 + floor(sqrt(octet_length(encode({0}))) * 0.4)) END"
_KIND = "CASE WHEN regexp_matches(lower({0}), 'error|fail|drop|fatal|timeout|panic') THEN 'incident' WHEN regexp_matches(lower({0}), 'temp|fan|pwm|rpm|packet|parquet|crc|telemetry|=') THEN 'telemetry' WHEN regexp_matches(lower({0}), 'start|init|connect|complete|schema|finish') THEN 'procedure' ELSE 'episodic_event' END"
STAMP = "'^[\\[(]?[0-9]{2,4}[-/:.][0-9\\-/:.TZ+]*(?:[ T][0-9]{2}:[0-9]{2}[0-9:.,Z+\\-]*)?[\\])]?\\s+'"
LINES = f"""
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM texts),
n AS (SELECT doc_id, trim(raw) AS line, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS line_no FROM l WHERE octet_length(encode(trim(raw))) >= 8),
k AS (SELECT *, {_KIND.format('line')} AS kind, CASE WHEN trim(regexp_replace(line, {STAMP}, '')) <> '' THEN trim(regexp_replace(line, {STAMP}, '')) ELSE line END AS rest FROM n),
lab AS (SELECT *, CASE WHEN octet_length(encode(rest)) <= 48 THEN rest ELSE substr(rest, 1, 48) || '...' END AS label FROM k)
"""
SALIENCE = "CASE WHEN lower(trim(coalesce(outcome, ''))) IN ('success', 'completed', 'ok', 'ready') THEN 1.0 WHEN lower(trim(coalesce(outcome, ''))) IN ('failure', 'error', 'failed') THEN 0.1 ELSE 0.5 END"
LEXICAL_QUERY = ["retry", "policy", "queue"]


def lexical_sql() -> str:
    terms = " + ".join(f"CASE WHEN list_contains(lt, {quoted(q)}) THEN 2.0 WHEN contains(ll, {quoted(q)}) THEN 1.2 WHEN list_contains(st, {quoted(q)}) THEN 1.0 WHEN contains(ls, {quoted(q)}) THEN 0.5 ELSE 0.0 END" for q in LEXICAL_QUERY)
    p = quoted(" ".join(LEXICAL_QUERY))
    return f"""WITH {CUR}, {TAGS}, {INDEX}, r AS (SELECT id, ll, ls, least(1.0, ({terms}) / {2.0 * len(LEXICAL_QUERY)}) AS ratio FROM docs)
SELECT id, round(CASE WHEN contains(ll, {p}) THEN greatest(ratio, 0.95) WHEN contains(ls, {p}) THEN greatest(ratio, 0.8) ELSE ratio END, 4) AS lexical FROM r"""


_SCORED = scores_sql(REQUESTS)
_GROWN = expanded_sql(EXPANDING)
_FILTERED = scores_sql([RecallRequest(query="threshold of the sensor", anchors=("project:griipwyn", "#pattern:breinwyn"), anchor_mode="filter", top_k=30)])

SAMPLED = """, d AS (SELECT doc_id, octet_length(encode(text)) AS size FROM texts),
b AS (SELECT lab.*, lower(label) AS low, CASE WHEN kind = 'incident' THEN 0 ELSE 1 END AS late, CASE WHEN size < 3000 THEN 3 WHEN size < 25000 THEN 10 WHEN size < 100000 THEN 25 ELSE 40 END AS budget FROM lab JOIN d USING (doc_id)),
u AS (SELECT * FROM b QUALIFY late = 1 OR row_number() OVER (PARTITION BY doc_id, late, low ORDER BY line_no) = 1),
c AS (SELECT *, budget - count(*) FILTER (late = 0) OVER (PARTITION BY doc_id) AS spare, count(*) FILTER (late = 1) OVER (PARTITION BY doc_id) AS others, row_number() OVER (PARTITION BY doc_id, late ORDER BY line_no) - 1 AS j FROM u),
s AS (SELECT * FROM c WHERE late = 0 OR (spare > 0 AND j % (CASE WHEN others > spare THEN others // greatest(spare, 1) ELSE 1 END) = 0)),
f AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY doc_id, low, kind ORDER BY late, line_no) = 1),
events AS (SELECT doc_id, line_no, line, kind, label, substr('evt-' || sha256(line || '-' || line_no), 1, 16) AS event_id, row_number() OVER (PARTITION BY doc_id ORDER BY late, line_no) AS o1 FROM f QUALIFY o1 <= budget)"""

ORACLE = {
    "trace_line_sample": "WITH texts AS (SELECT doc_id, text FROM documents)," + LINES + SAMPLED + " SELECT doc_id, line_no, kind, label, event_id FROM events",
    "expand_relation_filter": ranked_sql(expanded_sql(WALKING), "expanded", 15, ", hop_distance"),
    **{name: ranked_sql(scores_sql(requests), "scores", 25) for name, requests in MODES.items()},
    "active_headers": f"WITH {CUR}, {TAGS} SELECT id, entity_type, access_count, round(importance_score, 6) AS importance_score, array_to_string(coalesce(anchors, []), ' ') AS anchors, round(sqrt(coalesce(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]), 0.0)), 4) AS magnitude FROM cur LEFT JOIN tags ON cur.id = tags.node_id WHERE NOT is_archived",
    "multi_get": f"WITH {CUR}, {TAGS} SELECT id, entity_type, label, is_archived, array_to_string(coalesce(anchors, []), ' ') AS anchors FROM cur LEFT JOIN tags ON cur.id = tags.node_id WHERE id IN (SELECT DISTINCT node_id FROM scored_nodes)",
    **{name: f"WITH i AS (SELECT DISTINCT node_id AS id FROM {t} WHERE node_id IS NOT NULL) SELECT source_id, target_id, relation_type, weight FROM edges WHERE source_id IN (SELECT id FROM i) OR target_id IN (SELECT id FROM i)" for name, t in (("incident_edges", "node_anchors"), ("incident_edges_scored", "scored_nodes"))},
    "find_matching_node": f"WITH {CUR}, p AS (SELECT DISTINCT trim(label) AS label, entity_type FROM nodes), m AS (SELECT lower(trim(label)) AS k, entity_type, id, row_number() OVER (PARTITION BY lower(trim(label)), entity_type ORDER BY stability_score DESC, id) AS rn FROM cur WHERE NOT is_archived AND trim(label) <> '') SELECT p.label, p.entity_type, m.id AS match_id FROM p LEFT JOIN m ON lower(p.label) = m.k AND p.entity_type = m.entity_type AND rn = 1",
    "anchors_by_node": f"WITH {TAGS} SELECT node_id, array_to_string(anchors, ' ') AS anchors FROM tags",
    "nodes_by_anchor": f"SELECT DISTINCT node_id FROM node_anchors WHERE {anchor('anchor_tag')} IN ('#project:griipwyn', '#pattern:breinwyn')",
    "anchor_normalize": f"SELECT DISTINCT anchor_tag, {anchor('anchor_tag')} AS normal FROM node_anchors",
    "upsert_nodes": f"""WITH r AS (SELECT * REPLACE (CASE WHEN coalesce(last_accessed_at < {_CUT}, TRUE) OR stability_score > 0 THEN stability_score ELSE 1.0 END AS stability_score, CASE WHEN coalesce(last_accessed_at < {_CUT}, TRUE) OR importance_score > 0 THEN importance_score ELSE 0.5 END AS importance_score) FROM nodes WHERE id <> ''),
        g AS (SELECT id, arg_max(label, (last_accessed_at, access_count, stability_score)) AS label, arg_max(is_archived, (last_accessed_at, access_count, stability_score)) AS is_archived, max(last_accessed_at) AS last_accessed_at, round(arg_max(stability_score, (last_accessed_at, access_count, stability_score)), 6) AS stability_score, max(importance_score) AS importance_score,
              arg_min(access_count, (last_accessed_at, access_count, stability_score)) AS access_count, min(created_at) AS created_at, arg_max(last_reinforced_at, (last_accessed_at, access_count, stability_score)) FILTER (last_reinforced_at IS NOT NULL) AS last_reinforced_at FROM r GROUP BY id) SELECT * FROM g""",
    "upsert_edges": _MERGED_EDGES + "SELECT * FROM g",
    "attach_anchors": f"SELECT node_id, {anchor('anchor_tag')} AS anchor_tag, min(created_at) AS created_at FROM node_anchors WHERE {anchor('anchor_tag')} <> '' AND node_id IN (SELECT id FROM nodes) GROUP BY 1, 2",
    "record_access": f"WITH {CUR}, h AS (SELECT node_id, count(*) AS c FROM scored_nodes GROUP BY 1) SELECT id, access_count + coalesce(c, 0) AS access_count, CASE WHEN c IS NULL THEN last_accessed_at ELSE {_REF} END AS last_accessed_at FROM cur LEFT JOIN h ON id = node_id",
    "reinforce_edges": _MERGED_EDGES + """, d AS (SELECT source_id, target_id, relation_type, sum(0.1 * weight) AS delta FROM e WHERE is_new GROUP BY 1, 2, 3),
        old AS (SELECT source_id, target_id, relation_type, arg_max(weight, (created_at, weight)) AS weight FROM e WHERE NOT is_new GROUP BY 1, 2, 3)
        SELECT source_id, target_id, relation_type, round(CASE WHEN d.delta IS NULL THEN old.weight ELSE least(5.0, coalesce(old.weight, 1.0) + d.delta) END, 6) AS weight FROM old FULL JOIN d USING (source_id, target_id, relation_type)""",
    "boost_stability": f"WITH {CUR}, b AS (SELECT node_id, sum(0.15 * importance_score) AS d, count(*) AS c FROM scored_nodes WHERE hop_distance = 0 GROUP BY 1) SELECT id, round(CASE WHEN c IS NULL THEN stability_score ELSE least(1.0, stability_score + d) END, 6) AS stability_score, access_count + coalesce(c, 0) AS access_count, is_archived AND c IS NULL AS is_archived FROM cur LEFT JOIN b ON id = node_id",
    "decay_periodic": _PERIODIC + "SELECT id, round(new_stability, 9) AS stability_score, is_archived FROM r",
    "prune_edges": _PERIODIC + "SELECT source_id, target_id, relation_type, weight FROM edges WHERE weight >= 0.05 AND source_id NOT IN (SELECT id FROM r WHERE is_archived) AND target_id NOT IN (SELECT id FROM r WHERE is_archived)",
    "decay_scope_all": scoped_sql("all", 0.8, 259200.0, 0.0),
    "decay_scope_unanchored": scoped_sql("unanchored", 0.5, 3600.0 * 240, 86400.0 * 60),
    "decay_scope_transient": scoped_sql("transient", 0.4, 3600.0 * 480, 86400.0 * 30),
    "decay_scope_session": scoped_sql("session", 0.8, 259200.0, 0.0),
    "pending_traces": "SELECT id, session_id, created_at FROM (SELECT DISTINCT id, session_id, created_at FROM episodic_traces WHERE NOT consolidated) ORDER BY created_at, id LIMIT 100",
    "queue_traces": f"SELECT id, min(session_id) AS session_id, arg_min(consolidated, (coalesce(created_at >= {_CUT}, FALSE), created_at, NOT consolidated)) AS consolidated, min(created_at) AS created_at, arg_max(CASE WHEN coalesce(created_at >= {_CUT}, FALSE) AND coalesce(outcome, '') = '' THEN 'neutral' ELSE outcome END, (coalesce(created_at >= {_CUT}, FALSE), created_at, CASE WHEN coalesce(created_at >= {_CUT}, FALSE) AND coalesce(outcome, '') = '' THEN 'neutral' ELSE outcome END, task_goal)) AS outcome FROM episodic_traces WHERE id IS NOT NULL GROUP BY id",
    "mark_consolidated": f"SELECT id, count(*) AS n_rows, bool_and(consolidated OR coalesce(created_at < {_CUT}, TRUE)) AS consolidated FROM episodic_traces GROUP BY id",
    "graph_summary": "WITH c AS (SELECT (SELECT count(DISTINCT id) FROM nodes) AS v, (SELECT count(*) FROM edges) AS e) SELECT v AS total_nodes, e AS total_edges, round(2.0 * e / v, 9) AS avg_degree, round(e / (v * (v - 1.0)), 12) AS density FROM c",
    "entity_histogram": f"WITH {CUR} SELECT entity_type, count(*) AS n_nodes FROM cur GROUP BY 1",
    "consolidation_stats": f"WITH {CUR} SELECT (SELECT count(*) FROM cur WHERE NOT is_archived) AS active_nodes, (SELECT count(*) FROM cur WHERE is_archived) AS archived_nodes, round((SELECT avg(stability_score) FROM cur WHERE NOT is_archived), 9) AS avg_stability, (SELECT count(*) FROM edges) AS total_edges, round((SELECT avg(weight) FROM edges), 6) AS avg_weight, (SELECT count(*) FROM episodic_traces WHERE consolidated) AS consolidated_traces, (SELECT count(*) FROM episodic_traces WHERE NOT consolidated) AS pending_traces",
    "tokens": f"SELECT doc_id, unnest({toks('text')}) AS token FROM documents",
    "doc_freq": f"WITH {CUR}, {TAGS}, {INDEX} SELECT term, count(*) AS df FROM postings GROUP BY term",
    "doc_length": f"WITH {CUR}, {TAGS}, {INDEX} SELECT count(*) AS n_docs, sum(doc_len::DOUBLE) AS sum_len, round(avg(doc_len), 9) AS avg_len FROM docs",
    "keyword_topn": f"""WITH d AS (SELECT doc_id, {keywords('text')} AS ks, {LIMIT_SQL.format('text')} AS most FROM documents),
        t AS (SELECT doc_id, most, unnest(ks) AS keyword, generate_subscripts(ks, 1) AS pos FROM d),
        c AS (SELECT doc_id, keyword, any_value(most) AS most, count(*) AS n, min(pos) AS first_pos FROM t GROUP BY 1, 2)
        SELECT doc_id, keyword, n FROM c QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first_pos) <= most""",
    "trace_line_class": "WITH texts AS (SELECT doc_id, text FROM documents)," + LINES + "SELECT doc_id, line_no, kind, label FROM lab",
    "outcome_salience": f"SELECT outcome, round(({SALIENCE})::DOUBLE, 3) AS salience, count(*) AS n_traces FROM episodic_traces GROUP BY 1, 2",
    "content_ids": "SELECT DISTINCT session_id, substr('task-' || sha256(CASE WHEN trim(coalesce(task_goal, '')) = '' THEN 'Episodic Task Session ' || coalesce(session_id, '') ELSE trim(task_goal) END), 1, 16) AS goal_id FROM episodic_traces",
    "importance_score": importance_sql(),
    "lexical_score": lexical_sql(),
    "freq_score": f"WITH {CUR} SELECT id, round(CASE WHEN access_count > 0 THEN least(1.0, ln(1.0 + access_count) / ln(101.0)) ELSE 0.0 END, 9) AS frequency FROM cur WHERE NOT is_archived",
    "recency_score": f"WITH {CUR} SELECT id, round(CASE WHEN last_accessed_at < {_REF} THEN exp(-(epoch_us({_REF}) - epoch_us(last_accessed_at)) / 1e6 / 2592000.0) ELSE 1.0 END, 9) AS recency FROM cur WHERE NOT is_archived",
    "recall_batch_rank": ranked_sql(_SCORED, "scores", 20),
    "recall_full_score": _SCORED + f" SELECT query_no, id, {_SCORE_COLUMNS} FROM scores",
    "recall_anchor_filter": ranked_sql(_FILTERED, "scores", 30),
    "recall_expanded": ranked_sql(_GROWN, "expanded", 10, ", hop_distance"),
    "expand_edges_gated": _GROWN + " SELECT DISTINCT source_id, target_id, relation_type, round(weight, 6) AS weight FROM gated g WHERE EXISTS (SELECT 1 FROM seeds s WHERE s.query_no = g.query_no AND s.seed IN (g.source_id, g.target_id))",
    "subgraph_edges": subgraph_sql(EXPANDING, 10),
    "recall_mixed_edges": subgraph_sql(MIXED, 100),
    "recall_mixed_batch": expanded_sql(MIXED) + f""", f AS (SELECT * FROM (VALUES {', '.join(f"({i}, {r.include_secrets}, {_asks(r, 'summary')}, {_asks(r, 'label')}, {_asks(r, 'embedding') and (r.include_embeddings or bool(r.fields))}, {_asks(r, 'anchors')}, {_asks(r, 'last_accessed_at')})" for i, r in enumerate(MIXED))}) AS v(query_no, open, s, l, e, a, t)),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_no ORDER BY round(total_score, 9) DESC, id) AS place FROM expanded)
        SELECT r.query_no, r.id, r.place, CASE WHEN r.query_no IN ({', '.join(str(i) for i, r in enumerate(MIXED) if not r.fields) or '-1'}) THEN r.hop_distance END AS hop_distance, CASE WHEN r.query_no IN ({', '.join(str(i) for i, r in enumerate(MIXED) if not r.fields) or '-1'}) THEN round(r.total_score, 4) END AS total_score,
          CASE WHEN f.s THEN CASE WHEN (cur.is_secret OR coalesce(cur.summary LIKE 'enc:v1:%', FALSE)) AND NOT f.open THEN '[REDACTED_SECRET]' ELSE cur.summary END END AS summary, CASE WHEN f.l THEN cur.label END AS label, f.e AND cur.embedding IS NOT NULL AS has_vector, f.a AND len(r.anchors) > 0 AS has_anchors, CASE WHEN f.t THEN cur.last_accessed_at END AS last_accessed_at
        FROM r JOIN gates g ON g.query_no = r.query_no AND r.place <= g.most JOIN f ON f.query_no = r.query_no JOIN cur ON cur.id = r.id""",
    "recall_dense_topk": """WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 20 = 0), d AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
        s AS (SELECT query_id, vec_id, round(least(1.0, greatest(0.0, list_dot_product(v, e) / sqrt(list_dot_product(v, v) * list_dot_product(e, e)))), 6) AS cosine FROM q, d)
        SELECT query_id, vec_id, cosine, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, vec_id) AS place FROM s QUALIFY place <= 20""",
    "secret_mask": f"WITH {CUR} SELECT id, CASE WHEN is_secret OR summary LIKE 'enc:v1:%' THEN '[REDACTED_SECRET]' ELSE summary END AS summary FROM cur",
}

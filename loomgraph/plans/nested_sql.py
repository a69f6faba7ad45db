"""SQL of the nested documents, for DuckDB: the schema graph and the shredded rows by recursive walks.

CTEs: ``tree`` (values by type), ``graph``, ``own_tables``, ``walk``, ``cells`` (rows) and ``leaves`` (row, path, value).
"""

from __future__ import annotations

LISTS = "('trajectory', 'sensorycontext', 'candidateactions')"


def unwrapped(x: str) -> str:
    """A string that holds a JSON object, list or string stands for it."""
    return f"CASE WHEN json_type({x}) = 'VARCHAR' AND regexp_matches({x} ->> '$', '^\\s*[{{\\[\"]') THEN coalesce(TRY_CAST(({x} ->> '$') AS JSON), {x}) ELSE {x} END"


def folded(x: str) -> str:
    return f"lower(replace({x}, '_', ''))"


def scalar(x: str) -> str:
    return f"CASE json_type({x}) WHEN 'NULL' THEN NULL WHEN 'VARCHAR' THEN {x} ->> '$' ELSE {x}::VARCHAR END"


def _children(source: str) -> str:
    """Entries of each container, values unwrapped (twice)."""
    return f"""(SELECT w.*, e.key AS nm, e.value AS v0 FROM {source} w, LATERAL json_each(w.j) e WHERE w.j IS NOT NULL AND json_type(w.j) IN ('OBJECT', 'ARRAY'))"""


def _opened(source: str) -> str:
    return f"(SELECT * EXCLUDE (v0, v1), {unwrapped('v1')} AS v, json_type(v) AS t, json_type(j) AS wt, {folded('nm')} AS k FROM (SELECT *, {unwrapped('v0')} AS v1 FROM {source}))"


def documents(rows: str) -> str:
    """CTE ``docs`` (id, doc_id, j) of (id, text) rows; ``id`` numbers the documents, since ids may repeat."""
    return f"docs AS (SELECT row_number() OVER () AS id, id AS doc_id, {unwrapped('j0')} AS j FROM (SELECT id, TRY_CAST(ltrim(text, chr(65279)) AS JSON) AS j0 FROM ({rows})) WHERE j0 IS NOT NULL)"


GRAPH = f"""
tree AS (SELECT id, '' AS kind, j, FALSE AS holds, FALSE AS listed, 0 AS most, NULL::VARCHAR AS parent FROM docs
  UNION ALL
  SELECT id, CASE WHEN wt = 'OBJECT' THEN k ELSE kind END, v,
         t = 'OBJECT' OR (t = 'ARRAY' AND len(list_filter(from_json(v, '["JSON"]'), lambda x: json_type({unwrapped('x')}) = 'OBJECT')) > 0),
         t = 'ARRAY', CASE WHEN t = 'ARRAY' THEN json_array_length(v)::INTEGER ELSE 1 END, CASE WHEN wt = 'OBJECT' THEN kind END
  FROM {_opened(_children('tree'))} WHERE wt = 'OBJECT' OR t IN ('OBJECT', 'ARRAY')),
graph AS (SELECT parent, kind AS child, bool_or(holds) AS holds, bool_or(listed) AS listed, max(most)::BIGINT AS most, count(*) AS n FROM tree WHERE parent IS NOT NULL GROUP BY 1, 2),
reach AS (SELECT parent AS a, child AS b FROM graph UNION SELECT r.a, g.child FROM reach r JOIN graph g ON r.b = g.parent),
own_tables AS (SELECT child AS k FROM graph GROUP BY child HAVING (bool_or(listed) OR (bool_or(holds) AND (count(DISTINCT parent) > 1 OR child IN (SELECT a FROM reach WHERE a = b)))) AND child <> 'payload'
  UNION SELECT unnest(['trajectory', 'sensorycontext', 'candidateactions']))"""

_TABLE = "EXISTS (SELECT 1 FROM own_tables o WHERE o.k = c.k)"
_HERE = "row_id || '/' || spelt || nm"
_LISTED = "c.tabled AND wt = 'OBJECT' AND t = 'ARRAY' AND kind NOT IN ('list', 'entries')"
_LONE = "c.tabled AND wt = 'OBJECT' AND t = 'OBJECT' AND kind NOT IN ('list', 'entries')"
_ENTRIES = "wt = 'OBJECT' AND c.k = 'payload' AND t = 'OBJECT' AND kind NOT IN ('list', 'entries')"
_NESTED = "t IN ('OBJECT', 'ARRAY')"
_POS = "CASE WHEN kind = 'list' THEN nm::BIGINT WHEN kind = 'entries' THEN list_position(json_keys(j), nm) - 1 ELSE 0 END"
WALK = f"""
walk AS (SELECT id, 'row' AS kind, j, '' AS path, '' AS spelt, '' AS row_id, '' AS tbl, 0 AS guards, 0 AS at_guards, 0::BIGINT AS pos, '' AS via, NULL::VARCHAR AS parent_table, NULL::VARCHAR AS parent_row, '' AS here, NULL::VARCHAR AS val, NULL::VARCHAR AS entry, NULL::VARCHAR AS vkind FROM docs
  UNION ALL
  SELECT id,
    CASE WHEN kind IN ('list', 'entries') THEN 'row' WHEN {_ENTRIES} THEN 'entries' WHEN {_LISTED} THEN 'list' WHEN {_LONE} THEN 'row' WHEN {_NESTED} THEN 'obj' ELSE 'leaf' END AS kind,
    CASE WHEN kind = 'entries' THEN CASE WHEN {_NESTED} THEN json_object(nm, v) END WHEN {_NESTED} THEN v END AS j,
    CASE WHEN kind IN ('list', 'entries') OR {_LONE} THEN '' WHEN {_ENTRIES} OR {_LISTED} THEN path WHEN wt = 'ARRAY' THEN path || nm || CASE WHEN {_NESTED} THEN '.' ELSE '' END ELSE path || k || CASE WHEN {_NESTED} THEN '.' ELSE '' END END AS path,
    CASE WHEN kind IN ('list', 'entries') OR {_LONE} THEN '' WHEN {_ENTRIES} OR {_LISTED} THEN spelt ELSE spelt || nm || '.' END AS spelt,
    CASE WHEN kind IN ('list', 'entries') THEN here || '[' || {_POS} || ']' WHEN {_LONE} AND NOT ({_ENTRIES}) THEN {_HERE} || '[0]' ELSE row_id END AS row_id,
    CASE WHEN kind = 'list' THEN entry WHEN kind = 'entries' THEN 'payload' WHEN {_LONE} AND NOT ({_ENTRIES}) THEN k ELSE tbl END AS tbl,
    guards + CASE WHEN (kind = 'list' AND entry IN {LISTS}) OR ({_LONE} AND k IN {LISTS}) THEN 1 ELSE 0 END AS guards,
    guards AS at_guards, {_POS} AS pos,
    CASE WHEN kind IN ('list', 'entries') THEN via ELSE path END AS via,
    CASE WHEN kind IN ('list', 'entries') THEN parent_table ELSE tbl END AS parent_table,
    CASE WHEN kind IN ('list', 'entries') THEN parent_row ELSE row_id END AS parent_row,
    CASE WHEN {_ENTRIES} OR {_LISTED} THEN {_HERE} ELSE '' END AS here,
    CASE WHEN {_NESTED} THEN NULL ELSE {scalar('v')} END AS val,
    CASE WHEN kind = 'entries' THEN nm WHEN {_LISTED} THEN k END AS entry,
    CASE t WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'list' WHEN 'VARCHAR' THEN 'string' WHEN 'NULL' THEN 'null' WHEN 'BOOLEAN' THEN 'boolean' ELSE 'number' END AS vkind
  FROM (SELECT c0.*, k IN (SELECT k FROM own_tables) AS tabled FROM {_opened(_children('walk'))} c0) c
  WHERE NOT (kind = 'list' AND t = 'NULL') AND NOT (kind <> 'list' AND wt = 'ARRAY' AND t = 'NULL')),
cells AS (SELECT * FROM walk WHERE kind = 'row'),
leaves AS (SELECT id, tbl, row_id, path, val FROM walk WHERE kind = 'leaf'
  UNION ALL SELECT id, tbl, row_id, 'value', val FROM walk WHERE kind = 'row' AND j IS NULL AND tbl <> 'payload')"""

TRACES = "SELECT id, trace_payload AS text FROM episodic_traces"


def nested(select: str, rows: str = TRACES) -> str:
    return f"WITH RECURSIVE {documents(rows)}, {GRAPH}, {WALK} {select}"


_NAMES = "CASE tbl WHEN 'trajectory' THEN 'trajectory' WHEN 'sensorycontext' THEN 'sensory_context' ELSE 'candidate_actions' END"


def flat(name: str, columns: dict[str, str]) -> str:
    """One table with the named leaves beside each row."""
    picked = ", ".join(f"max(val) FILTER (path = '{path}') AS {out}" for out, path in columns.items())
    return nested(
        f""", l AS (SELECT id, row_id, {picked} FROM leaves WHERE tbl = '{name}' GROUP BY 1, 2)
        SELECT d.doc_id, c.row_id, c.parent_table, c.parent_row, c.pos, {", ".join(f"l.{out}" for out in columns)}
        FROM cells c JOIN docs d ON d.id = c.id LEFT JOIN l ON l.id = c.id AND l.row_id = c.row_id WHERE c.tbl = '{name}'"""
    )


_ROW = "d.doc_id, c.tbl AS table_name, c.row_id, c.parent_table, c.parent_row, c.pos"
FOUND = nested(
    f""" SELECT DISTINCT doc_id AS trace_id, {_NAMES} AS list_name, pos, '' AS payload_key FROM cells JOIN docs USING (id) WHERE tbl IN {LISTS} AND at_guards = 0
    UNION SELECT DISTINCT doc_id, 'candidate_actions', regexp_extract(parent_row, '\\[(\\d+)\\]$', 1)::BIGINT, entry FROM cells JOIN docs USING (id) WHERE tbl = 'payload' AND parent_table = 'candidateactions' AND at_guards = 1 AND via = ''"""
)
SCHEMA = f"WITH RECURSIVE {documents(TRACES)}, {GRAPH} SELECT * FROM graph"
PAYLOAD = nested(
    """ SELECT d.doc_id, c.row_id, c.parent_table, c.parent_row, c.pos, c.entry AS payload_key, c.vkind AS kind, '' AS path, c.val AS plain_value FROM cells c JOIN docs d ON d.id = c.id WHERE c.tbl = 'payload'
    UNION ALL SELECT d.doc_id, c.row_id, c.parent_table, c.parent_row, c.pos, c.entry, c.vkind, l.path, l.val FROM cells c JOIN docs d ON d.id = c.id JOIN leaves l ON l.id = c.id AND l.row_id = c.row_id AND l.tbl = 'payload' WHERE c.tbl = 'payload'"""
)
ELEMENTS = nested(
    f""" SELECT {_ROW}, l.path, l.val AS plain_value FROM cells c JOIN docs d ON d.id = c.id LEFT JOIN leaves l ON l.id = c.id AND l.row_id = c.row_id AND l.tbl = c.tbl
    WHERE c.tbl NOT IN ('', 'payload') AND c.tbl NOT IN {LISTS}"""
)

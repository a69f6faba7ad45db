"""SQL of the llm queries that SQL can express on whole tables."""

_VECTORS = """
WITH v AS (SELECT id, any_value(embedding)::DOUBLE[] AS e FROM nodes WHERE embedding IS NOT NULL AND id IS NOT NULL GROUP BY id),
u AS (SELECT id, e, sqrt(list_dot_product(e, e)) AS norm FROM v WHERE len(e) > 0 AND list_dot_product(e, e) > 0),
pairs AS (
  SELECT a.id, b.id AS other, list_dot_product(a.e, b.e) / (a.norm * b.norm) AS cosine
  FROM u a JOIN u b ON len(a.e) = len(b.e) AND a.id <> b.id
  WHERE CASE WHEN len(a.e) = len(b.e) THEN list_dot_product(a.e, b.e) / (a.norm * b.norm) END >= 0.97),
ranked AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(cosine, 12) DESC, other) AS place FROM pairs)
"""

_WORDS = """
WITH t AS (SELECT id, list_sort(list_distinct(regexp_extract_all(lower(any_value(coalesce(label, '') || ' ' || coalesce(summary, ''))), '[\\p{L}\\p{N}]+'))) AS w
           FROM nodes WHERE id IS NOT NULL GROUP BY id),
words AS (SELECT id, len(w) AS n, unnest(w) AS word FROM t),
common AS (SELECT a.id AS id_a, b.id AS id_b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c
           FROM words a JOIN words b ON a.word = b.word AND a.id < b.id AND a.n * 10 >= b.n * 7 AND b.n * 10 >= a.n * 7 GROUP BY 1, 2)
"""

_NAMES = ("sim_score", "bm25_score", "frequency_score", "recency_score")
_CANDIDATES = f"""
WITH c AS (SELECT query_id, node_id, {", ".join(f"max(CASE WHEN NOT isnan({s}) THEN {s} END) AS {s}" for s in _NAMES)}
           FROM scored_nodes GROUP BY query_id, node_id)
"""


def _wins(x: str, y: str) -> str:
    return " + ".join(f"({x}.{s} IS NOT NULL AND ({y}.{s} IS NULL OR {x}.{s} > {y}.{s}))::INT" for s in _NAMES)


_RANKS = _CANDIDATES + f""",
r AS (SELECT query_id, node_id, {", ".join(f"count(*) OVER (PARTITION BY query_id ORDER BY {s} DESC NULLS LAST RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::DOUBLE / count(*) OVER (PARTITION BY query_id) AS r_{s}" for s in _NAMES)} FROM c),
o AS (SELECT *, list_sort([{", ".join(f"r_{s}" for s in _NAMES)}]) AS s FROM r),
p AS (SELECT query_id, node_id, (s[1] + s[2] + s[3] + s[4]) / 4 AS mean_rank,
             least(1 - (1 - s[1]) ** 4,
                   6 * s[2] ** 2 * (1 - s[2]) ** 2 + 4 * s[2] ** 3 * (1 - s[2]) + s[2] ** 4,
                   4 * s[3] ** 3 * (1 - s[3]) + s[3] ** 4,
                   s[4] ** 4) * 4 AS tail FROM o),
q AS (SELECT query_id, node_id, least(1.0, round(tail, 12)) AS rho, round(mean_rank, 12) AS mean_rank FROM p)
"""

#: SQL has no compatibility normalisation; of what it does, these texts need the full-width letters and digits only.
_WIDE = [chr(c) for lo, hi in ((0xFF10, 0xFF19), (0xFF21, 0xFF3A), (0xFF41, 0xFF5A)) for c in range(lo, hi + 1)]
_PLAIN = f"regexp_extract_all(lower(translate(nfc_normalize(regexp_replace({{0}}, '[\\p{{{{Cf}}}}]', '', 'g')), '{''.join(_WIDE)}', '{''.join(chr(ord(c) - 0xFEE0) for c in _WIDE)}')), '[\\p{{{{L}}}}\\p{{{{N}}}}]+')"

ORACLE = {
    "p7_found": f"""WITH i AS (SELECT item_id, {_PLAIN.format('text')} AS w FROM eval_items), d AS (SELECT doc_id, {_PLAIN.format('text')} AS w FROM documents),
grams AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 10), lambda k: array_to_string(w[k:k + 11], ' '))) AS g FROM i WHERE len(w) >= 12),
found AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 10), lambda k: array_to_string(w[k:k + 11], ' '))) AS g FROM d WHERE len(w) >= 12)
SELECT DISTINCT doc_id, item_id FROM found JOIN grams USING (g)""",
    "p7_runs": f"""WITH i AS (SELECT item_id, {_PLAIN.format('text')} AS w FROM eval_items), d AS (SELECT doc_id, {_PLAIN.format('text')} AS w FROM documents),
grams AS (SELECT DISTINCT item_id, unnest(range(1, len(w) - 10)) AS b, array_to_string(w[b:b + 11], ' ') AS g FROM i WHERE len(w) >= 12),
found AS (SELECT doc_id, unnest(range(1, len(w) - 10)) AS a, array_to_string(w[a:a + 11], ' ') AS g FROM d WHERE len(w) >= 12),
met AS (SELECT DISTINCT doc_id, item_id, a, a - b AS shift FROM found JOIN grams USING (g)),
runs AS (SELECT doc_id, item_id, shift, a - row_number() OVER (PARTITION BY doc_id, item_id, shift ORDER BY a) AS island FROM met),
long AS (SELECT doc_id, item_id, count(*) + 11 AS n FROM runs GROUP BY doc_id, item_id, shift, island)
SELECT doc_id, item_id, max(n)::INTEGER AS exact_run FROM long GROUP BY 1, 2""",
    "p9_checks": "SELECT lang, TRUE AS shares_add_up, TRUE AS confidences_fit, TRUE AS labels_agree FROM (VALUES ('en'), ('de'), ('fr'), ('es'), ('pt'), ('nl')) AS v(lang)",
    "p4_found": _CANDIDATES + f"SELECT query_id, node_id FROM c x WHERE NOT EXISTS (SELECT 1 FROM c y WHERE y.query_id IS NOT DISTINCT FROM x.query_id AND y.node_id IS DISTINCT FROM x.node_id AND {_wins('x', 'y')} < 3)",
    "p4_ranking": _RANKS + "SELECT query_id, node_id, round(rho, 9) AS rho, round(mean_rank, 9) AS mean_rank, row_number() OVER (PARTITION BY query_id ORDER BY rho, mean_rank, node_id NULLS FIRST) AS place FROM q",
    "p3_found": _VECTORS + "SELECT DISTINCT least(id, other) AS id_a, greatest(id, other) AS id_b FROM ranked WHERE place <= 10",
    "p3_nearest": _VECTORS + "SELECT id, other, round(cosine, 5) AS cosine, place::INTEGER AS place FROM ranked WHERE place <= 10",
    "p3_neighbours": """
WITH v AS (SELECT id, any_value(embedding)::DOUBLE[] AS e FROM nodes WHERE embedding IS NOT NULL AND id IS NOT NULL GROUP BY id),
u AS (SELECT id, e, sqrt(list_dot_product(e, e)) AS norm FROM v WHERE len(e) > 0 AND list_dot_product(e, e) > 0),
s AS (SELECT a.id, b.id AS other, CASE WHEN len(a.e) = len(b.e) THEN list_dot_product(a.e, b.e) / (a.norm * b.norm) END AS c
      FROM u a JOIN u b ON len(a.e) = len(b.e) AND a.id <> b.id),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(c, 12) DESC, other) AS place FROM s)
SELECT id, other, round(c, 6) AS cosine, place::INTEGER AS place FROM r WHERE place <= 10""",
    # Sizes in characters stand for tokens: no source is near enough to its limit for the unit to matter.
    "p8_found": """
WITH s AS (SELECT lower(trim(coalesce(source, ''))) AS source, sum(length(text)) AS size FROM documents GROUP BY 1),
t AS (SELECT lower(trim(source)) AS source, target_weight / (SELECT sum(target_weight) FROM mixture_targets) AS share, max_repeats FROM mixture_targets)
SELECT t.source FROM t LEFT JOIN s ON t.source = s.source WHERE coalesce(s.size, 0) * t.max_repeats < t.share * (SELECT sum(size) FROM s)""",
    "p8_checks": "SELECT DISTINCT lower(trim(source)) AS source, TRUE AS repeats_kept, TRUE AS own_documents, TRUE AS tokens_add_up, TRUE AS share_met FROM mixture_targets",
    "p3_top10": """
WITH v AS (SELECT id, any_value(embedding)::DOUBLE[] AS e FROM nodes WHERE embedding IS NOT NULL AND id IS NOT NULL GROUP BY id),
u AS (SELECT id, e, sqrt(list_dot_product(e, e)) AS norm FROM v WHERE len(e) > 0 AND list_dot_product(e, e) > 0),
s AS (SELECT a.id, b.id AS other, CASE WHEN len(a.e) = len(b.e) THEN round(list_dot_product(a.e, b.e) / (a.norm * b.norm), 9) END AS c
      FROM u a JOIN u b ON len(a.e) = len(b.e) AND a.id <> b.id WHERE ('0x' || substr(md5(a.id), 1, 6))::INTEGER % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY c DESC, other) AS place FROM s)
SELECT id, other, round(c, 6) AS cosine, place::INTEGER AS place FROM r WHERE place <= 10""",
    "p6_found": _WORDS + "SELECT id_a, id_b FROM common WHERE c * 10 >= 7 * (na + nb - c)",
    "p6_groups": """
WITH RECURSIVE t AS (SELECT id, list_sort(list_distinct(regexp_extract_all(lower(any_value(coalesce(label, '') || ' ' || coalesce(summary, ''))), '[\\p{L}\\p{N}]+'))) AS w FROM nodes WHERE id IS NOT NULL GROUP BY id),
c AS (SELECT w, min(id) AS class_id, len(w) AS n FROM t WHERE len(w) > 0 GROUP BY w),
words AS (SELECT class_id, n, unnest(w) AS word FROM c),
common AS (SELECT a.class_id AS a, b.class_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS k FROM words a JOIN words b ON a.word = b.word AND a.class_id <> b.class_id AND a.n * 10 >= b.n * 8 AND b.n * 10 >= a.n * 8 GROUP BY 1, 2),
links AS (SELECT a, b FROM common WHERE k * 10 >= 8 * (na + nb - k)),
reach AS (SELECT class_id AS a, class_id AS b FROM c UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
groups AS (SELECT a, min(b) AS group_id FROM reach GROUP BY a),
degree AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
SELECT t.id, c.class_id, g.group_id, coalesce(d.n_links, 0) AS n_links FROM t JOIN c USING (w) JOIN groups g ON g.a = c.class_id LEFT JOIN degree d ON d.a = c.class_id""",
}

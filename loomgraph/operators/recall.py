"""Hybrid recall for batches of requests: dense similarity, BM25, frequency, recency, importance and anchors, then gated
one-hop expansion, top k and the connecting edges.

The requests are a stated, small query set held by the driver; the nodes are scanned once for all of them. Each task
keeps nothing but its best candidates of each request (a rank limit before the shuffle), so what moves is
requests x pool rows per task, not requests x nodes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from datetime import datetime

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.config import RecallConfig, RecallRequest, ResolvedRequest
from loomgraph.functions.secure import MASK, PREFIX, decrypt
from loomgraph.functions.text import tokens
from loomgraph.operators.graph import active_headers, anchors_by_node, current_nodes
from loomgraph.session import cut

K1, B = 1.2, 0.75
TECHNICAL = "_-.:0123456789"
#: What scoring reads of an index.
INDEX_COLUMNS = ["id", "embedding", "label_codes", "summary_codes", "anchors", "access_count", "last_accessed_at", "importance_score", "stability_score", "doc_len", "low_label", "low_summary"]


def build_index(nodes: DataFrame, anchors: DataFrame, unique: bool = False) -> DataFrame:
    """Active nodes with lower-cased texts, token sets and their hashes, document length and anchors.

    ``unique``: there is one row for each id already (as in the store), so that no row need be moved to find it."""
    heads = active_headers(nodes, anchors, unique)
    a, b = F.lower(F.coalesce("label", F.lit(""))), F.lower(F.coalesce("summary", F.lit("")))
    out = heads.withColumn("low_label", a).withColumn("low_summary", b).withColumn("label_tokens", tokens(a)).withColumn("summary_tokens", tokens(b))
    out = out.withColumn("doc_len", F.greatest(F.lit(1.0), 2.0 * F.size("label_tokens") + F.size("summary_tokens")))
    return out.withColumn("label_codes", codes(F.col("label_tokens"))).withColumn("summary_codes", codes(F.col("summary_tokens")))


def postings(index: DataFrame) -> DataFrame:
    """(term, id, tf): 2 for a term of the label, 1 for one of the summary, 3 for both."""
    both = F.array_union("label_tokens", "summary_tokens")
    p = index.select("id", "label_tokens", "summary_tokens", F.explode(both).alias("term"))
    tf = F.when(F.array_contains("label_tokens", F.col("term")), 2.0).otherwise(0.0) + F.when(F.array_contains("summary_tokens", F.col("term")), 1.0).otherwise(0.0)
    return p.select("term", "id", tf.alias("tf"))


def document_frequency(index: DataFrame) -> DataFrame:
    return postings(index).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def length_stats(index: DataFrame) -> DataFrame:
    return index.agg(F.count(F.lit(1)).alias("n_docs"), F.sum("doc_len").alias("sum_len"), F.avg("doc_len").alias("avg_len"))


def codes(words: Column) -> Column:
    """Hashes of an array of words: what the scoring looks up instead of the words themselves."""
    return F.transform(words, lambda x: F.xxhash64(x))


def term_hashes(spark: SparkSession, terms: list[str]) -> np.ndarray:
    """The hashes of the terms, in their order."""
    row = spark.range(1).select(*[F.xxhash64(F.lit(t)) for t in terms]).first() if terms else ()
    return np.array(list(row), np.int64)


def code_counts(column: pa.Array, hashes: np.ndarray, order: np.ndarray) -> np.ndarray:
    """(nodes, terms) boolean: which of the terms (``hashes[order]`` ascends) are among each node's codes."""
    flat, sizes = column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), len(hashes)), bool)
    ranked = hashes[order]
    at = np.minimum(np.searchsorted(ranked, flat), len(ranked) - 1)
    hit = np.flatnonzero(ranked[at] == flat)
    out[np.repeat(np.arange(len(column)), sizes)[hit], order[at[hit]]] = True
    return out


def term_weights(index: DataFrame, terms: list[str], hashes: np.ndarray) -> tuple[dict[str, float], float]:
    """(idf times the boost of technical terms for each term that occurs, average length): one pass, one row a task."""
    order = np.argsort(hashes)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, length, df = 0, 0.0, np.zeros(len(terms), np.int64)
        for b in batches:
            n, length = n + b.num_rows, length + float(b.column(0).to_numpy().sum())
            df += (code_counts(b.column(1), hashes, order) | code_counts(b.column(2), hashes, order)).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([length]), pa.array([df.tolist()], pa.list_(pa.int64()))], names=["n", "length", "df"])

    parts = index.select(F.col("doc_len").cast("double"), "label_codes", "summary_codes").mapInArrow(count, "n long, length double, df array<long>").agg(F.sum("n"), F.sum("length"), F.array(*[F.sum(F.col("df")[i]) for i in range(len(terms))])).first()
    n, avg = parts[0] or 0, (parts[1] / parts[0] if parts[0] else 1.0)
    found = {t: c for t, c in zip(terms, parts[2] if n else []) if c}
    return {t: max(0.1, float(np.log((n - c + 0.5) / (c + 0.5) + 1.0))) * (2.5 if any(x in TECHNICAL for x in t) else 1.0) for t, c in found.items()}, avg


def phrase_places(label: pa.Array, summary: pa.Array, tf: np.ndarray, terms: list[str], requests: list[ResolvedRequest]) -> np.ndarray:
    """(nodes, requests): 2 where the label holds the request's tokens as a phrase, 1 where only the summary does.

    A request of one token has no phrase. Inner words of a phrase are words of the text, so texts with fewer of the
    request's terms than that (one at least: without any there is no bonus) aren't searched.
    """
    out = np.zeros((len(label), len(requests)), np.int8)
    has = tf > 0
    for q, r in enumerate(requests):
        if len(r.tokens) < 2:
            continue
        mine = [i for i, t in enumerate(terms) if t in set(r.tokens)]
        rows = np.flatnonzero(has[:, mine].sum(axis=1) >= max(1, len(r.tokens) - 2))
        if len(rows):
            pick, phrase = pa.array(rows), " ".join(r.tokens)
            in_label, in_summary = (pc.match_substring(c.take(pick), phrase).to_numpy(zero_copy_only=False) for c in (label, summary))
            out[rows, q] = np.where(in_label, 2, np.where(in_summary, 1, 0))
    return out


def lexical_shares(tf: np.ndarray, doc_len: np.ndarray, phrases: np.ndarray, terms: list[str], requests: list[ResolvedRequest], weights: dict[str, float], avg_len: float) -> np.ndarray:
    """(nodes, requests): share of the best possible BM25 score that a node reaches, in [0, 1].

    ``phrases`` is 2 where the label holds the request's phrase, 1 where only the summary does.
    """
    k = K1 * (1.0 - B + B * doc_len / avg_len)
    each = np.array([weights.get(t, 0.0) for t in terms]) * tf * (K1 + 1.0) / (tf + k[:, None])
    uses = np.array([[t in r.tokens and t in weights for r in requests] for t in terms], np.float64)
    raw = each @ uses
    best = np.array([sum(weights.get(t, 0.0) * (K1 + 1.0) for t in r.tokens) for r in requests])
    bonus = np.choose(phrases.astype(np.int64), [0.0, 0.15, 0.35]) * best
    raw = np.where(raw > 0, raw + bonus, 0.0)
    return np.clip(raw / np.where(best > 0, best, 1.0), 0.0, 1.0)


def dense_top(vectors: DataFrame, queries: DataFrame, k: int, digits: int = 6, block: int = 4096) -> DataFrame:
    """(query_id, id, cosine, place): the k rows of ``vectors`` (id, embedding) most similar to each of ``queries`` (id,
    embedding), by the cosine clamped to [0, 1] and rounded, ties to the lower id; ids are numbers.

    The queries are a stated set and go through the driver in blocks of bounded size; each block meets all rows as one
    matrix product a batch, and a batch hands on no more than its k best of each query (and their ties).
    """
    found: DataFrame | None = None
    held: list[tuple[int, list[float]]] = []

    def scan(rows: list[tuple[int, list[float]]]) -> DataFrame:
        by_dim = query_vectors([RecallRequest(mode="dense").resolved().with_vector(tuple(v)) for _, v in rows])
        ids = np.array([i for i, _ in rows], np.int64)
        shared = vectors.sparkSession.sparkContext.broadcast((ids, by_dim))  # at most ``block`` vectors

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                names, dims = shared.value
                cosine = dot_scores(b.column(1), dims, len(names))
                least = np.partition(cosine, -k, axis=0)[-k] - 10.0**-digits if b.num_rows > k else np.full(len(names), -1.0)
                row, q = np.nonzero(cosine >= least)
                yield pa.RecordBatch.from_arrays([pa.array(names[q]), b.column(0).take(pa.array(row)), pa.array(cosine[row, q])], names=["query_id", "id", "cosine"])

        return vectors.select(F.col("id").cast("long"), "embedding").mapInArrow(run, "query_id long, id long, cosine double")

    for r in queries.select("id", "embedding").toLocalIterator():
        held.append((r["id"], r["embedding"]))
        if len(held) == block:
            found, held = (scan(held) if found is None else found.unionByName(scan(held))), []
    if held or found is None:
        found = scan(held) if found is None else found.unionByName(scan(held))
    w = Window.partitionBy("query_id").orderBy(F.desc("cosine"), "id")
    return found.withColumn("cosine", F.round("cosine", digits)).withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


SCORE_SCHEMA = "query_no int, id string, sim_score double, dense_score double, bm25_score double, frequency_score double, recency_score double, importance_score double, anchor_score double, base_score double, total_score double, w_anchor double"


def dot_scores(column: pa.Array, by_dim: dict[int, tuple[list[int], np.ndarray]], n_requests: int) -> np.ndarray:
    """(nodes, requests) cosines clamped to [0, 1]; 0 where there is no vector or lengths differ."""
    out = np.zeros((len(column), n_requests))
    start = column.offsets.to_numpy()
    sizes, flat = np.diff(start), column.values.to_numpy(zero_copy_only=False)
    there = column.is_valid().to_numpy(zero_copy_only=False)
    for dim, (rows, m) in by_dim.items():
        pick = np.flatnonzero((sizes == dim) & there)
        if len(pick):
            x = flat[start[pick][:, None] + np.arange(dim)].astype(np.float64)
            n = np.linalg.norm(x, axis=1, keepdims=True)
            out[np.ix_(pick, rows)] = np.clip(np.nan_to_num((x / np.where(n > 0, n, 1.0)) @ m.T), 0.0, 1.0)
    return out


def query_vectors(requests: list[ResolvedRequest]) -> dict[int, tuple[list[int], np.ndarray]]:
    """Requests and their unit vectors by vector length."""
    out: dict[int, tuple[list[int], np.ndarray]] = {}
    for i, r in enumerate(requests):
        if r.embedding:
            v = np.array(r.embedding, np.float64)
            n = np.linalg.norm(v)
            rows, m = out.get(len(v), ([], np.zeros((0, len(v)))))
            out[len(v)] = ([*rows, i], np.vstack([m, v / n if n else v]))
    return out


def scored(index: DataFrame, requests: list[ResolvedRequest], now: datetime, cfg: RecallConfig = RecallConfig(), weights: tuple[dict[str, float], float] | None = None, keep: int | None = None) -> DataFrame:
    """All scores of the candidates of every request (see SCORE_SCHEMA).

    Words are looked up by their hashes; lexical shares, vectors and the mixing of scores are matrices per batch.
    With ``keep`` each batch hands on only what can be among the ``keep`` best of a request. ``weights`` are those of
    the whole index, where ``index`` is a part of it.
    """
    terms = sorted({t for r in requests for t in r.tokens})
    hashes = term_hashes(index.sparkSession, terms)
    order = np.argsort(hashes)
    known, avg_len = weights or (term_weights(index, terms, hashes) if terms else ({}, 1.0))
    ts = F.lit(now).cast("timestamp")
    idle = (F.unix_micros(ts) - F.unix_micros("last_accessed_at")) / 1e6
    freq = F.when(F.col("access_count") > 0, F.least(F.lit(1.0), F.log1p(F.col("access_count").cast("double")) / float(np.log(1.0 + cfg.max_frequency)))).otherwise(0.0)
    rec = F.when(idle > 0, F.exp(-idle / cfg.tau.total_seconds())).otherwise(1.0)
    imp = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("importance_score")))
    stable = F.when((F.col("stability_score") > 0) & (F.col("stability_score") != 1.0), 0.8 + 0.2 * F.col("stability_score")).otherwise(1.0)
    # One flag for each different list of tags.
    lists = sorted({tuple(r.anchors) for r in requests if r.anchors})
    tagged_by = F.array(*([F.arrays_overlap("anchors", F.array(*map(F.lit, tags))) for tags in lists] or [F.lit(False)]))
    tag_of = np.array([lists.index(tuple(r.anchors)) if r.anchors else -1 for r in requests])
    slim = index.select("id", "embedding", "label_codes", "summary_codes", tagged_by.alias("tagged"), freq.alias("freq"), rec.alias("rec"), imp.alias("imp"), stable.alias("stable"), F.col("doc_len").cast("double"), "low_label", "low_summary")
    by_dim, n = query_vectors(requests), len(requests)
    alpha, w_sim, w_freq, w_rec, w_imp, w_anchor = (np.array([getattr(r, c) for r in requests], np.float64) for c in ("alpha", "w_sim", "w_freq", "w_rec", "w_imp", "w_anchor"))
    entity, strict = [r.entity_id for r in requests], np.array([r.filter_anchors for r in requests])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0)
            dense = dot_scores(b.column(1), by_dim, n)
            marks = b.column(4).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            tagged = np.where(tag_of >= 0, marks[:, tag_of], False).astype(np.float64)
            lexical = np.zeros((b.num_rows, n))
            if terms:
                tf = 2.0 * code_counts(b.column(2), hashes, order) + code_counts(b.column(3), hashes, order)
                lexical = lexical_shares(tf, b.column(9).to_numpy(), phrase_places(b.column(10), b.column(11), tf, terms, requests), terms, requests, known, avg_len)
            for q, e in enumerate(entity):
                if e:
                    at = np.flatnonzero(np.array(ids.to_pylist(), object) == e)
                    dense[at, q] = lexical[at, q] = 1.0
            f, r, m, st = (b.column(i).to_numpy(zero_copy_only=False)[:, None] for i in (5, 6, 7, 8))
            sim = alpha * dense + (1.0 - alpha) * lexical
            base = (w_sim * sim + w_rec * r + w_imp * m + w_freq * f) * st
            total = base + w_anchor * tagged
            wanted = ~strict | (tagged > 0)
            if keep is not None and len(ids) > keep:
                ranked = np.where(wanted, total, -np.inf)
                wanted &= ranked >= np.partition(ranked, -keep, axis=0)[-keep] - 1e-8  # ties stay
            row, q = np.nonzero(wanted)
            columns = [pa.array(q, pa.int32()), ids.take(pa.array(row))]
            columns += [pa.array(x[row, q]) for x in (sim, dense, lexical)] + [pa.array(x[row, 0]) for x in (f, r, m)] + [pa.array(x[row, q]) for x in (tagged, base, total)] + [pa.array(w_anchor[q])]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in SCORE_SCHEMA.split(", ")])

    return slim.mapInArrow(run, SCORE_SCHEMA)


def best(scores: DataFrame, k: int, by: str = "total_score") -> DataFrame:
    """The k best of each request with ``place``; scores that agree to nine decimals tie, and ties go to the lower id."""
    w = Window.partitionBy("query_no").orderBy(F.desc(F.round(by, 9)), "id")
    return scores.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def _each(requests: list[ResolvedRequest], value: Callable[[ResolvedRequest], object], kind: str) -> Column:
    """What ``value`` gives for the request of the row's ``query_no``."""
    return F.array(*[F.lit(value(r)).cast(kind) for r in requests])[F.col("query_no")]


def gate(edges: DataFrame, requests: list[ResolvedRequest]) -> DataFrame:
    """The edges that any of the requests may follow: no self-loops, heavy enough, of an allowed relation."""
    asking = [r for r in requests if r.expand]
    least = min((r.min_edge_weight for r in asking), default=None)
    if least is None:
        return edges.where(F.lit(False))
    gated = edges.where((F.col("source_id") != F.col("target_id")) & (F.col("weight") >= least))
    return gated.where(F.col("relation_type").isin(sorted({x for r in asking for x in r.relations}))) if all(r.relations for r in asking) else gated


def passes(requests: list[ResolvedRequest]) -> Column:
    """Whether the gate of the row's own request lets its edge through."""
    relations = F.array(*[F.array(*map(F.lit, r.relations)) if r.relations else F.lit(None).cast("array<string>") for r in requests])[F.col("query_no")]
    return (F.col("weight") >= _each(requests, lambda r: r.min_edge_weight, "double")) & (relations.isNull() | F.array_contains(relations, F.col("relation_type")))


def expand(index: DataFrame, edges: DataFrame, requests: list[ResolvedRequest], now: datetime, k: int, cfg: RecallConfig = RecallConfig(), stored: bool = False) -> tuple[DataFrame, DataFrame]:
    """(candidates with neighbours' boosts and hop_distance, edges used by ``query_no``): all that can be among the k best.

    The nodes are scored once for the best of each request; beside these only the neighbours of the seeds can rise,
    and only they are scored again. Seeds and the top score are those before any boost, so the order of edges can't
    matter: a neighbour gets the best of what its edges give. Each request has its own gate and boost; one that
    doesn't expand has no seeds. ``stored``: the index is a table already, not a plan to be computed.
    """
    index = index if stored else cut(index.select(INDEX_COLUMNS), "index")
    terms = sorted({t for r in requests for t in r.tokens})
    weights = term_weights(index, terms, term_hashes(index.sparkSession, terms)) if terms else ({}, 1.0)
    many = max(cfg.pool, k)
    top = cut(best(scored(index, requests, now, cfg, weights, many), many), "top")
    seeds = top.where((F.col("place") <= cfg.pool) & _each(requests, lambda r: r.expand, "boolean"))
    seeds = seeds.select("query_no", F.col("id").alias("seed"), F.col("total_score").alias("seed_score"), F.max("total_score").over(Window.partitionBy("query_no")).alias("top"))
    # Each edge in both directions: an equi-join on the seed instead of a disjunction of two.
    ends = F.array(F.struct(F.col("source_id").alias("seed"), F.col("target_id").alias("id")), F.struct(F.col("target_id").alias("seed"), F.col("source_id").alias("id")))
    oriented = gate(edges, requests).select(F.explode(ends).alias("o"), "source_id", "target_id", "relation_type", "weight").select("o.*", "source_id", "target_id", "relation_type", "weight")
    met = cut(oriented.join(F.broadcast(seeds), "seed").where(passes(requests)), "met")  # at most requests x pool rows are broadcast
    lifts = met.groupBy("query_no", "id", "seed").agg(F.max("seed_score").alias("seed_score"), F.max("top").alias("top"), F.max(F.least(F.lit(1.0), F.col("weight"))).alias("pull"))
    near = scored(index.join(met.select("id").distinct(), "id", "left_semi"), requests, now, cfg, weights)
    found = lifts.join(near, ["query_no", "id"]).where(F.col("seed_score") > F.col("base_score"))
    new = F.col("base_score") + _each(requests, lambda r: r.boost, "double") * F.col("pull") * F.col("seed_score") + F.col("w_anchor") * F.col("anchor_score")
    limit = F.least("seed_score", "top")
    new = F.when(F.col("sim_score") < 0.5, F.least(new, 0.85 * limit)).when(((F.col("base_score") < F.col("seed_score")) | (F.col("base_score") < F.col("top"))) & ((new >= F.col("seed_score")) | (new >= F.col("top"))), 0.95 * F.when(F.col("top") > 0, limit).otherwise(F.col("seed_score"))).otherwise(new)
    scores = [c.split()[0] for c in SCORE_SCHEMA.split(", ")]
    lifted = found.withColumn("lifted", new).where(F.col("lifted") > F.col("total_score")).groupBy("query_no", "id").agg(F.max("lifted").alias("total_score"), *[F.first(c).alias(c) for c in scores if c not in ("query_no", "id", "total_score")])
    lifted = cut(lifted.select(*scores, F.lit(1).alias("hop_distance")), "lifted")
    rest = top.select(*scores, F.lit(0).alias("hop_distance")).join(lifted.select("query_no", "id"), ["query_no", "id"], "left_anti")
    used = met.select("query_no", "source_id", "target_id", "relation_type", "weight").distinct()
    return rest.select(*scores, "hop_distance").unionByName(lifted), used


#: Names that a request may ask for; ``score`` is the total.
FIELDS = ["id", "entity_type", "label", "summary", "embedding", "anchors", "created_at", "last_accessed_at", "last_reinforced_at", "archived_at", "access_count", "stability_score", "is_archived", "is_secret", "score", "sim_score", "dense_score", "bm25_score", "frequency_score", "recency_score", "importance_score", "anchor_score", "hop_distance"]
_ROUNDED = ("sim_score", "dense_score", "bm25_score", "frequency_score", "recency_score", "importance_score", "anchor_score", "base_score", "total_score")
_ALWAYS = ("query_no", "id", "place")


def present(top: DataFrame, nodes: DataFrame, anchors: DataFrame, requests: list[ResolvedRequest], key: str | None = None) -> DataFrame:
    """Full rows of the few nodes returned, each as its own request may see it: scores to four decimals, secrets
    masked unless asked for (then read under ``key``, if there is one), no vectors unless asked for, fields as asked.

    The columns are those that any request asks for; what a row's request did not ask for is null in it.
    """
    ids = F.broadcast(top.select("id").distinct())  # at most requests x top_k rows
    own = ["id", "entity_type", "label", "summary", "embedding", "is_secret", "access_count", "stability_score", "created_at", "last_accessed_at", "last_reinforced_at", "archived_at", "is_archived", F.col("importance_score").alias("own_importance")]
    full = nodes.join(ids, "id", "left_semi").select(*own)
    tags = anchors_by_node(anchors.withColumnRenamed("node_id", "id").join(ids, "id", "left_semi").withColumnRenamed("id", "node_id")).withColumnRenamed("node_id", "id")
    out = top.join(full, "id").drop("anchors").join(tags, "id", "left")
    hidden = F.coalesce("is_secret", F.lit(False)) | F.coalesce(F.col("summary").startswith(PREFIX), F.lit(False))
    shown = _each(requests, lambda r: r.include_secrets, "boolean")
    opened = F.coalesce(decrypt(F.col("summary"), key), F.col("summary")) if key else F.col("summary")
    out = out.withColumn("summary", F.when(~hidden, F.col("summary")).when(shown, opened).otherwise(F.lit(MASK))).withColumn("is_secret", hidden)
    for c in _ROUNDED:
        out = out.withColumn(c, F.round(c, 4))
    out = out.withColumn("importance_score", F.when(F.col("importance_score") > 0, F.col("importance_score")).otherwise(F.col("own_importance"))).drop("own_importance").withColumn("score", F.col("total_score"))
    usual = [c for c in out.columns if c not in ("embedding", "score")]
    wanted = [{f.strip().lower() for f in r.fields} & set(FIELDS) if r.fields else {*usual, *(["embedding"] if r.include_embeddings else [])} for r in requests]
    columns = [c for c in out.columns if c in _ALWAYS or any(c in w for w in wanted)]
    return out.select(*[F.col(c) if c in _ALWAYS or all(c in w for w in wanted) else F.when(F.array(*[F.lit(c in w) for w in wanted])[F.col("query_no")], F.col(c)).alias(c) for c in columns])


def subgraph_edges(used: DataFrame, top: DataFrame) -> DataFrame:
    """Each request's edges with either endpoint among its returned ids, each once; ``top`` has query_no and id."""
    keys = F.broadcast(top.select("query_no", "id").distinct())  # at most requests x top_k rows
    sides = [used.join(keys.withColumnRenamed("id", side), ["query_no", side], "left_semi").select(used.columns) for side in ("source_id", "target_id")]
    return sides[0].unionByName(sides[1]).dropDuplicates(["query_no", "source_id", "target_id", "relation_type"])


def recall_graph(nodes: DataFrame, edges: DataFrame, anchors: DataFrame, requests: list[RecallRequest], now: datetime, cfg: RecallConfig = RecallConfig(), key: str | None = None, index: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(ranked nodes, edges): the nodes of each request with scores, hop_distance and the fields asked for, and the
    edges (query_no, source_id, target_id, relation_type, weight) that its expansion used and that touch them.

    The requests are answered together in one plan, each by its own weights, gate, limit, fields and permissions.
    ``index``: a stored :func:`build_index` of these nodes; else it is built here.
    """
    resolved = [r.resolved(cfg) for r in requests]
    built = build_index(nodes, anchors) if index is None else index
    most = max(r.top_k for r in resolved)
    if any(r.expand for r in resolved):
        scores, used = expand(built, edges, resolved, now, most, cfg, stored=index is not None)
    else:
        scores = scored(built, resolved, now, cfg, keep=most).withColumn("hop_distance", F.lit(0))
        used = edges.select(F.lit(0).alias("query_no"), "source_id", "target_id", "relation_type", "weight").where(F.lit(False))
    top = cut(best(scores, most).where(F.col("place") <= _each(resolved, lambda r: r.top_k, "int")), "top")
    current = nodes if index is not None else current_nodes(nodes.join(F.broadcast(top.select("id").distinct()), "id", "left_semi"))
    return present(top.drop("w_anchor"), current, anchors, resolved, key), subgraph_edges(used, top)


def recall(nodes: DataFrame, edges: DataFrame, anchors: DataFrame, requests: list[RecallRequest], now: datetime, cfg: RecallConfig = RecallConfig(), key: str | None = None, index: DataFrame | None = None) -> DataFrame:
    """The ranked nodes of :func:`recall_graph`."""
    return recall_graph(nodes, edges, anchors, requests, now, cfg, key, index)[0]


def as_json(top: DataFrame) -> DataFrame:
    """(query_no, place, body): each row as a JSON object without nulls, empty texts and zero scores."""
    slim = []
    for name, kind in top.dtypes:
        if name in ("query_no", "place"):
            continue
        c = F.col(name)
        slim.append((F.nullif(c, F.lit(0).cast(kind)) if kind in ("double", "int", "bigint", "float") else F.nullif(c, F.lit("")) if kind == "string" else c).alias(name))
    return top.select("query_no", "place", F.to_json(F.struct(*slim)).alias("body"))

"""Queries of the service: embeddings, cycles over a store, requests, imports and the object for all of it."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.config import RecallRequest, ScopedDecay, parse_duration
from loomgraph.engine import Engine
from loomgraph.functions.embed import HashEmbedder, HttpEmbedder, with_embeddings
from loomgraph.operators import decay as D
from loomgraph.operators import graph as G
from loomgraph.operators import recall as R
from loomgraph.operators.extract import session_scope, session_traces as traces_of
from loomgraph.plans import service_sql
from loomgraph.plans.graph import NOW, _cur, _joined, now, with_vectors
from loomgraph.session import checkpoint_dir, cut, table
from loomgraph.sources.store import TableStore, import_rows, pack_vectors, unpack_vectors
from loomgraph.streaming.consolidate import Cycle, stream


def _store(spark: SparkSession) -> TableStore:
    return TableStore(spark, f"{checkpoint_dir(spark).rstrip('/')}/store-{uuid.uuid4().hex}")


def _graph_in(spark: SparkSession, d: str) -> TableStore:
    """A store of the current nodes, the merged edges, the anchors and the queued traces."""
    store = _store(spark)
    edges = table(spark, d, "edges").select("source_id", "target_id", "relation_type", "weight", "created_at", "last_reinforced_at")
    traces = _traces(spark, d)
    store.commit({"nodes": _cur(spark, d), "edges": G.upsert_edges(edges.limit(0), edges), "node_anchors": table(spark, d, "node_anchors"), "episodic_traces": G.queue_traces(traces.limit(0), traces)})
    return store


def _traces(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "episodic_traces").select("id", "session_id", "task_goal", "outcome", "trace_payload", "consolidated", "created_at", "consolidated_at")


def _elements(df: DataFrame) -> DataFrame:
    return df.select("id", F.posexplode("embedding").alias("i", "value")).select("id", "i", (F.round(F.col("value").cast("double"), 4) + 0.0).alias("value"))


def embed_generate(spark: SparkSession, d: str) -> DataFrame:
    """Vectors for the current nodes that have none, from label and summary, element by element."""
    nodes = _cur(spark, d).where(F.col("embedding").isNull()).select("id", F.concat_ws(" ", "label", "summary").alias("text"))
    return _elements(with_embeddings(nodes, "text", "embedding", lambda: HashEmbedder(service_sql.DIM)))


class _Remote:
    """Answers as a service would, in another order than asked."""

    def __call__(self, url: str, body: bytes, headers: dict[str, str], timeout: float) -> tuple[int, bytes]:
        texts = json.loads(body)["input"]
        vectors = HashEmbedder(service_sql.DIM).embed_batch(texts)
        return 200, json.dumps({"data": [{"index": i, "embedding": [float(x) for x in vectors[i]]} for i in reversed(range(len(texts)))]}).encode()


def embed_queries(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of all labels through the client of an embedding service."""
    labels = table(spark, d, "nodes").select(F.col("label").alias("id")).where(F.col("id").isNotNull()).distinct().withColumn("text", F.col("id"))
    return _elements(with_embeddings(labels, "text", "embedding", lambda: HttpEmbedder("http://localhost/v1/embeddings", post=_Remote())))


def active_scan(spark: SparkSession, d: str) -> DataFrame:
    live = G.active_nodes(table(spark, d, "nodes"), table(spark, d, "node_anchors"))
    return live.select("id", "entity_type", "label", F.md5(F.coalesce("summary", F.lit(""))).alias("summary_md5"), F.when(F.col("embedding").isNotNull(), F.size("embedding")).alias("n_elements"), "created_at", "access_count", _joined("anchors").alias("anchors"))


def point_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The node of the lowest id, that of the lowest archived id, and one that does not exist."""
    nodes, anchors = table(spark, d, "nodes"), table(spark, d, "node_anchors")
    first = nodes.agg(F.min("id"), F.min(F.when(F.col("is_archived"), F.col("id")))).first()
    found = None
    for node_id in dict.fromkeys([first[0], first[1], "no such node"]):
        one = G.get_node(nodes, anchors, node_id)
        found = one if found is None else found.unionByName(one)
    return found.select("id", "label", "is_archived", _joined("anchors").alias("anchors"))


def _session(spark: SparkSession, d: str) -> str:
    return table(spark, d, "episodic_traces").where(F.col("session_id").isNotNull()).groupBy("session_id").count().orderBy(F.desc("count"), "session_id").first()["session_id"]


def session_traces(spark: SparkSession, d: str) -> DataFrame:
    """The documents of the largest session."""
    found = traces_of(table(spark, d, "episodic_traces"), _session(spark, d))
    return found.select("id", F.md5(F.coalesce("trace_payload", F.lit(""))).alias("payload_md5")).distinct()


def decay_scope_session_traces(spark: SparkSession, d: str) -> DataFrame:
    """Decay of what the largest session's traces gave, by their ids or by mention."""
    session = _session(spark, d)
    own = session_scope(table(spark, d, "episodic_traces"), session)
    marked = D.scoped(_cur(spark, d), table(spark, d, "node_anchors"), now(), ScopedDecay("session", session_id=session), own)
    return marked.select("id", "action", F.round("new_stability", 9).alias("new_stability"))


def decay_tally(spark: SparkSession, d: str) -> DataFrame:
    return D.tally(D.scoped(_cur(spark, d), table(spark, d, "node_anchors"), now(), ScopedDecay("all")))


def import_text(spark: SparkSession, d: str) -> DataFrame:
    """Nodes written as text, partly unreadable, and vectors as blobs, read again."""
    n = F.col("access_count")
    odd = table(spark, d, "nodes").select(
        "id", F.when(n % 7 == 0, "soon").otherwise(F.date_format("created_at", "yyyy-MM-dd HH:mm:ss.SSSSSS")).alias("created_at"), F.when(n % 5 == 0, "many").otherwise(n.cast("string")).alias("access_count"),
        F.when(n % 3 == 0, "").otherwise(F.col("stability_score").cast("string")).alias("stability_score"), F.when(F.col("is_archived"), "1").otherwise("false").alias("is_archived"),
        F.when(n % 11 == 0, F.lit(b"odd")).otherwise(pack_vectors(F.col("embedding"))).alias("embedding"),
    )
    rows = import_rows(odd, "nodes")
    return rows.select("id", "created_at", "access_count", F.round("stability_score", 9).alias("stability_score"), "is_archived", F.when(F.col("embedding").isNotNull(), F.size("embedding")).alias("n_elements"))


def vector_codec(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "nodes").where(F.size("embedding") > 0).select("id", pack_vectors(F.col("embedding")).alias("blob"))
    again = rows.withColumn("v", unpack_vectors(F.col("blob"))).withColumn("broken", unpack_vectors(F.concat(F.col("blob"), F.lit(b"x"))))
    total = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return again.select("id", F.size("v").alias("n_elements"), F.octet_length("blob").alias("n_bytes"), F.round(total, 6).alias("total"), F.col("broken").isNull().alias("odd_length_is_null"))


def request_parse(spark: SparkSession, d: str) -> DataFrame:
    """Requests in JSON, one for each node and tag, read as the service reads them: text, tokens and anchors."""
    nodes, anchors = table(spark, d, "nodes").select("id", "label"), table(spark, d, "node_anchors").select(F.col("node_id").alias("id"), F.col("anchor_tag").alias("tag")).where(F.col("tag").isNotNull())
    body = F.to_json(F.struct(F.concat(F.coalesce("label", F.lit("")), F.lit(" "), F.col("tag")).alias("query"), F.lit("id, label").alias("fields"), F.lit(3).alias("top_k")))
    rows = nodes.join(anchors, "id").distinct().select("id", "tag", body.alias("body"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            asked = [RecallRequest.from_dict(json.loads(x)).resolved() for x in b["body"]]
            if any(r.top_k != 3 or r.fields != ["id", "label"] for r in asked):
                raise ValueError("fields or limit lost")
            yield pd.DataFrame({"id": b["id"], "tag": b["tag"], "text": [r.text for r in asked], "tokens": [" ".join(r.tokens) for r in asked], "anchors": [" ".join(r.anchors) for r in asked]})

    return rows.mapInPandas(run, "id string, tag string, text string, tokens string, anchors string")


def duration_parse(spark: SparkSession, d: str) -> DataFrame:
    """Durations in text, as requests give them."""

    @F.pandas_udf("double")
    def seconds(s: pd.Series) -> pd.Series:
        return s.map(lambda x: parse_duration(x).total_seconds())

    n = table(spark, d, "nodes").select("access_count").distinct()
    text = F.concat(F.col("access_count"), F.lit("h"), F.col("access_count") % 50, F.lit("m250ms"))
    return n.select("access_count", (seconds(text) + F.col("access_count") / F.lit(1e9)).alias("seconds"))


def _field_rows(spark: SparkSession, d: str) -> DataFrame:
    asked = with_vectors(spark, d, service_sql.FIELD_REQUESTS)
    requests = [RecallRequest(**{**r.__dict__, "embedding": x.embedding}) for r, x in zip(service_sql.FIELD_REQUESTS, asked)]
    return R.recall(table(spark, d, "nodes"), table(spark, d, "edges"), table(spark, d, "node_anchors"), requests, NOW)


def recall_fields(spark: SparkSession, d: str) -> DataFrame:
    """A request for every field there is."""
    top = _field_rows(spark, d)
    return top.withColumn("n_elements", F.when(F.col("embedding").isNotNull(), F.size("embedding"))).withColumn("anchors", _joined("anchors")).withColumn("place", F.col("place").cast("long")).withColumn("stability_score", F.round("stability_score", 6)).withColumn("importance_score", F.round("importance_score", 4)).drop("embedding")


def recall_json(spark: SparkSession, d: str) -> DataFrame:
    """The answer as JSON: which keys each node's object has."""
    slim = _field_rows(spark, d).select("query_no", "place", "id", "label", "summary", *service_sql._SCORE_FIELDS)
    body = R.as_json(slim)
    return body.select("query_no", F.col("place").cast("long"), F.get_json_object("body", "$.id").alias("id"), F.array_join(F.array_sort(F.json_object_keys("body")), " ").alias("keys"))


def _streamed(spark: SparkSession, d: str) -> TableStore:
    root = f"{checkpoint_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    _traces(spark, d).withColumn("consolidated", F.lit(False)).withColumn("consolidated_at", F.lit(None).cast("timestamp")).write.parquet(f"{root}/in")
    store = TableStore(spark, f"{root}/store")
    stream(spark, f"{root}/in", Cycle(store), f"{root}/progress", NOW).awaitTermination()
    return store


def stream_consolidate(spark: SparkSession, d: str) -> DataFrame:
    """The trace table as a stream into an empty graph; the entities that it leaves."""
    return G.entity_histogram(_streamed(spark, d).read("nodes"))


def _state(store: TableStore) -> DataFrame:
    return store.read("nodes").select("id", "entity_type", F.round("stability_score", 6).alias("stability_score"), "is_archived", "access_count")


def stream_nodes(spark: SparkSession, d: str) -> DataFrame:
    return _state(_streamed(spark, d))


def cycle_nodes(spark: SparkSession, d: str) -> DataFrame:
    """The graph after one cycle: the oldest 500 pending traces fused, then decay."""
    store = _graph_in(spark, d)
    Cycle(store).run(NOW)
    return _state(store)


def cycle_totals(spark: SparkSession, d: str) -> DataFrame:
    store = _graph_in(spark, d)
    t = Cycle(store).run(NOW)
    done = store.read("episodic_traces").where("consolidated").count()
    return spark.createDataFrame([(t["traces"], t["nodes"], t["archived"], t["edges"], done)], "traces long, nodes long, archived long, edges long, consolidated long")


def ingest_notified(spark: SparkSession, d: str) -> DataFrame:
    """The ids that a listener hears of when all traces are ingested at once."""
    engine = Engine(_graph_in(spark, d))
    heard: list[DataFrame] = []
    engine.listeners.append(lambda ids: heard.append(cut(ids)))
    engine.ingest(_traces(spark, d), NOW)
    return heard[0]


def ingest_fallbacks(spark: SparkSession, d: str) -> DataFrame:
    """Goal and outcome of queued traces whose own are empty come from the request's active goal and status."""
    engine = Engine(_store(spark))
    engine.ingest(_traces(spark, d).withColumn("active_goal", F.concat(F.lit("goal of "), "session_id")).withColumn("status", F.lit("failed")), NOW, synchronous=False)
    return engine.store.read("episodic_traces").select("id", "task_goal", "outcome")


def store_tables(spark: SparkSession, d: str) -> DataFrame:
    """All tables through a store: rows read again, columns left out at the write with their defaults."""
    store = _store(spark)
    nodes = table(spark, d, "nodes")
    half = nodes.withColumn("importance_score", F.when(F.col("access_count") % 2 != 0, F.lit(7.0)))
    store.write("nodes", nodes.limit(0))
    store.commit({"nodes": half, "edges": table(spark, d, "edges").drop("weight"), "node_anchors": table(spark, d, "node_anchors"), "episodic_traces": table(spark, d, "episodic_traces")})
    default = {"nodes": F.col("importance_score") == 0.5, "edges": F.col("weight") == 1.0}
    rows = None
    for name in ("nodes", "edges", "node_anchors", "episodic_traces"):
        one = store.read(name).agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(default.get(name, F.lit(False))).alias("n_defaults")).select(F.lit(name).alias("table_name"), F.lit(store.version(name)).alias("version"), "n_rows", "n_defaults")
        rows = one if rows is None else rows.unionByName(one)
    return rows


def service_insert(spark: SparkSession, d: str) -> DataFrame:
    """All nodes without their vectors, all edges and anchors inserted; what is then in the graph."""
    engine = Engine(_store(spark), embedder=lambda: HashEmbedder(16))
    engine.insert(table(spark, d, "nodes").drop("embedding"), table(spark, d, "edges"), table(spark, d, "node_anchors"), NOW)
    counts = {t: engine.store.read(t).count() for t in ("nodes", "edges", "node_anchors")}
    vectors = engine.store.read("nodes").where(F.size("embedding") == 16).count()
    return spark.createDataFrame([(*counts.values(), vectors)], "nodes long, edges long, anchors long, with_vector long")


def service_decay(spark: SparkSession, d: str) -> DataFrame:
    from datetime import timedelta

    store = _store(spark)
    store.commit({"nodes": _cur(spark, d), "edges": table(spark, d, "edges").where(F.col("source_id").isNotNull() & F.col("target_id").isNotNull()), "node_anchors": table(spark, d, "node_anchors")})
    counts = Engine(store).scoped_decay(ScopedDecay("transient", half_life=timedelta(hours=480), grace=timedelta(days=30), threshold=0.4), NOW)
    return spark.createDataFrame(list(counts.items()), "what string, n long")


def service_stats(spark: SparkSession, d: str) -> DataFrame:
    store = _store(spark)
    store.commit({"nodes": _cur(spark, d), "edges": table(spark, d, "edges"), "node_anchors": table(spark, d, "node_anchors")})
    engine = Engine(store)
    health, degree, live = engine.health(), engine.graph_summary().first()["avg_degree"], engine.consolidation_stats().first()["active_nodes"]
    return spark.createDataFrame([(health["status"], health["nodes"], health["edges"], round(degree, 9), live, health["bytes"] > 0)], "status string, nodes long, edges long, avg_degree double, active_nodes long, has_bytes boolean")


_ALL = (embed_generate, embed_queries, active_scan, point_lookup, session_traces, decay_scope_session_traces, decay_tally, import_text, vector_codec, request_parse, duration_parse, recall_fields, recall_json, stream_consolidate, stream_nodes, cycle_nodes, cycle_totals, ingest_notified, ingest_fallbacks, store_tables, service_insert, service_decay, service_stats)
QUERIES = {f.__name__: f for f in _ALL}
ORACLE = service_sql.ORACLE

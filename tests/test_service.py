"""The service object from insert to decay."""

from datetime import datetime, timedelta, timezone

from loomgraph.config import RecallRequest, ScopedDecay
from loomgraph.engine import Engine
from loomgraph.functions.embed import HashEmbedder
from loomgraph.sources.store import SCHEMAS, TableStore

NOW = datetime(2024, 6, 1, tzinfo=timezone.utc)


def test_life_of_a_graph(spark, tmp_path):
    e = Engine(TableStore(spark, str(tmp_path)), embedder=lambda: HashEmbedder(64), key="k")
    nodes = spark.createDataFrame([("a", "concept", "raft consensus timeout", "heartbeat of the cluster", False), ("b", "concept", "nginx reverse proxy", "worker_connections 4096", False), ("s", "concept", "token", "the secret word", True), ("", "x", "y", "z", False)], "id string, entity_type string, label string, summary string, is_secret boolean")
    edges = spark.createDataFrame([("a", "b", "relates_to", 0.9), ("a", None, "r", 1.0)], "source_id string, target_id string, relation_type string, weight double")
    anchors = spark.createDataFrame([("b", " Proxy "), ("gone", "x")], "node_id string, anchor_tag string")
    assert e.insert(nodes, edges, anchors, NOW) == {"nodes": 3, "edges": 1, "anchors": 2}
    assert e.store.read("nodes").where("id = 's'").first().summary.startswith("enc:v1:")
    top = e.recall([RecallRequest(query="cluster coordination interval"), RecallRequest(query="worker_connections", top_k=1), RecallRequest(query="token", include_secrets=True, top_k=1)], NOW, record=True)
    first = {r.query_no: r for r in top.where("place = 1").collect()}
    assert first[0].id == "a" and first[1].id == "b" and first[0].dense_score > 0.7
    assert e.store.read("nodes").where("id = 'a'").first().access_count >= 1
    heard = []
    e.listeners.append(lambda ids: heard.append(ids.count()))
    trace = spark.createDataFrame([("t1", "sess", "Watch the queue", "success", '{"trajectory": [{"step_index": 0, "thought": "check the raft election", "action": "probe", "observation": "ok"}]}')], "id string, session_id string, task_goal string, outcome string, trace_payload string")
    one = e.ingest(trace, NOW)
    assert one["created"] > 2 and heard == [one["created"] + one["updated"]]
    assert e.ingest(trace, NOW)["created"] == 0
    named = spark.createDataFrame([("t9", "sess", "", "Other goal", "", "failed")], "id string, session_id string, task_goal string, active_goal string, outcome string, status string")
    e.ingest(named, NOW, synchronous=False)
    assert [tuple(r) for r in e.store.read("episodic_traces").where("id = 't9'").select("task_goal", "outcome").collect()] == [("Other goal", "failed")]
    assert e.run_cycle(NOW)["traces"] == 1
    assert e.ingest(spark.createDataFrame([("t2", "sess", "goal", "ok", "{}")], trace.schema), NOW, synchronous=False) == {"queued": 1}
    assert e.run_cycle(NOW)["traces"] == 1
    assert e.health()["nodes"] == e.store.read("nodes").count() and e.graph_summary().count() == 1
    counts = e.scoped_decay(ScopedDecay("session", "sess"), NOW + timedelta(days=3))
    assert counts.get("archived", 0) + counts.get("protected", 0) >= 2 and counts["out_of_scope"] >= 1
    stats = e.consolidation_stats().first()
    assert stats.consolidated_traces == 3 and stats.archived_nodes == counts.get("archived", 0)
    assert set(e.store.read("nodes").columns) == {c.split()[0] for c in SCHEMAS["nodes"].split(", ")}


def test_recall_sees_what_came_since_the_last_call(spark, tmp_path):
    e = Engine(TableStore(spark, str(tmp_path)), embedder=lambda: HashEmbedder(16))
    rows = lambda *labels: spark.createDataFrame([(x, x) for x in labels], "id string, label string")
    e.insert(rows("ring buffer", "write path"), now=NOW)
    ask = [RecallRequest(query="retry budget")]
    assert {r.id for r in e.recall(ask, NOW).collect()} == {"ring buffer", "write path"}
    version = e.store.version("index")
    assert e.recall(ask, NOW).count() == 2 and e.store.version("index") == version
    e.insert(rows("retry budget"), now=NOW)
    assert e.recall(ask, NOW).orderBy("place").first().id == "retry budget" and e.store.version("index") == version + 1


def test_keys_of_requests():
    from loomgraph.functions.secure import authorised

    assert authorised("/x", {}, "") and authorised("/health", {}, "k") and not authorised("/x", {}, "k")
    assert authorised("/x", {"x-api-key": "k"}, "k") and authorised("/x", {"Authorization": "Bearer k"}, "k") and not authorised("/x", {"X-API-Key": "j"}, "k")

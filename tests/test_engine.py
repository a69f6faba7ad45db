"""Recall, extraction, fusion, decay, store, embeddings, secrets and streaming against small models of the rules."""

import hashlib
import json
import math
import re
from collections import Counter
from datetime import datetime, timedelta, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.config import DecayConfig, Env, FusionConfig, RecallRequest, ScopedDecay, parse_duration, string_list
from loomgraph.functions import embed, secure
from loomgraph.functions import text as T
from loomgraph.operators import decay as D
from loomgraph.operators import graph as G
from loomgraph.operators import recall as R
from loomgraph.operators.extract import extract
from loomgraph.operators.fuse import fuse
from loomgraph.sources.store import SCHEMAS, TableStore, canonical, import_rows, pack_vectors, unpack_vectors
from loomgraph.streaming.consolidate import Cycle, stream

NOW = datetime(2024, 6, 1, tzinfo=timezone.utc)


def node(i, label="", summary="", vec=None, kind="concept", count=1, age_h=1.0, stability=1.0, importance=0.5, archived=False, secret=False):
    seen = NOW - timedelta(hours=age_h)
    return (i, kind, label, summary, vec, seen, seen, None, None, count, stability, importance, archived, secret)


def frame(spark, name, rows):
    return spark.createDataFrame(rows, SCHEMAS[name])


def ask(spark, nodes, request, edges=(), anchors=()):
    out = R.recall(frame(spark, "nodes", nodes), frame(spark, "edges", list(edges)), frame(spark, "node_anchors", list(anchors)), [request], NOW)
    return sorted(out.collect(), key=lambda r: r.place)


def test_weighted_ranking(spark):
    rows = [node("node-1", vec=[1.0, 0.0, 0.0], count=2, age_h=0.1), node("node-2", vec=[0.0, 1.0, 0.0], count=80, age_h=0.2), node("node-3", vec=[0.5, 0.5, 0.0], age_h=500, stability=0.5)]
    got = ask(spark, rows, RecallRequest(embedding=(1.0, 0, 0), weights=(0.6, 0.2, 0.2, 0.0)))
    assert [r.id for r in got][0] == "node-1" and len(got) == 3


def test_anchor_modes(spark):
    rows = [node("a", "x", vec=[1.0, 0.0]), node("b", "y", vec=[0.0, 1.0]), node("c", "z", vec=[0.0, 1.0], archived=True)]
    tags = [("b", " Project:Kestrel ", None), ("c", "#project:kestrel", None)]
    base = dict(embedding=(1.0, 0.0), mode="dense")
    assert [r.id for r in ask(spark, rows, RecallRequest(anchors=("project:kestrel",), **base), anchors=tags)] == ["b", "a"]
    assert [r.id for r in ask(spark, rows, RecallRequest(anchors=("#project:kestrel",), anchor_mode="filter", **base), anchors=tags)] == ["b"]
    assert ask(spark, rows, RecallRequest(anchors=("nothing",), anchor_mode="filter", **base), anchors=tags) == []
    assert all(r.anchor_score == 0 for r in ask(spark, rows, RecallRequest(**base), anchors=tags))


def test_mode_identities_and_secrets(spark):
    rows = [node("s", "heap_mb limit", "the heap limit", vec=[0.6, 0.8], secret=True)]
    for mode, of in (("dense", lambda r: r.dense_score), ("bm25", lambda r: r.bm25_score)):
        (r,) = ask(spark, rows, RecallRequest(query="heap_mb limit", embedding=(1.0, 0.0), mode=mode))
        assert r.sim_score == of(r) and r.summary == R.MASK
    (r,) = ask(spark, rows, RecallRequest(query="heap_mb limit", embedding=(1.0, 0.0), hybrid_alpha=0.8, include_secrets=True))
    assert abs(r.sim_score - (0.8 * r.dense_score + 0.2 * r.bm25_score)) < 1e-3 and r.summary == "the heap limit"


def test_gated_expansion_lifts_strong_neighbours_only(spark):
    rows = [node("seed", "a", vec=[1.0, 0.0]), node("strong", "b", vec=[0.0, 1.0]), node("weak", "c", vec=[0.0, 1.0]), node("self", "d", vec=[0.0, 1.0])]
    edges = [("seed", "strong", "r", 1.0, NOW, None), ("weak", "seed", "r", 0.45, NOW, None), ("self", "self", "r", 1.0, NOW, None), ("seed", "gone", "r", 1.0, NOW, None)]
    got = {r.id: r for r in ask(spark, rows, RecallRequest(embedding=(1.0, 0.0), mode="dense", expand_hops=1), edges)}
    assert got["strong"].hop_distance == 1 and got["weak"].hop_distance == 0 and got["strong"].total_score > got["weak"].total_score
    assert got["strong"].total_score <= 0.85 * got["seed"].total_score + 1e-3


@pytest.mark.parametrize("order", [(True, False), (False, True)])
def test_requests_of_a_batch_keep_their_own_permissions(spark, order):
    rows = [node("s", "heap_mb limit", secure_text, vec=[0.6, 0.8], secret=True) for secure_text in ["the heap limit"]]
    n, e, t = frame(spark, "nodes", rows), frame(spark, "edges", []), frame(spark, "node_anchors", [])
    requests = [RecallRequest(query="heap_mb limit", embedding=(1.0, 0.0), include_secrets=x, include_embeddings=not x) for x in order]
    got = {r.query_no: r for r in R.recall(n, e, t, requests, NOW).collect()}
    for q, allowed in enumerate(order):
        assert got[q].summary == ("the heap limit" if allowed else R.MASK) and (got[q].embedding is None) == allowed
    sealed = n.withColumn("summary", secure.encrypt(F.col("summary"), "k"))
    got = {r.query_no: r.summary for r in R.recall(sealed, e, t, requests, NOW, key="k").collect()}
    assert got == {q: "the heap limit" if allowed else R.MASK for q, allowed in enumerate(order)}


def test_requests_of_a_batch_keep_their_own_gates(spark):
    rows = [node("seed", "a", vec=[1.0, 0.0]), node("near", "b", vec=[0.0, 1.0])]
    edges = frame(spark, "edges", [("seed", "near", "r", 0.5, NOW, None)])
    base = dict(embedding=(1.0, 0.0), mode="dense")
    requests = [RecallRequest(expand_hops=1, min_edge_weight=0.9, **base), RecallRequest(expand_hops=1, min_edge_weight=0.1, **base), RecallRequest(min_edge_weight=0.1, **base), RecallRequest(expand_hops=1, min_edge_weight=0.1, relations=("q",), **base)]
    top, used = R.recall_graph(frame(spark, "nodes", rows), edges, frame(spark, "node_anchors", []), requests, NOW)
    assert {r.query_no: r.hop_distance for r in top.where("id = 'near'").collect()} == {0: 0, 1: 1, 2: 0, 3: 0}
    assert [(r.query_no, r.source_id, r.target_id) for r in used.collect()] == [(1, "seed", "near")]
    alone = {r.id: r.total_score for r in R.recall(frame(spark, "nodes", rows), edges, frame(spark, "node_anchors", []), [requests[1]], NOW).collect()}
    assert {r.id: r.total_score for r in top.where("query_no = 1").collect()} == alone


def test_requests_from_json():
    r = RecallRequest.from_dict({"query": "  #Project:X #y tuning parameters", "fields": "id, label", "traverse_relations": ["a ", ""], "hybrid_alpha": 0, "alpha": 0, "w_imp": 0.4, "unknown": 1})
    s = r.resolved()
    assert s.anchors == ["#project:x", "#y"] and s.tokens == ["tuning", "parameters"] and s.alpha == 0.0 and s.relations == ["a"]
    assert abs(s.w_sim + s.w_freq + s.w_rec + s.w_imp - 1) < 1e-12 and abs(s.w_imp - 0.4 / 1.2) < 1e-12
    assert parse_duration("1h30m") == timedelta(minutes=90) and parse_duration(1e9) == timedelta(seconds=1) and parse_duration("0") == timedelta(0)
    with pytest.raises(ValueError):
        parse_duration("soon")
    assert string_list(" a, ,b") == ["a", "b"]


# --- extraction and fusion against a reader that goes through one trace after the other ---


def keywords(text, most):
    counts = Counter()
    for tok in re.findall(T.KEYWORD_TOKEN, text):
        w = re.sub(T.INSTANCE_SUFFIX, "", tok.strip(T.KEYWORD_TRIM).lower())
        if len(w) < 3 or w in T.KEYWORD_STOP_WORDS or len(re.sub("[^a-z]", "", w)) < 3 or re.match(T.NUMBER_WITH_UNIT, w) or re.match(T.HEX_DIGEST, w):
            continue
        counts[w] += 1
    kept = {w for w, _ in sorted(counts.items(), key=lambda x: -x[1])[:most]}
    return [w for w in counts if w in kept]


def limit(n):
    return 8 if n <= 200 else min(80, 8 + int(math.sqrt(n) * 0.4))


def ident(prefix, seed):
    return (prefix + "-" + hashlib.sha256(seed.encode()).hexdigest())[:16]


def model_trace(tid, sid, goal, outcome, doc):
    """(entities [(id, type, label, salience)], relations [(source, target, type, weight)]) of a simple trace, in order."""
    s = {"success": 1.0, "failure": 0.1}.get(outcome, 0.5)
    gid, seen = ident("task", goal), set()
    ents, rels, prev = [(gid, "task_goal", goal, s)], [], None

    def concept(word, sal, owner, kind, weight):
        cid = ident("concept", word)
        if word not in seen:
            seen.add(word)
            ents.append((cid, "concept", word, sal))
        rels.append((owner, cid, kind, weight))

    for st in doc.get("trajectory", []):
        did = ident("dec", f"{sid}-step-{st['step_index']}-{st['action']}")
        ents.append((did, "decision", f"Step {st['step_index']}: {st['action']}", s * 0.85))
        rels.append((did, gid, "subgoal_of", s))
        if prev:
            rels.append((prev, did, "precedes", 0.8 * s))
        prev = did
        pool = f"{st['thought']} {st['action']} {st['observation']}"
        for w in keywords(pool, limit(len(pool))):
            concept(w, s * 0.7, did, "associates_with", 0.6 * s)
    log = doc.get("logs", "")
    lines = [x.strip() for x in log.split("\n") if len(x.strip()) >= 8]
    if lines:
        kind = lambda x: "incident" if re.search(T.INCIDENT, x.lower()) else "telemetry" if re.search(T.TELEMETRY, x.lower()) else "procedure" if re.search(T.PROCEDURE, x.lower()) else "episodic_event"
        lab = lambda x: x if len(x) <= 48 else x[:48] + "..."
        first, others = {}, []
        for i, x in enumerate(lines):
            if kind(x) == "incident":
                first.setdefault(lab(x).lower(), i)
            else:
                others.append(i)
        rest = 3 - len(first)
        picked = list(first.values()) + (others[:: max(1, len(others) // rest) if len(others) > rest else 1] if rest > 0 else [])
        done, n = set(), 0
        for i in picked:
            if n >= 3:
                break
            x = lines[i]
            if (lab(x).lower(), kind(x)) in done:
                continue
            done.add((lab(x).lower(), kind(x)))
            n += 1
            eid = ident("evt", f"{x}-{i}")
            ents.append((eid, kind(x), lab(x), s * 0.8))
            rels.append((eid, gid, "subgoal_of" if kind(x) == "procedure" else "context_for", 0.7 * s))
            if kind(x) == "incident":
                for w in keywords(x, 6):
                    concept(w, s * 0.7, eid, "associates_with", 0.6 * s)
        for w in keywords(log, limit(len(log))):
            concept(w, s * 0.7, gid, "associates_with", 0.6 * s)
    return ents, rels


def sample_traces():
    rng = np.random.default_rng(4)
    vocabulary = ["retry", "queue", "leader", "election", "sample_17", "60.00c", "deadbeef01", "the", "heap_mb", "proxy", "Cache", "worker"]
    out = []
    for k in range(12):
        say = lambda n: " ".join(rng.choice(vocabulary, n))  # noqa: E731, B023
        doc = {"trajectory": [{"step_index": i, "thought": say(6), "action": f"act_{rng.integers(3)}", "observation": say(4)} for i in range(rng.integers(0, 4))]}
        if k % 2:
            doc["logs"] = "\n".join(rng.choice(["ERROR lost lease of the queue", "temp=60 fan ok now", "start of the worker", "plain words only here", "short"], rng.integers(1, 9)))
        out.append((f"t{k:02}", f"s{k % 3}", f"goal {k % 4}", ["success", "failure", "odd"][k % 3], json.dumps(doc), False, NOW + timedelta(hours=k), None))
    return out


def test_extraction_equals_reader(spark):
    rows = sample_traces()
    e = extract(frame(spark, "episodic_traces", [*rows, rows[0], ("bad", "s", None, None, "{", False, NOW, None)]))
    got = Counter((r.trace_id, r.id, r.entity_type, r.label, round(r.salience, 6)) for r in e.entities.collect())
    rel = Counter((r.trace_id, r.source_id, r.target_id, r.relation_type, round(r.weight, 6)) for r in e.relations.collect())
    want, want_rel = Counter(), Counter()
    for tid, sid, goal, outcome, doc, *_ in rows:
        ents, rels = model_trace(tid, sid, goal, outcome, json.loads(doc))
        want.update((tid, i, t, lab, round(s, 6)) for i, t, lab, s in ents)
        want_rel.update((tid, a, b, t, round(w, 6)) for a, b, t, w in rels)
    assert Counter({k: v for k, v in got.items() if k[0] != "bad"}) == want
    assert rel == want_rel
    assert [k[3] for k in got if k[0] == "bad"] == ["Episodic Task Session s"]


def test_fusion_equals_reader(spark):
    rows = sample_traces()
    stored = [node("old-queue", " Queue ", kind="concept", count=7, stability=0.2), node("old-goal", "GOAL 1", kind="task_goal", stability=0.95), node("gone", "proxy", archived=True)]
    edges = [("old-goal", "old-queue", "associates_with", 1.5, NOW, None)]
    cfg = FusionConfig()
    out = fuse(frame(spark, "nodes", stored), frame(spark, "edges", edges), extract(frame(spark, "episodic_traces", rows)), cfg)
    state = {r[0]: dict(stability=r[10], count=r[9]) for r in stored}
    live = {(r[2].strip().lower(), r[1]): r[0] for r in stored if not r[12]}
    weights = {tuple(r[:3]): r[3] for r in edges}
    importance = {r.id: r.importance for r in extract(frame(spark, "episodic_traces", rows)).entities.collect()}
    for tid, sid, goal, outcome, doc, *_ in rows:
        ents, rels = model_trace(tid, sid, goal, outcome, json.loads(doc))
        mapping, mine, new = {}, set(), set()
        for i, t, lab, s in ents:
            key = (lab.strip().lower(), t)
            if key in mine:
                mapping[i] = live[key]
                if key in new:
                    state[live[key]]["stability"] = min(1.0, state[live[key]]["stability"] + cfg.rate * s)
                    state[live[key]]["count"] += 1
                continue
            mine.add(key)
            if key in live:
                st = state[live[key]]
                st["stability"], st["count"] = min(1.0, st["stability"] + cfg.rate * s), st["count"] + 1
            else:
                live[key] = i
                new.add(key)
                state[i] = dict(stability=min(1.0, importance[i]), count=1)
            mapping[i] = live[key]
        trace_s = ents[0][3]
        for a, b, t, w in rels:
            a, b = mapping.get(a, a), mapping.get(b, b)
            if a != b:
                weights[(a, b, t)] = min(5.0, weights.get((a, b, t), 1.0) + cfg.rate * w * trace_s)
    got = {r.id: (round(r.stability_score, 6), r.access_count) for r in out.nodes.collect()}
    assert got == {i: (round(s["stability"], 6), s["count"]) for i, s in state.items()}
    assert {(r.source_id, r.target_id, r.relation_type): round(r.weight, 6) for r in out.edges.collect()} == {k: round(v, 6) for k, v in weights.items()}


def test_anchored_traces_tag_all_nodes_that_they_name(spark):
    rows = sample_traces()[:2]
    doc = json.loads(rows[0][4]) | {"anchors": [" Project:Kestrel ", "#x", ""]}
    rows[0] = (*rows[0][:4], json.dumps(doc), *rows[0][5:])
    stored = frame(spark, "nodes", [node("old-queue", " Queue ")])
    out = fuse(stored, frame(spark, "edges", []), extract(frame(spark, "episodic_traces", rows)))
    got = {(r.node_id, r.anchor_tag) for r in out.anchors.collect()}
    named = {r.canonical_id for r in out.canonical.where("trace_id = 't00'").collect()}
    assert got == {(i, t) for i in named for t in ("#project:kestrel", "#x")} and named


def test_same_trace_again_creates_nothing(spark):
    rows = sample_traces()[:3]
    empty_n, empty_e = frame(spark, "nodes", []), frame(spark, "edges", [])
    one = fuse(empty_n, empty_e, extract(frame(spark, "episodic_traces", rows)))
    again = fuse(canonical(one.nodes, "nodes"), one.edges, extract(frame(spark, "episodic_traces", rows)))
    assert again.created.count() == 0 and again.nodes.count() == one.nodes.count()


def test_decay_and_pruning(spark):
    rows = [node("fresh", age_h=1), node("stale", age_h=1000, importance=0.9), node("kept", age_h=1000, stability=1.0, importance=0.9)]
    out = {r.id: r for r in D.periodic(frame(spark, "nodes", rows), F.lit(NOW), DecayConfig()).collect()}
    assert abs(out["fresh"].stability_score - math.exp(-math.log(2) / 72)) < 1e-9 and not out["fresh"].is_archived and out["stale"].is_archived and out["stale"].archived_at
    marked = D.scoped(frame(spark, "nodes", [node("x", importance=0.3), node("y", importance=0.3), node("z", importance=0.9), node("old", archived=True)]), frame(spark, "node_anchors", [("y", "#a", None)]), F.lit(NOW), ScopedDecay("all"))
    assert {r.id: r.action for r in marked.collect()} == {"x": "archived", "y": "protected", "z": "protected", "old": "inactive"}
    assert {r.id for r in D.apply_scoped(marked, F.lit(NOW)).where("is_archived").collect()} == {"x", "old"}
    session = D.scoped(frame(spark, "nodes", [node("x", summary="of s1", importance=0.3), node("y", importance=0.3), node("t", importance=0.3)]), frame(spark, "node_anchors", []), F.lit(NOW), ScopedDecay("session", "s1"), spark.createDataFrame([("t",)], "id string"))
    assert {r.id: r.action for r in session.collect()} == {"x": "archived", "y": "out_of_scope", "t": "archived"}
    edges = [("x", "y", "r", 1.0, NOW, None), ("y", "z", "r", 0.01, NOW, None), ("y", "z", "q", 0.05, NOW, None)]
    assert [r.relation_type for r in D.prune_edges(frame(spark, "edges", edges), marked.where("action = 'archived'")).collect()] == ["q"]


def test_reinforcement_is_monotone_and_capped(spark):
    e = frame(spark, "edges", [])
    last = 0.0
    for _ in range(4):
        e = canonical(G.reinforce_edges(e, spark.createDataFrame([("a", "b", "r", 0.8, NOW)], "source_id string, target_id string, relation_type string, delta double, at timestamp"), 3.0), "edges")
        w = e.first().weight
        assert last <= w <= 3.0
        last = w
    assert last == 3.0


def test_upserts_keep_what_they_should(spark):
    old = node("a", "old", vec=[1.0], count=9, age_h=10, importance=0.9)
    new = node("a", "new", None, None, count=1, age_h=1, importance=0.1, stability=-1.0)
    r = G.upsert_nodes(frame(spark, "nodes", [old]), frame(spark, "nodes", [new, node("", "skipped"), node(None, "skipped")])).collect()
    assert len(r) == 1 and (r[0].label, r[0].embedding, r[0].access_count, r[0].importance_score, r[0].stability_score) == ("new", [1.0], 9, 0.9, 1.0)
    assert G.upsert_nodes(frame(spark, "nodes", []), frame(spark, "nodes", [])).count() == 0


def test_store_snapshots(spark, tmp_path):
    s = TableStore(spark, str(tmp_path))
    assert s.read("nodes").count() == 0 and s.version("nodes") == 0
    s.write("nodes", spark.createDataFrame([("a",)], "id string"))
    r = s.read("nodes").first()
    assert (r.importance_score, r.stability_score, r.is_archived, r.access_count) == (0.5, 1.0, False, 0)
    for _ in range(3):
        s.write("nodes", s.read("nodes").unionByName(s.read("nodes")))
    assert s.version("nodes") == 4 and s.read("nodes").count() == 8
    assert sorted(p.name for p in (tmp_path / "nodes").iterdir() if p.name.startswith("v=")) == ["v=3", "v=4"]


class Crash(Exception):
    pass


STEPS = ["wrote episodic_traces", "wrote node_anchors", "wrote nodes", "wrote edges", "wrote manifest", "committed"]


@pytest.mark.parametrize("step", STEPS)
def test_a_crash_between_any_two_steps_leaves_old_or_new_state_whole(spark, tmp_path, step):
    rows = frame(spark, "episodic_traces", sample_traces()[:2])
    s = TableStore(spark, str(tmp_path))
    s.write("nodes", frame(spark, "nodes", [node("old", "old one")]))
    state = lambda: {t: s.read(t).count() for t in SCHEMAS}
    before = state()

    def crash(at):
        if at == step:
            raise Crash

    s.fail = crash
    with pytest.raises(Crash):
        Cycle(s).run(NOW, arrived=rows, batch=("x", 0))
    s.fail = lambda at: None
    after = state()
    assert after == before if step != "committed" else after["episodic_traces"] == 2 and after["nodes"] > 1
    first = Cycle(s).run(NOW, arrived=rows, batch=("x", 0))
    assert first["traces"] == (0 if step == "committed" else 2)
    whole, version = state(), s.version("nodes")
    assert Cycle(s).run(NOW, arrived=rows, batch=("x", 0))["traces"] == 0 and state() == whole and s.version("nodes") == version


def test_a_second_writer_fails(spark, tmp_path):
    s = TableStore(spark, str(tmp_path))
    s.write("nodes", frame(spark, "nodes", [node("a")]))

    def other(at):
        if at == "wrote nodes":
            s.fail = lambda at: None
            TableStore(spark, str(tmp_path)).write("edges", frame(spark, "edges", []))

    s.fail = other
    with pytest.raises(Exception, match="another writer|exists"):
        s.write("nodes", frame(spark, "nodes", []))
    assert s.read("nodes").count() == 1


def test_deadline_cancels_jobs(spark):
    from loomgraph.session import deadline

    slow = spark.range(0, 4, 1, 4).select(F.pandas_udf(lambda x: __import__("time").sleep(20) or x, "long")("id"))
    with pytest.raises(Exception), deadline(spark, 1.0):  # noqa: B017, PT011
        slow.write.format("noop").mode("overwrite").save()
    with deadline(spark, 60.0):
        assert spark.range(3).count() == 3


def test_rows_from_elsewhere(spark):
    df = spark.createDataFrame([("a", "2024-01-02 03:04:05", "7", "0.5", "1", bytearray(np.array([1.5], "<f4").tobytes())), ("b", "soon", "x", "", "false", bytearray(b"abc"))], "id string, created_at string, access_count string, importance_score string, is_archived string, embedding binary")
    a, b = import_rows(df, "nodes").orderBy("id").collect()
    assert (a.created_at.year, a.access_count, a.importance_score, a.is_archived, a.embedding) == (2024, 7, 0.5, True, [1.5])
    assert (b.created_at, b.access_count, b.importance_score, b.is_archived, b.embedding) == (None, 0, 0.5, False, None)


def test_vector_codec(spark):
    df = spark.createDataFrame([([1.5, -2.0],), (None,)], "v array<float>").select(pack_vectors(F.col("v")).alias("b"))
    assert [r[0] for r in df.select(unpack_vectors(F.col("b"))).collect()] == [[1.5, -2.0], None]
    assert spark.createDataFrame([(bytearray(b"abc"),)], "b binary").select(unpack_vectors(F.col("b"))).first()[0] is None


def test_embeddings(spark):
    assert embed.fnv1a("a") == 0xAF63DC4C8601EC8C
    assert [embed.stem(w) for w in ("consolidations", "running", "queries", "cat", "trace")] == ["consolid", "runn", "query", "cat", "trac"]
    e = embed.HashEmbedder(64)
    a, b, c, d, z = e.embed_batch(["raft consensus timeout", "cluster coordination interval", "Raft consensus TIMEOUT ", "unrelated kitchen recipe", ""])
    assert a @ c > 0.9999 and a @ b > 0.7 and a @ d < 0.25 and not z.any() and abs(np.linalg.norm(a) - 1) < 1e-5

    class Broken:
        def embed_batch(self, texts):
            raise OSError

    def answer(url, body, headers, timeout):
        texts = json.loads(body)["input"]
        data = [{"index": i, "embedding": [float(x) for x in e.embed_batch([t])[0]]} for i, t in enumerate(texts)]
        return (200, json.dumps({"data": data[::-1]}).encode()) if headers["Authorization"] == "Bearer key" else (401, b'{"error": "no"}')

    remote = embed.HttpEmbedder("http://x/v1/embeddings", "m", "key", batch=2, post=answer)
    assert np.allclose(remote.embed_batch(["raft consensus timeout", "b", "c"]), e.embed_batch(["raft consensus timeout", "b", "c"]))
    with pytest.raises(RuntimeError):
        embed.HttpEmbedder("http://x", post=lambda *a: (200, b'{"data": []}')).embed_batch(["x"])
    f = embed.WithFallback(Broken(), e)
    assert f.embed_batch(["x"]).shape == (1, 64) and f.status == "degraded"
    df = spark.createDataFrame([("raft consensus timeout", None), (None, None), ("kept", [1.0])], "t string, v array<float>")
    got = embed.with_embeddings(df, "t", "v", lambda: embed.HashEmbedder(64)).collect()
    assert np.allclose(got[0].v, a, atol=1e-6) and not any(got[1].v) and got[2].v == [1.0]


def test_secrets(spark, monkeypatch):
    rows = spark.createDataFrame([("plain" * 40,), ("vault://x",), ("",), ("enc:v1:!!",), (None,)], "s string")
    once = rows.select("s", secure.encrypt(F.col("s"), "k").alias("e"))
    got = once.select("s", "e", secure.decrypt(F.col("e"), "k").alias("d"), secure.decrypt(F.col("e"), "other").alias("o"), secure.encrypt(F.col("e"), "k").alias("twice")).collect()
    assert got[0].e.startswith("enc:v1:") and "\n" not in got[0].e and got[0].d == got[0].s and got[0].o is None and got[0].twice[:7] == "enc:v1:"
    assert got[1].e == "vault://x" and got[2].e == "" and got[3].d is None and got[4].e is None
    monkeypatch.delenv("LOOMGRAPH_MASTER_KEY", raising=False)
    with pytest.raises(ValueError):
        secure.master_key()
    assert secure.master_key("given") == "given"


def test_stream_leaves_the_same_state_as_a_batch(spark, tmp_path):
    rows = sample_traces()
    frame(spark, "episodic_traces", rows).coalesce(1).write.parquet(str(tmp_path / "in"))
    a, b = TableStore(spark, str(tmp_path / "a")), TableStore(spark, str(tmp_path / "b"))
    late = NOW + timedelta(days=30)
    stream(spark, str(tmp_path / "in"), Cycle(a), str(tmp_path / "progress"), late).awaitTermination()
    stream(spark, str(tmp_path / "in"), Cycle(a), str(tmp_path / "progress"), late).awaitTermination()  # nothing new
    batch = Cycle(b)
    batch.enqueue(frame(spark, "episodic_traces", rows))
    stats = batch.run(late)
    assert stats["traces"] == 12 and batch.run(late)["traces"] == 0
    take = lambda s, first: {(r.id, r.access_count) for r in s.read("nodes").collect()}
    assert take(a, 1) == take(b, 1)
    assert a.read("episodic_traces").where("consolidated").count() == 12


def test_the_time_of_a_cycle_follows_the_traces_that_arrive(spark, tmp_path):
    rows = [(f"{n}-{r[0]}", *r[1:]) for n in range(5) for r in sample_traces()]
    slow = frame(spark, "episodic_traces", rows).coalesce(1).withColumn("task_goal", F.pandas_udf(lambda x: __import__("time").sleep(5) or x, "string")("task_goal"))
    # Three seconds for each trace: 60 of them have the five that they take at least, a whole batch of 500 has not.
    assert Cycle(TableStore(spark, str(tmp_path / "a")), timeout=3.0, batch_size=1).run(NOW, arrived=slow)["traces"] == 60
    with pytest.raises(Exception, match="(?i)cancel"):
        Cycle(TableStore(spark, str(tmp_path / "b")), timeout=3.0).run(NOW, arrived=slow)


def test_env_file(tmp_path, monkeypatch):
    p = tmp_path / "env"
    p.write_text("# note\nexport LG_A='1'\nLG_B=2\n")
    monkeypatch.setenv("LG_B", "3")
    env = Env.load(str(p))
    assert env.get("LG_A") == "1" and env.get("LG_B") == "3" and env.get("LG_C", "x") == "x"


def test_queries_and_sql_agree_on_names(data):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_incident_edges_of_all_scored_nodes(spark, data):
    import __spark_entry__ as e

    ids = {r.node_id for r in spark.read.parquet(f"{data}/scored_nodes.parquet").collect()} - {None}
    edges = spark.read.parquet(f"{data}/edges.parquet").select("source_id", "target_id", "relation_type", "weight").collect()
    want = sorted(str(r) for r in edges if r.source_id in ids or r.target_id in ids)
    assert len(ids) > 50 and sorted(str(r) for r in e.queries()["incident_edges_scored"](spark, data).collect()) == want


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0


def test_hit_rate_on_a_graph_of_targets_and_decoys(spark):
    """54 targets of one project among 162 fresher, busier decoys of others, 866 edges: the target comes first."""
    rng = np.random.default_rng(42)
    topics = ["ring buffer", "lease renewal", "shard map", "write path", "read quorum", "snapshot cadence", "anchor decay", "thermal guard", "queue depth", "retry budget", "index merge", "cache warmup", "token bucket", "leader change", "trace format", "edge pruning", "key rotation", "batch window"]
    variants = ["policy", "limits", "rollout"]
    e = embed.HashEmbedder(384)
    rows, tags = [], []
    for name, kind, count, age in (("Gannetry", "decision", 35, 0.5), ("Harrier", "concept", 45, 0.08), ("Osprey", "concept", 45, 0.08), ("Merlin", "concept", 45, 0.08)):
        for topic in topics:
            for variant in variants:
                label = f"Project {name} {variant} {topic}"
                i = label.replace(" ", "-").lower()
                rows.append([i, label, f"{variant} of the {topic} agreed for {name}", kind, count, age])
                if name == "Gannetry":
                    tags.append((i, "#project:gannetry", None))
    vectors = e.embed_batch([f"{r[1]} {r[2]}" for r in rows])
    nodes = [node(i, label, summary, [float(x) for x in v], kind, count, age) for (i, label, summary, kind, count, age), v in zip(rows, vectors)]
    targets, everything = [r[0] for r in rows[:54]], [r[0] for r in rows]
    pick = lambda ids, n: [(str(a), str(b)) for a, b in zip(rng.choice(ids, n), rng.choice(ids, n))]
    edges = {(a, b, ("depends_on", "subgoal_of", "anchored_to")[k % 3], (0.85, 0.8, 0.75)[k % 3]) for k, (a, b) in enumerate(pick(targets, 250))}
    edges |= {(a, b, "incidental_mention", 0.4) for a, b in pick(everything, 300)} | {(a, b, "relates_to", 0.55) for a, b in pick(everything, 316)}
    asked = [(v, t) for t in topics for v in variants]
    asked = [asked[k % 54] for k in range(100)]
    queries = [f"Project Gannetry {v} {t}" for v, t in asked]
    requests = [RecallRequest(query=q, embedding=tuple(map(float, v)), expand_neighbours=True) for q, v in zip(queries, e.embed_batch(queries))]
    got = R.recall(frame(spark, "nodes", nodes), frame(spark, "edges", [(*x, NOW, None) for x in edges]), frame(spark, "node_anchors", tags), requests, NOW).where("place = 1").collect()
    hits = sum(r.id == queries[r.query_no].replace(" ", "-").lower() and r.hop_distance == 0 for r in got)
    assert len(got) == 100 and hits >= 90


def test_fields_and_json(spark):
    rows = [node("a", "x", "", vec=[1.0, 0.0])]
    n, e, t = frame(spark, "nodes", rows), frame(spark, "edges", []), frame(spark, "node_anchors", [])
    some = R.recall(n, e, t, [RecallRequest(embedding=(1.0, 0.0), fields=("Label", "embedding", "nothing"))], NOW)
    assert set(some.columns) == {"query_no", "id", "place", "label", "embedding"}
    full = R.recall(n, e, t, [RecallRequest(embedding=(1.0, 0.0))], NOW)
    assert "embedding" not in full.columns
    body = json.loads(R.as_json(full).first().body)
    assert body["id"] == "a" and "bm25_score" not in body and "summary" not in body and body["dense_score"] == 1.0

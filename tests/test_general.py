"""Orphan references, nested records, skewed keys: brute force and edge cases."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from loomgraph.functions.jsonwalk import fold, parse, unwrap
from loomgraph.operators import references as R
from loomgraph.operators import shred as S
from loomgraph.operators import skew
from loomgraph.operators import sources_profile as P
from loomgraph.plans import general

NODES = "id string, is_archived boolean, created_at timestamp, last_accessed_at timestamp, reason string, salt int"
EDGES = "source_id string, target_id string, relation_type string, weight double, created_at timestamp, ref_key string, salt string"


def t(day):
    return datetime(2024, 1, day)


def found(spark, edges, nodes):
    o = R.edge_orphans(spark.createDataFrame(edges, EDGES), spark.createDataFrame(nodes, NODES))
    return {(r.source_id, r.target_id, r.side, r.reason) for r in o.collect()}


def test_orphans_of_every_kind(spark):
    nodes = [("A", False, t(1), t(2), "x", 1), ("b", False, t(1), t(1), "x", 1), ("b", True, t(1), t(5), "x", 1), (" late ", False, t(20), t(21), None, 1), ("n", None, None, None, None, None)]
    edges = [("\ta ", "B", "r", 1.0, t(3), "k", "s"), ("a", "late", None, 1.0, t(4), None, None), ("late", "a", "r", 1.0, t(25), None, None), (None, "gone", "r", None, None, None, None), ("  ", "n", "r", 1.0, t(1), None, None)]
    assert found(spark, edges, nodes) == {("a", "b", "target", "archived"), ("a", "late", "target", "not_yet_created"), ("", "gone", "target", "missing")}


def test_orphans_of_empty_tables(spark):
    assert found(spark, [], []) == set()
    assert found(spark, [("a", "b", "r", 1.0, t(1), None, None)], []) == {("a", "b", "source", "missing"), ("a", "b", "target", "missing")}
    assert found(spark, [], [("a", False, t(1), t(1), None, None)]) == set()


def test_orphans_of_a_heavy_key_are_salted_without_loss(spark, monkeypatch):
    monkeypatch.setattr(R, "SALT_ROWS", 10)
    monkeypatch.setattr(R, "SALT_SHARE", 0.001)
    edges = [("hot", f"x{i % 7}", "r", 1.0, t(1 + i % 20), None, None) for i in range(300)] + [("c", "d", "r", 1.0, t(1), None, None)]
    o = R.edge_orphans(spark.createDataFrame(edges, EDGES), spark.createDataFrame([("x1", False, t(10), t(11), None, None)], NODES))
    rows = o.collect()
    early = sum(1 for i in range(300) if i % 7 == 1 and 1 + i % 20 < 10)
    assert sum(r.source_id == "hot" and r.side == "source" for r in rows) == 300
    assert sum(r.target_id == "x1" and r.side == "target" for r in rows) == early
    report = {(r.side, r.month, r.reason): (r.n_refs, r.n_keys) for r in R.orphan_report(o, "edges").collect()}
    assert report[("source", "2024-01", "missing")] == (301, 2)
    assert report[("target", "2024-01", "not_yet_created")] == (early, 1)


def brute_elements(doc_id, text):
    """(trace, list, pos, key) by plain recursion."""
    names = S.LIST_NAMES
    out = set()

    def visit(v):
        v = unwrap(v)
        if isinstance(v, list):
            for x in v:
                visit(x)
        elif isinstance(v, dict):
            for k, x in v.items():
                x = unwrap(x)
                if fold(k) in names and isinstance(x, (list, dict)):
                    for i, e in enumerate(x if isinstance(x, list) else [x]):
                        e = unwrap(e)
                        if e is None:
                            continue
                        out.add((doc_id, names[fold(k)], i, ""))
                        if fold(k) == "candidateactions" and isinstance(e, dict):
                            for pk, pv in e.items():
                                pv = unwrap(pv)
                                if fold(pk) == "payload" and isinstance(pv, dict):
                                    out.update((doc_id, "candidate_actions", i, key) for key in pv)
                else:
                    visit(x)

    visit(parse(text))
    return out


ODD = [
    ("t1", json.dumps({"Trajectory": [{"a": 1}, None, "plain", [1]], "data": {"candidateActions": {"payload": json.dumps({"x": None, "y": {"trajectory": [1]}})}}})),
    ("t2", json.dumps(json.dumps({"sensory_context": json.dumps([{"text": "x", "trajectory": [{"b": 1}]}, json.dumps(None)])}))),
    ("t3", '{"trajectory": [1'),
    ("t4", None),
    ("t5", ""),
    ("t6", json.dumps({"payload": {"trajectory": [{"payload": {"q": 1}}]}, "candidate_actions": [{"pay_load": {}, "meta": {"payload": {"deep": 1}}}, {"payload": [1]}, {"PAYLOAD": {"k": [1, {"z": 2}]}}]})),
    ("t7", "[" * 100_000),
    (None, json.dumps({"trajectory": [1]})),
    ("t8", json.dumps({"trajectory": [{"thought": "x" * 1_000_000}]})),
    ("t1", json.dumps({"trajectory": []})),
]


def test_found_elements_equal_brute_force(spark, data):
    df = spark.createDataFrame([(a, b, "x", "y") for a, b in ODD], "id string, trace_payload string, doc_id string, table_name string")
    got = {tuple(r) for r in S.found_elements(S.shred(df, "id", "trace_payload", S.TRACE_SPEC)).collect()}
    assert got == set().union(*(brute_elements(a, b) for a, b in ODD))
    real = spark.read.parquet(f"{data}/episodic_traces.parquet")
    got = {tuple(r) for r in S.found_elements(S.shred(real, "id", "trace_payload", S.TRACE_SPEC)).collect()}
    assert got == set().union(*(brute_elements(r.id, r.trace_payload) for r in real.collect()))


def test_nested_payloads_keep_their_content(spark, tmp_path):
    payload = {"a": 1, "retry": {"max": 2, "wait": {"s": 3}}, "tags": ["t4", "t5"], "steps": [{"n": 6, "in": {"m": 7}}, {"n": 8}], "none": None, "empty": {}}
    docs = [("t1", json.dumps({"candidate_actions": [{"payload": payload}, {"payload": json.dumps({"key": {"value": 9}})}]}))]
    spark.createDataFrame(docs, "id string, trace_payload string").write.parquet(f"{tmp_path}/episodic_traces.parquet")
    rows = general.p2_payload(spark, str(tmp_path)).collect()
    entries = {r.row_id for r in rows if r.path == ""}
    assert sorted((r.payload_key, r.kind) for r in rows if r.path == "") == [("a", "number"), ("empty", "object"), ("key", "object"), ("none", "null"), ("retry", "object"), ("steps", "list"), ("tags", "list")]
    assert {(r.payload_key, r.path, r.plain_value) for r in rows if r.plain_value is not None} == {("a", "", "1"), ("retry", "retry.max", "2"), ("retry", "retry.wait.s", "3"), ("key", "key.value", "9")}
    repeated = general.p2_elements(spark, str(tmp_path)).collect()
    assert {(r.table_name, r.pos, r.path, r.plain_value) for r in repeated} == {("tags", 0, "value", "t4"), ("tags", 1, "value", "t5"), ("steps", 0, "n", "6"), ("steps", 0, "in.m", "7"), ("steps", 1, "n", "8")}
    assert all(r.row_id in entries for r in rows) and all(r.parent_table == "payload" and r.parent_row in entries for r in repeated)


def test_shred_of_nothing(spark):
    df = spark.createDataFrame([], "id string, trace_payload string")
    assert S.shred(df, "id", "trace_payload", S.TRACE_SPEC).count() == 0


def test_every_row_finds_its_parent(spark, data):
    rows = S.shred(spark.read.parquet(f"{data}/episodic_traces.parquet").dropDuplicates(["id"]), "id", "trace_payload", S.TRACE_SPEC).collect()
    ids = {(r.doc_id, r.table_name, r.row_id) for r in rows}
    assert len(ids) == len(rows)
    assert all((r.doc_id, r.parent_table, r.parent_row) in ids for r in rows if r.parent_table is not None)


def test_shared_inlining_plan():
    graph = [("", "a", True, False), ("", "b", True, False), ("a", "c", True, False), ("b", "c", True, False), ("c", "limits", True, True), ("limits", "limits", True, True), ("a", "name", False, False)]
    plan = S.plan_tables(graph, S.NestedSpec())
    assert plan.tables == {"c", "limits"} and plan.recursive == {"limits"} and plan.shared == {"c", "limits"}


def test_too_many_field_names_are_refused(spark):
    df = spark.createDataFrame([("x", json.dumps({f"k{i}": 1 for i in range(50)}))], "id string, doc string")
    with pytest.raises(ValueError, match="more than 10"):
        S.infer_plan(df, "doc", S.NestedSpec(max_types=10))


def test_source_stats_with_a_heavy_source(spark):
    rows = [("Hot ", f"t{i % 50}", "r", 0.5, t(1), None, None) for i in range(500)] + [("c", "", "r", float("nan"), t(1), None, None), (None, "x", "r", 1.0, t(1), None, None), ("c", "d", None, None, None, None, None), ("c", "d", "r", -2.0, None, None, None)]
    got = {r.source_id: r for r in P.source_stats(spark.createDataFrame(rows, EDGES), salts=8).collect()}
    assert set(got) == {"hot", "c"}
    assert (got["hot"].n_edges, got["hot"].total_weight, got["hot"].n_neighbours) == (500, 250.0, 50)
    assert (got["c"].n_edges, got["c"].total_weight, got["c"].max_weight, got["c"].n_neighbours) == (3, -2.0, -2.0, 1)
    assert [r.source_id for r in P.dominant_sources(spark.createDataFrame(rows, EDGES)).collect()] == ["hot"]
    assert P.source_stats(spark.createDataFrame([], EDGES)).count() == 0
    assert P.dominant_sources(spark.createDataFrame([], EDGES)).count() == 0


def test_salt_spreads_only_heavy_keys(spark):
    df = spark.createDataFrame([("h", i) for i in range(100)] + [("l", 1), (None, 2)], "key string, salt int")
    out, name = skew.salted(df, "key", F.col("salt"), 102, min_share=0.5, salts=8)
    assert name == "salt_"
    by = {r.key: r.d for r in out.groupBy("key").agg(F.countDistinct(name).alias("d")).collect()}
    assert by["h"] > 4 and by["l"] == 1 and by[None] == 1


def test_sized_join_equals_a_join(spark):
    left = spark.createDataFrame([("h", i) for i in range(50)] + [("a", 1), ("b", 2), (None, 3)], "k string, v int")
    right = spark.createDataFrame([("h", "x", 50), ("h", "y", 50), ("a", "z", 1), ("c", "w", 0)], "k string, w string, n int")
    plain = sorted(map(str, left.join(right, "k").collect()))
    assert sorted(map(str, skew.join_sized(left, right, "k", "n", 53, rows=10, share=0.1).collect())) == plain and len(plain) == 101

"""Nested documents to related flat tables by shared inlining.

1. The schema graph of all documents is inferred in one distributed pass: its nodes are element types (folded field
   names), its edges say which type occurs in which, how often, and whether as an object or a list.
2. Shared inlining decides from the graph alone: a type gets its own table if it repeats in a parent, is an object
   shared by several parents, or is recursive; every other descendant is inlined into its nearest table.
3. A second pass shreds the documents. Every row carries the document's id, its own row id, its position and the
   table and row id of its parent, so the tables join back without order or state.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.jsonwalk import graph_edges
from loomgraph.functions.jsonwalk import shred as shred_document


@dataclass(frozen=True)
class NestedSpec:
    """What is known of the documents beforehand.

    ``lists``: types that are lists even where every document at hand has a lone object. ``entries``: free-form
    objects, kept as key/value rows. ``max_types``: the schema graph is refused beyond so many edges, since a
    collection with unbounded field names needs more ``entries`` types, not more tables.
    """

    lists: frozenset[str] = frozenset()
    entries: frozenset[str] = frozenset()
    max_types: int = 20_000


@dataclass(frozen=True)
class TablePlan:
    tables: frozenset[str]
    shared: frozenset[str] = frozenset()
    recursive: frozenset[str] = frozenset()
    repeated: frozenset[str] = frozenset()
    children: dict[str, tuple[str, ...]] = field(default_factory=dict)


TRACE_LISTS = ("trajectory", "sensorycontext", "candidateactions")
TRACE_SPEC = NestedSpec(lists=frozenset(TRACE_LISTS), entries=frozenset({"payload"}))
GRAPH_SCHEMA = "parent string, child string, holds boolean, listed boolean, most long, n long"
ROW_SCHEMA = "doc_id string, table_name string, row_id string, parent_table string, parent_row string, pos long, guards int, via string, columns map<string,string>"


def schema_graph(docs: DataFrame, document: str) -> DataFrame:
    """(parent, child, holds, listed, most, n): the edges of the schema graph; '' is the root.

    Each task merges the edges of its own documents before the shuffle. Documents that can't be parsed add nothing.
    """

    def edges(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[tuple[str, str], list] = {}
        for batch in batches:
            for text in batch.iloc[:, 0]:
                for parent, child, holds, listed, most in graph_edges(text):
                    e = seen.setdefault((parent, child), [False, False, 0, 0])
                    e[0], e[1], e[2], e[3] = e[0] or holds, e[1] or listed, max(e[2], most), e[3] + 1
        yield pd.DataFrame([(*k, *v) for k, v in seen.items()], columns=["parent", "child", "holds", "listed", "most", "n"])

    return (
        docs.select(document).mapInPandas(edges, GRAPH_SCHEMA)
        .groupBy("parent", "child")
        .agg(F.max("holds").alias("holds"), F.max("listed").alias("listed"), F.max("most").alias("most"), F.sum("n").alias("n"))
    )


def plan_tables(graph: list[tuple[str, str, bool, bool]], spec: NestedSpec) -> TablePlan:
    """Shared inlining over (parent, child, holds objects, is a list) edges."""
    parents: dict[str, set[str]] = {}
    children: dict[str, set[str]] = {}
    listed: set[str] = set(spec.lists)
    holds: set[str] = set()
    for parent, child, has_object, is_list in graph:
        parents.setdefault(child, set()).add(parent)
        children.setdefault(parent, set()).add(child)
        if is_list:
            listed.add(child)
        if has_object:
            holds.add(child)
    recursive = {t for t in parents if _reaches(t, children)}
    shared = {t for t in holds if len(parents[t]) > 1}
    tables = (listed | (recursive & holds) | shared) - spec.entries
    return TablePlan(frozenset(tables), frozenset(shared), frozenset(recursive), frozenset(listed), {k: tuple(sorted(v)) for k, v in children.items()})


def _reaches(start: str, children: dict[str, set[str]]) -> bool:
    todo, seen = list(children.get(start, ())), set()
    while todo:
        t = todo.pop()
        if t == start:
            return True
        if t not in seen:
            seen.add(t)
            todo.extend(children.get(t, ()))
    return False


def infer_plan(docs: DataFrame, document: str, spec: NestedSpec) -> TablePlan:
    edges = schema_graph(docs, document).select("parent", "child", "holds", "listed").limit(spec.max_types + 1).collect()
    if len(edges) > spec.max_types:
        raise ValueError(f"more than {spec.max_types} kinds of fields: name free-form objects in NestedSpec.entries")
    return plan_tables([tuple(e) for e in edges], spec)


def shred(docs: DataFrame, doc_id: str, document: str, spec: NestedSpec, plan: TablePlan | None = None) -> DataFrame:
    """All flat tables as one long frame (see ROW_SCHEMA); :func:`flat_table` takes one of them out.

    Documents that are null, empty or can't be parsed give no rows; repeated documents give repeated rows; other
    columns of ``docs`` are not read. A null id stays null.
    """
    plan = plan or infer_plan(docs, document, spec)
    tables, entries, guarded = plan.tables, spec.entries, spec.lists

    def rows(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["doc_id", "table_name", "row_id", "parent_table", "parent_row", "pos", "guards", "via", "columns"]
        for batch in batches:
            out: list[tuple] = []
            for key, text in zip(batch.iloc[:, 0], batch.iloc[:, 1]):
                out.extend((key, *r) for r in shred_document(text, tables, entries, guarded))
                if len(out) > 10_000:
                    yield pd.DataFrame(out, columns=names)
                    out = []
            yield pd.DataFrame(out, columns=names)

    source = docs.select(F.col(doc_id).cast("string"), F.col(document).cast("string"))
    return source.mapInPandas(rows, ROW_SCHEMA)


def flat_table(rows: DataFrame, name: str, columns: dict[str, str]) -> DataFrame:
    """One table: doc_id, row_id, parent_table, parent_row, pos and ``columns`` (output name to inlined path)."""
    picked = [F.col("columns")[path].alias(out) for out, path in columns.items()]
    return rows.where(F.col("table_name") == name).select("doc_id", "row_id", "parent_table", "parent_row", "pos", *picked)


def entry_table(rows: DataFrame, name: str) -> DataFrame:
    """A table of free-form objects: a row for each entry (path ''), and one for each leaf inlined in it (its path, folded).

    (doc_id, row_id, path) names a row; row_id is the entry's, so a leaf's parent is the row of path ''. What repeats
    within an entry is in a table of its own (:func:`element_leaves`), whose parent_row is the entry's row_id.
    """
    own = F.struct(F.lit("").alias("path"), F.col("columns")["value"].alias("value"))
    inlined = F.map_entries(F.map_filter("columns", lambda k, _: ~k.isin("key", "kind", "value")))
    leaves = F.transform(inlined, lambda e: F.struct(e["key"].alias("path"), e["value"].alias("value")))
    picked = rows.where(F.col("table_name") == name).withColumn("leaf", F.explode(F.concat(F.array(own), leaves)))
    key, kind = F.col("columns")["key"].alias("payload_key"), F.col("columns")["kind"].alias("kind")
    return picked.select("doc_id", "row_id", "parent_table", "parent_row", "pos", key, kind, F.col("leaf.path").alias("path"), F.col("leaf.value").alias("plain_value"))


def element_leaves(rows: DataFrame, besides: frozenset[str]) -> DataFrame:
    """All tables that the plan finds but ``besides`` and the root: a row for each leaf; path is null where a row has none."""
    picked = rows.where((F.col("table_name") != "") & ~F.col("table_name").isin(*besides))
    return picked.select("doc_id", "table_name", "row_id", "parent_table", "parent_row", "pos", F.explode_outer("columns").alias("path", "plain_value"))


#: The lists' names in results.
LIST_NAMES = {"trajectory": "trajectory", "sensorycontext": "sensory_context", "candidateactions": "candidate_actions"}


def found_elements(rows: DataFrame) -> DataFrame:
    """(trace_id, list_name, pos, payload_key): every element of the three lists and every payload key, once.

    One pass: the shredded rows are filtered and projected, never scanned twice.
    """
    names = F.create_map(*[F.lit(x) for pair in LIST_NAMES.items() for x in pair])
    element = F.col("table_name").isin(*LIST_NAMES) & (F.col("guards") == 0)
    # An action's own payload: a direct field (nothing inlined between) of an action that lies in no other list.
    key = (F.col("table_name") == "payload") & (F.col("parent_table") == "candidateactions") & (F.col("guards") == 1) & (F.col("via") == "")
    of_action = F.regexp_extract("parent_row", r"\[(\d+)\]$", 1).cast("long")
    return (
        rows.where(element | key)
        .select(
            F.col("doc_id").alias("trace_id"),
            F.when(element, names[F.col("table_name")]).otherwise("candidate_actions").alias("list_name"),
            F.when(element, F.col("pos")).otherwise(of_action).alias("pos"),
            F.when(element, "").otherwise(F.col("columns")["key"]).alias("payload_key"),
        )
        .distinct()
    )

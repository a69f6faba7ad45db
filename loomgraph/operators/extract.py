"""Episodic traces to entities and relations, as plans over the flat tables of the shredded documents.

All kinds of things are met in one staged pass; entities, relations and texts are projections of it, and the keywords of
all texts are counted together in one aggregation. The order in
which a reader of one trace would meet things is carried as (section, o1, o2), and a window over it keeps the first of
each label. All is keyed by trace, so a trace's work stays together and traces spread.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions import text as T
from loomgraph.functions.ids import clean_id
from loomgraph.operators.shred import TRACE_SPEC, flat_table, shred
from loomgraph.session import cut

# Weights of relations and saliences of entities, as shares of the trace's salience.
W_SUBGOAL, W_PRECEDES, W_STEP_CONCEPT = 1.0, 0.8, 0.6
W_PROPOSED, W_ACTION_CONCEPT, W_CHUNK_CONCEPT, W_EVENT, W_LOG_CONCEPT = 0.75, 0.55, 0.5, 0.7, 0.6
S_DECISION, S_CONCEPT, S_ACTION, S_ACTION_CONCEPT, S_EVENT = 0.85, 0.7, 0.8, 0.65, 0.8
MIN_SALIENCE, CHUNK_BYTES, INCIDENT_KEYWORDS = 0.3, 60, 6


@dataclass
class Extraction:
    entities: DataFrame  # trace_id, at, section, o1, o2, id, entity_type, label, summary, salience, importance, is_secret
    relations: DataFrame  # trace_id, at, source_id, target_id, relation_type, weight
    anchors: DataFrame  # trace_id, anchor_tag: the traces' own normalised tags


def _first_field(name: str) -> Column:
    """The first value that isn't blank of a field at any inlined level, or null."""
    found = F.map_filter("columns", lambda k, v: k.rlike(rf"(^|\.){name}$") & v.isNotNull() & (F.trim(v) != ""))
    return F.try_element_at(F.map_values(found), F.lit(1))


def _flag(column: Column) -> Column:
    return F.coalesce(F.lower(column) == "true", F.lit(False))


def trace_tables(traces: DataFrame) -> dict[str, DataFrame]:
    """trace, steps, chunks and actions of the traces, one document per id."""
    one = traces.where(F.col("id").isNotNull()).groupBy("id").agg(F.min(F.struct("created_at", "session_id", "task_goal", "outcome", "trace_payload")).alias("s")).select("id", "s.*")
    rows = cut(shred(one, "id", "trace_payload", TRACE_SPEC), "shredded")
    root = rows.where(F.col("table_name") == "")
    logs = F.coalesce(*[_first_field(n) for n in ("executiontrace", "trace", "rawtrace", "logs", "tracepayload")])
    secret = F.coalesce(F.exists(F.map_values(F.map_filter("columns", lambda k, v: k.rlike(r"(^|\.)issecret$") & v.isNotNull())), lambda v: F.lower(v) == "true"), F.lit(False))
    head = root.groupBy(F.col("doc_id").alias("id")).agg(F.max(logs).alias("log_text"), F.max(secret).alias("is_secret"))
    tags = rows.where((F.col("table_name") == "anchors") & (F.col("guards") == 0)).select(F.col("doc_id").alias("trace_id"), T.normal_anchor(F.col("columns")["value"]).alias("anchor_tag")).where(F.col("anchor_tag") != "").distinct()
    tagged = tags.select(F.col("trace_id").alias("id"), F.lit(True).alias("anchored")).distinct()
    goal = F.trim(F.coalesce("task_goal", F.lit("")))
    goal = F.when(goal == "", F.concat(F.lit("Episodic Task Session "), F.coalesce("session_id", F.lit("")))).otherwise(goal)
    trace = one.join(head, "id", "left").join(tagged, "id", "left").select(
        F.col("id").alias("trace_id"), F.col("created_at").alias("at"), F.coalesce("session_id", F.lit("")).alias("session_id"), goal.alias("goal"), T.content_id("task", goal).alias("goal_id"),
        T.outcome(F.col("outcome")).alias("outcome"), T.salience(F.col("outcome")).alias("s"), F.coalesce("is_secret", F.lit(False)).alias("trace_secret"), F.coalesce("anchored", F.lit(False)).alias("anchored"), "log_text",
    )
    slim = trace.select("trace_id", "at", "session_id", "goal_id", "s", "trace_secret", "anchored")

    def child(name: str, fields: dict[str, str]) -> DataFrame:
        flat = flat_table(rows.where(F.col("guards") == 0), name, fields).withColumnRenamed("doc_id", "trace_id")
        # Elements in the order of their lists: the list's path, then the position.
        order = F.row_number().over(Window.partitionBy("trace_id").orderBy(F.regexp_replace("row_id", r"\[[0-9]+\]$", ""), "pos"))
        return flat.withColumn("o1", order).join(slim, "trace_id")

    payload = rows.where((F.col("table_name") == "payload") & (F.col("guards") == 1)).select(F.col("doc_id").alias("trace_id"), F.col("parent_row").alias("row_id"), F.concat_ws(" ", F.col("columns")["key"], F.coalesce(F.col("columns")["value"], F.lit(""))).alias("kv"))
    payload = payload.groupBy("trace_id", "row_id").agg(F.concat_ws(" ", F.sort_array(F.collect_list("kv"))).alias("payload_text"))
    steps = child("trajectory", {"step_index": "stepindex", "thought": "thought", "action": "action", "observation": "observation", "secret": "issecret"})
    chunks = child("sensorycontext", {"text": "text", "salience": "salience", "secret": "issecret"})
    actions = child("candidateactions", {"aid": "id", "type": "type", "committed": "committed", "secret": "issecret"}).join(payload, ["trace_id", "row_id"], "left")
    return {"trace": trace, "steps": steps, "chunks": chunks, "actions": actions, "anchors": tags}


def pool_keywords(pools: DataFrame, carried: list[str]) -> DataFrame:
    """``pools`` (trace_id, section, o1, text, most, ...) to the kept keywords, with ``carried`` columns of their pools:
    (trace_id, section, o1, o2, keyword, ...). One shuffle of the texts serves counting and ranking."""
    key = ["trace_id", "section", "o1"]
    placed = pools.select(*key, "text", F.struct("most", *carried).alias("p")).repartition(*key)
    rows = placed.select(*key, "p", F.posexplode(T.keyword_tokens(F.col("text"))).alias("pos", "keyword"))
    counted = rows.groupBy(*key, "keyword").agg(F.first("p").alias("p"), F.count(F.lit(1)).alias("n"), F.min("pos").alias("o2"))
    kept = counted.withColumn("r", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("n"), "o2"))).where(F.col("r") <= F.col("p.most"))
    return kept.select(*key, "o2", "keyword", *[F.col(f"p.{c}") for c in carried])


def _first(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_r") == 1).drop("_r")


def log_events(trace: DataFrame) -> DataFrame:
    """Selected log lines: incidents first, each label once, then the other lines by stride, within the text's budget."""
    lines = F.filter(F.transform(F.split("log_text", "\n"), lambda x: F.trim(x)), lambda x: F.octet_length(x) >= 8)
    size = F.octet_length("log_text")
    budget = F.when(size < 3000, 3).when(size < 25000, 10).when(size < 100000, 25).otherwise(40)
    slim = trace.where(F.trim(F.coalesce("log_text", F.lit(""))) != "")
    rows = slim.select("trace_id", "at", "goal_id", "s", "trace_secret", "anchored", budget.alias("budget"), F.posexplode(lines).alias("i", "line"))
    rows = rows.withColumn("kind", T.line_kind(F.col("line"))).withColumn("label", T.event_label(F.col("line"))).withColumn("low", F.lower("label")).withColumn("late", F.when(F.col("kind") == "incident", 0).otherwise(1))
    # Repeated incident labels go first; other lines keep their repetitions until the stride has picked.
    once = Window.partitionBy("trace_id", "late", F.when(F.col("late") == 0, F.col("low")).otherwise(F.col("i").cast("string"))).orderBy("i")
    rows = rows.withColumn("_r", F.row_number().over(once)).where(F.col("_r") == 1).drop("_r")
    whole = Window.partitionBy("trace_id")
    rows = rows.withColumn("left", F.col("budget") - F.count_if(F.col("late") == 0).over(whole)).withColumn("others", F.count_if(F.col("late") == 1).over(whole))
    stride = F.when((F.col("left") > 0) & (F.col("others") > F.col("left")), F.floor(F.col("others") / F.when(F.col("left") > 0, F.col("left")).otherwise(1))).otherwise(1)
    rows = rows.withColumn("j", F.row_number().over(Window.partitionBy("trace_id", "late").orderBy("i")) - 1)
    rows = rows.where((F.col("late") == 0) | ((F.col("left") > 0) & (F.col("j") % stride == 0)))
    rows = _first(rows, ["trace_id", "low", "kind"], ["late", "i"])
    rows = rows.withColumn("o1", F.row_number().over(Window.partitionBy("trace_id").orderBy("late", "i"))).where(F.col("o1") <= F.col("budget"))
    return rows.withColumn("id", T.content_id("evt", F.concat_ws("-", "line", "i"))).drop("left", "others", "j", "late")


def extract(traces: DataFrame) -> Extraction:
    """Entities and relations of every trace. Traces without an id are left out; documents that can't be parsed still
    give their goal; repeated ids count once. Salience and weights are shares of the outcome's salience."""
    t = trace_tables(traces)
    trace, s, blank = t["trace"], F.col("s"), F.lit("")
    link_kind = "array<struct<source_id:string,target_id:string,relation_type:string,weight:double>>"

    def link(source: str, target: str, kind: Column | str, weight: Column) -> Column:
        return F.struct(F.col(source).alias("source_id"), F.col(target).alias("target_id"), (F.lit(kind) if isinstance(kind, str) else kind).alias("relation_type"), weight.cast("double").alias("weight"))

    def item(rows: DataFrame, section: int, ident: Column, secret: Column, entity: tuple[Column, Column, Column, Column] | None = None, links: Column | None = None, pool: tuple[Column, Column, Column, Column, str, str] | None = None) -> DataFrame:
        """A thing met in a trace: the entity that it is (kind, label, summary, salience), its links, and the text whose
        keywords become concepts (text, limit, weight and salience of a concept, relation, note)."""
        kind, label, summary, salience = entity or (F.lit(None).cast("string"),) * 3 + (F.lit(None).cast("double"),)
        text, most, weight, share, relation, note = pool or (F.lit(None).cast("string"), F.lit(0), F.lit(0.0), F.lit(0.0), "", "")
        o1 = F.col("o1") if "o1" in rows.columns else F.lit(0)
        return rows.select(
            "trace_id", "at", F.lit(section).alias("section"), o1.cast("int").alias("o1"), ident.alias("id"), kind.alias("entity_type"), label.alias("label"), summary.alias("summary"), salience.cast("double").alias("salience"), secret.alias("is_secret"), "anchored",
            (F.array() if links is None else links).cast(link_kind).alias("links"), text.alias("text"), most.cast("int").alias("most"), weight.cast("double").alias("weight"), share.cast("double").alias("share"), F.lit(relation).alias("relation"), F.lit(note).alias("note"),
        )

    goal_note = F.concat(F.lit("Episodic task goal for deliberation session "), "session_id", F.lit(" with outcome "), "outcome")
    items = [item(trace, 0, F.col("goal_id"), F.col("trace_secret"), (F.lit("task_goal"), F.col("goal"), goal_note, s))]

    steps = t["steps"].withColumn("thought", F.coalesce("thought", blank)).withColumn("action", F.coalesce("action", blank)).withColumn("idx", F.coalesce(F.expr("try_cast(step_index as int)"), F.lit(0)).cast("string"))
    steps = steps.withColumn("summary", F.when(F.trim("thought") != "", F.trim("thought")).otherwise(F.trim("action"))).where(F.col("summary") != "")
    steps = steps.withColumn("id", T.content_id("dec", F.concat(F.col("session_id"), F.lit("-step-"), F.col("idx"), F.lit("-"), F.col("action"))))
    steps = steps.withColumn("prev", F.lag("id").over(Window.partitionBy("trace_id").orderBy("o1")))
    text = F.concat_ws(" ", "thought", "action", F.coalesce("observation", blank))
    label = F.concat(F.lit("Step "), F.col("idx"), F.lit(": "), T.truncated(F.col("action"), 48))
    ties = F.when(F.col("prev").isNull(), F.array(link("id", "goal_id", "subgoal_of", s * W_SUBGOAL))).otherwise(F.array(link("id", "goal_id", "subgoal_of", s * W_SUBGOAL), link("prev", "id", "precedes", s * W_PRECEDES)))
    pool = (text, T.keyword_limit(F.octet_length(text)), s * W_STEP_CONCEPT, s * S_CONCEPT, "associates_with", "Salient concept extracted from episodic deliberation: ")
    items.append(item(steps, 1, F.col("id"), _flag(F.col("secret")) | F.col("trace_secret"), (F.lit("decision"), label, F.col("summary"), s * S_DECISION), ties, pool))

    acts = t["actions"].withColumn("type", F.trim(F.coalesce("type", blank))).where(F.col("type") != "").withColumn("label", F.concat(F.lit("Action: "), T.truncated(F.col("type"), 40))).withColumn("low", F.lower("label"))
    acts = _first(acts, ["trace_id", "low"], ["o1"]).withColumn("id", T.content_id("act", F.concat(F.col("session_id"), F.lit("-act-"), F.coalesce("aid", blank), F.lit("-"), F.col("type"))))
    summary = F.concat(F.lit("Candidate deliberation action "), F.col("type"), F.lit(" (committed: "), F.when(_flag(F.col("committed")), "true").otherwise("false"), F.lit(")"))
    text = F.concat_ws(" ", "type", "payload_text")
    pool = (text, T.keyword_limit(F.octet_length(text)), s * W_ACTION_CONCEPT, s * S_ACTION_CONCEPT, "associates_with", "Concept from action payload: ")
    items.append(item(acts, 2, F.col("id"), _flag(F.col("secret")) | F.col("trace_secret"), (F.lit("candidate_action"), F.col("label"), summary, s * S_ACTION), F.array(link("id", "goal_id", "proposed_for", s * W_PROPOSED)), pool))

    chunks = t["chunks"].withColumn("c", F.coalesce(F.expr("try_cast(salience as double)"), F.lit(0.0))).where((F.col("c") >= MIN_SALIENCE) & (F.trim(F.coalesce("text", blank)) != ""))
    chunks = chunks.withColumn("label", T.truncated(F.col("text"), 40)).withColumn("low", F.lower("label"))
    chunks = _first(chunks, ["trace_id", "low"], ["o1"]).withColumn("id", T.content_id("sensory", F.col("text")))
    c, long_enough = F.col("c"), F.octet_length("text") > CHUNK_BYTES
    pool = (F.when(long_enough, F.col("text")), T.keyword_limit(F.octet_length("text")), c * s * W_CHUNK_CONCEPT, c * s * S_CONCEPT, "context_for", "Sensory context concept: ")
    items.append(item(chunks, 3, F.col("id"), _flag(F.col("secret")) | F.col("trace_secret"), (F.lit("sensory_fact"), F.col("label"), F.col("text"), c * s), F.array(link("id", "goal_id", "context_for", c * s)), pool))

    events = log_events(trace)
    about = F.when(F.col("kind") == "procedure", "subgoal_of").otherwise("context_for")
    pool = (F.when(F.col("kind") == "incident", T.without_timestamp(F.col("line"))), F.lit(INCIDENT_KEYWORDS), s * W_LOG_CONCEPT, s * S_CONCEPT, "associates_with", "Execution trace concept: ")
    items.append(item(events, 4, F.col("id"), F.col("trace_secret"), (F.col("kind"), F.col("label"), F.col("line"), s * S_EVENT), F.array(link("id", "goal_id", about, s * W_EVENT)), pool))

    size = F.octet_length("log_text")
    wide = F.when(size > 25000, F.least(F.lit(100), F.floor(T.keyword_limit(size) * 1.5))).otherwise(T.keyword_limit(size))
    logs = trace.where(F.trim(F.coalesce("log_text", blank)) != "")
    items.append(item(logs, 5, F.col("goal_id"), F.col("trace_secret"), pool=(F.col("log_text"), wide, s * W_LOG_CONCEPT, s * S_CONCEPT, "associates_with", "Execution trace concept: ")))

    met = cut(functools.reduce(DataFrame.unionByName, items), "items")
    words = cut(pool_keywords(met.where(F.col("text").isNotNull()).withColumnRenamed("id", "owner"), ["at", "owner", "weight", "share", "is_secret", "anchored", "relation", "note"]).withColumn("id", T.content_id("concept", F.col("keyword"))), "words")

    columns = ["trace_id", "at", "section", "o1", "o2", "id", "entity_type", "label", "summary", "judged", "salience", "is_secret", "anchored"]
    plain = met.where(F.col("entity_type").isNotNull()).withColumn("o2", F.lit(-1)).withColumn("judged", F.col("summary")).select(columns)
    # The wording that decides a concept's importance: its note for steps and logs, the keyword alone otherwise.
    noted = F.concat("note", "keyword")
    concepts = _first(words, ["trace_id", "keyword"], ["section", "o1", "o2"])
    concepts = concepts.select("trace_id", "at", "section", "o1", "o2", "id", F.lit("concept").alias("entity_type"), F.col("keyword").alias("label"), noted.alias("summary"), F.when(F.col("section").isin(2, 3), F.col("keyword")).otherwise(noted).alias("judged"), F.col("share").alias("salience"), "is_secret", "anchored")
    entities = plain.unionByName(concepts).withColumn("importance", T.importance(F.col("entity_type"), F.col("label"), F.col("judged"), F.col("anchored"))).drop("judged", "anchored")
    relations = met.select("trace_id", "at", F.explode("links").alias("l")).select("trace_id", "at", "l.*")
    relations = relations.unionByName(words.select("trace_id", "at", F.col("owner").alias("source_id"), F.col("id").alias("target_id"), F.col("relation").alias("relation_type"), "weight"))
    return Extraction(entities, relations, t["anchors"])


def session_traces(traces: DataFrame, session_id: str) -> DataFrame:
    """The traces of a session; ids are compared trimmed and without case."""
    return traces.where(clean_id(F.col("session_id")) == session_id.strip().lower())


def session_scope(traces: DataFrame, session_id: str) -> DataFrame:
    """(id): goal, decision and sensory nodes that the session's traces gave."""
    e = extract(session_traces(traces, session_id)).entities
    return e.where(F.col("entity_type").isin("task_goal", "decision", "sensory_fact")).select("id").distinct()

"""One object for the whole service: insert, recall, ingest, decay, cycles and statistics over a snapshot store."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.config import DecayConfig, FusionConfig, RecallConfig, RecallRequest, ScopedDecay
from loomgraph.functions import secure
from loomgraph.functions.embed import Embedder, HashEmbedder, with_embeddings
from loomgraph.operators import decay as D
from loomgraph.operators import graph as G
from loomgraph.operators import recall as R
from loomgraph.operators.extract import extract, session_scope
from loomgraph.operators.fuse import fuse
from loomgraph.session import cut
from loomgraph.sources.store import TableStore, canonical
from loomgraph.streaming.consolidate import Cycle


class Engine:
    """The graph of ``store``. ``key``: secret summaries are encrypted under it on insert and readable on request.

    Listeners are called with the ids (a DataFrame) that an ingest created or updated. One writer at a time.
    """

    def __init__(self, store: TableStore, embedder: Callable[[], Embedder] = HashEmbedder, recall_cfg: RecallConfig = RecallConfig(), decay_cfg: DecayConfig = DecayConfig(), fusion_cfg: FusionConfig = FusionConfig(), key: str | None = None) -> None:
        self.store, self.embedder, self.key = store, embedder, key
        self.recall_cfg, self.decay_cfg, self.fusion_cfg = recall_cfg, decay_cfg, fusion_cfg
        self.cycle = Cycle(store, decay_cfg, fusion_cfg)
        self.listeners = self.cycle.listeners

    def insert(self, nodes: DataFrame | None = None, edges: DataFrame | None = None, anchors: DataFrame | None = None, now: datetime | None = None) -> dict[str, int]:
        """Nodes (with vectors filled in from their texts), edges and anchors into the graph, in one commit; counts of rows taken."""
        at = F.lit(now or datetime.now(timezone.utc)).cast("timestamp")
        counts: dict[str, int] = {}
        tables: dict[str, DataFrame] = {}
        known = self.store.read("nodes")
        if nodes is not None:
            rows = canonical(nodes, "nodes").withColumn("created_at", F.coalesce("created_at", at)).withColumn("last_accessed_at", F.coalesce("last_accessed_at", at))
            filled = with_embeddings(rows.withColumn("_text", F.concat_ws(" ", "label", "summary")), "_text", "embedding", self.embedder).drop("_text")
            if self.key:
                filled = filled.withColumn("summary", F.when(F.col("is_secret"), secure.encrypt(F.col("summary"), self.key)).otherwise(F.col("summary")))
            known = tables["nodes"] = cut(G.upsert_nodes(known, filled), "nodes")
            counts["nodes"] = rows.where(F.coalesce("id", F.lit("")) != "").count()
        if edges is not None:
            rows = canonical(edges, "edges").withColumn("created_at", F.coalesce("created_at", at))
            tables["edges"] = G.upsert_edges(self.store.read("edges"), rows)
            counts["edges"] = G.clean_edges(rows).count()
        if anchors is not None:
            rows = canonical(anchors, "node_anchors").withColumn("created_at", F.coalesce("created_at", at))
            tables["node_anchors"] = G.attach_anchors(self.store.read("node_anchors"), rows, known)
            counts["anchors"] = rows.count()
        if tables:
            self.store.commit(tables)
        return counts

    def _index(self) -> DataFrame | None:
        """The index of the current nodes and anchors, kept as a snapshot of its own and made again when they change."""
        tables = self.store.manifest()["tables"]
        of = f"{tables.get('nodes', 0)}-{tables.get('node_anchors', 0)}"
        if self.store.manifest()["notes"].get("index_of") != of:
            self.store.commit({"index": R.build_index(self.store.read("nodes"), self.store.read("node_anchors"), unique=True).select(R.INDEX_COLUMNS)}, {"index_of": of})
        return self.store.read("index")

    def recall_graph(self, requests: list[RecallRequest], now: datetime, record: bool = False) -> tuple[DataFrame, DataFrame]:
        """(ranked nodes, edges) of each request; a request with a text and no vector gets the embedder's. Only a
        request that includes secrets gets them in the clear. ``record`` counts the access."""
        vectors = self.embedder().embed_batch([r.resolved(self.recall_cfg).text for r in requests])
        full = [r if r.embedding or not v.any() else replace(r, embedding=tuple(map(float, v))) for r, v in zip(requests, vectors)]
        nodes = self.store.read("nodes")
        index = self._index()
        out, edges = R.recall_graph(nodes, self.store.read("edges"), self.store.read("node_anchors"), full, now, self.recall_cfg, self.key, index)
        if record:
            out = cut(out)
            self.store.write("nodes", G.record_access(nodes, out.select("id"), F.lit(now).cast("timestamp")))
        return out, edges

    def recall(self, requests: list[RecallRequest], now: datetime, record: bool = False) -> DataFrame:
        """The ranked nodes of :meth:`recall_graph`."""
        return self.recall_graph(requests, now, record)[0]

    def ingest(self, traces: DataFrame, now: datetime, synchronous: bool = True) -> dict[str, int]:
        """Traces into the queue and, if synchronous, into the graph at their own times: one commit for all of it.

        Columns ``active_goal`` and ``status`` stand in for an empty ``task_goal`` and ``outcome``.
        """
        for column, other in (("task_goal", "active_goal"), ("outcome", "status")):
            if other in traces.columns:
                base = F.col(column) if column in traces.columns else F.lit(None).cast("string")
                traces = traces.withColumn(column, F.coalesce(F.nullif(base, F.lit("")), F.col(other)))
        rows = canonical(traces, "episodic_traces").withColumn("created_at", F.coalesce("created_at", F.lit(now).cast("timestamp")))
        queued = cut(G.queue_traces(self.store.read("episodic_traces").limit(0), rows), "arrived")
        tables = {"episodic_traces": G.queue_traces(self.store.read("episodic_traces"), queued)}
        if not synchronous:
            self.store.commit(tables)
            return {"queued": queued.count()}
        fused = fuse(self.store.read("nodes"), self.store.read("edges"), extract(queued), self.fusion_cfg)
        created, updated, nodes = cut(fused.created), cut(fused.updated), cut(fused.nodes, "nodes")
        tables["episodic_traces"] = G.mark_consolidated(tables["episodic_traces"], queued, F.lit(now).cast("timestamp"))
        self.store.commit({**tables, "nodes": nodes, "edges": fused.edges, "node_anchors": G.attach_anchors(self.store.read("node_anchors"), fused.anchors, nodes)})
        for call in self.listeners:
            call(created.unionByName(updated).distinct())
        return {"queued": queued.count(), "created": created.count(), "updated": updated.count()}

    def run_cycle(self, now: datetime) -> dict[str, int]:
        return self.cycle.run(now)

    def scoped_decay(self, request: ScopedDecay, now: datetime) -> dict[str, int]:
        """Decay of a scope; counts by action and edges pruned."""
        at = F.lit(now).cast("timestamp")
        of_session = session_scope(self.store.read("episodic_traces"), request.session_id) if request.scope == "session" else None
        marked = cut(D.scoped(self.store.read("nodes"), self.store.read("node_anchors"), at, request, of_session))
        counts = {r["action"]: r["n_nodes"] for r in D.tally(marked).collect()}
        edges = self.store.read("edges")
        kept = cut(D.prune_edges(edges, marked.where("action = 'archived'").select("id"), D.SCOPED_EDGE_THRESHOLD))
        counts["edges_pruned"] = edges.count() - kept.count()
        self.store.commit({"nodes": D.apply_scoped(marked, at), "edges": kept})
        return counts

    def graph_summary(self) -> DataFrame:
        return G.graph_summary(self.store.read("nodes"), self.store.read("edges"))

    def consolidation_stats(self) -> DataFrame:
        return G.consolidation_stats(self.store.read("nodes"), self.store.read("edges"), self.store.read("episodic_traces"))

    def health(self) -> dict[str, object]:
        s = self.graph_summary().first()
        return {"status": "ok", "nodes": s["total_nodes"], "edges": s["total_edges"], "bytes": self.store.size(), "embedder": getattr(self.embedder(), "status", "local"), "cycles": self.cycle.cycles}

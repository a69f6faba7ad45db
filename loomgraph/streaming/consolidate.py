"""Consolidation as a stream: micro-batches of traces are extracted, fused, marked, and followed by decay and pruning."""

from __future__ import annotations

import math
import threading
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomgraph.config import DecayConfig, FusionConfig
from loomgraph.operators import decay, graph
from loomgraph.operators.extract import extract
from loomgraph.operators.fuse import fuse
from loomgraph.session import cut, deadline
from loomgraph.sources.store import SCHEMAS, TableStore


@dataclass
class Cycle:
    """One consolidation cycle over a store. Each cycle is one commit of all tables it changes: a crash leaves the state
    before it, and a batch that was committed changes nothing when it comes again.

    Cycles of one object run one after the other; ``timeout``: seconds after which the jobs of a cycle of ``batch_size``
    traces are cancelled. What arrives in one batch is taken whole, so more traces have as many times that.
    """

    store: TableStore
    decay_cfg: DecayConfig = field(default_factory=DecayConfig)
    fusion_cfg: FusionConfig = field(default_factory=FusionConfig)
    batch_size: int = 500
    cycles: int = 0
    timeout: float | None = 300.0
    listeners: list[Callable[[DataFrame], None]] = field(default_factory=list)
    _alone: threading.Lock = field(default_factory=threading.Lock, repr=False)

    def enqueue(self, traces: DataFrame) -> None:
        self.store.write("episodic_traces", graph.queue_traces(self.store.read("episodic_traces"), traces))

    def run(self, now: datetime, limit: int | None = None, arrived: DataFrame | None = None, batch: tuple[str, int] | None = None) -> dict[str, int]:
        """Pending traces, first come first served, into the graph; then decay at ``now``. Counts of what happened.

        ``arrived``: traces to queue in the same commit; then all pending ones are taken, whatever their number (fusion
        orders them by their times itself). ``batch``: (source, number) of a stream's batch.
        """
        with self._alone, deadline(self.store.spark, self._seconds(limit, arrived)):
            return self._run(now, limit, arrived, batch)

    def _seconds(self, limit: int | None, arrived: DataFrame | None) -> float | None:
        """The cycle's time. A batch that is cancelled comes again as large as it was, so one limit for all sizes would stop
        a stream for good."""
        if not self.timeout:
            return None
        n = limit or 0
        if arrived is not None:
            n = arrived.count() + graph.open_traces(self.store.read("episodic_traces")).count()
        return self.timeout * max(1, math.ceil(n / max(1, self.batch_size)))

    def _run(self, now: datetime, limit: int | None, arrived: DataFrame | None, batch: tuple[str, int] | None) -> dict[str, int]:
        done = self.store.manifest()["notes"].get("batches", {})
        if batch and done.get(batch[0], -1) >= batch[1]:
            return {"traces": 0, "cycles": self.cycles}
        at = F.lit(now).cast("timestamp")
        traces = self.store.read("episodic_traces")
        if arrived is not None:
            traces = cut(graph.queue_traces(traces, arrived), "traces")
        pending = cut(graph.open_traces(traces) if arrived is not None else graph.pending_traces(traces, limit or self.batch_size), "pending")
        n = pending.count()
        nodes, edges = self.store.read("nodes"), self.store.read("edges")
        changed: dict[str, DataFrame] = {}
        fused = None
        if n:
            fused = fuse(nodes, edges, extract(pending), self.fusion_cfg)
            nodes, edges = cut(fused.nodes, "nodes"), fused.edges
            changed["episodic_traces"] = graph.mark_consolidated(traces, pending, at)
            changed["node_anchors"] = graph.attach_anchors(self.store.read("node_anchors"), fused.anchors, nodes)
        decayed = cut(decay.periodic(nodes, at, self.decay_cfg), "decayed")
        changed["nodes"] = decayed
        changed["edges"] = decay.prune_edges(edges, decayed.where("is_archived").select("id"), self.decay_cfg.edge_below)
        self.store.commit(changed, {"batches": {**done, batch[0]: batch[1]}} if batch else None)
        self.cycles += 1
        if fused is not None:
            for call in self.listeners:
                call(fused.created.unionByName(fused.updated).distinct())
        return {"traces": n, "nodes": decayed.count(), "archived": decayed.where("is_archived").count(), "edges": self.store.read("edges").count(), "cycles": self.cycles}


def stream(spark: SparkSession, source: str, cycle: Cycle, checkpoint: str, now: datetime, interval: str | None = None) -> StreamingQuery:
    """New files of traces under ``source`` into the graph: once over what is there, or every ``interval``."""
    rows = spark.readStream.schema(SCHEMAS["episodic_traces"]).parquet(source)

    def batch(df: DataFrame, number: int) -> None:
        cycle.run(now, arrived=df, batch=(checkpoint, number))

    writer = rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()

"""Versioned tables: each write makes new snapshots beside the old ones, and one manifest names those that belong together.

A path that is being read is never written, and no manifest is ever changed or replaced: a commit is complete when the
manifest with the next number has its name, by one rename. So a reader sees all tables of one commit or all of the one
before, a writer that dies leaves only files that no manifest names, and the graph is never without its newest manifest.
One writer at a time is assumed; a second one fails at the rename.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMAS = {
    "nodes": "id string, entity_type string, label string, summary string, embedding array<float>, created_at timestamp, last_accessed_at timestamp, last_reinforced_at timestamp, archived_at timestamp, access_count bigint, stability_score double, importance_score double, is_archived boolean, is_secret boolean",
    "edges": "source_id string, target_id string, relation_type string, weight double, created_at timestamp, last_reinforced_at timestamp",
    "node_anchors": "node_id string, anchor_tag string, created_at timestamp",
    "episodic_traces": "id string, session_id string, task_goal string, outcome string, trace_payload string, consolidated boolean, created_at timestamp, consolidated_at timestamp",
}
DEFAULTS = {"weight": 1.0, "access_count": 0, "stability_score": 1.0, "importance_score": 0.5, "is_archived": False, "is_secret": False, "consolidated": False}


class TableStore:
    """Snapshots of the graph's tables under ``root`` (any file system that Spark's Hadoop client knows).

    ``keep``: manifests that stay readable; what only older ones name is deleted. ``fail``: for tests, called with the
    name of each step of a commit.
    """

    def __init__(self, spark: SparkSession, root: str, keep: int = 2, fail: Callable[[str], None] = lambda step: None) -> None:
        self.spark, self.root, self.keep, self.fail = spark, root.rstrip("/"), max(1, keep), fail

    def _fs(self, path: str):  # noqa: ANN202
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _names(self, folder: str) -> list[str]:
        fs, p = self._fs(folder)
        return sorted(f.getPath().getName() for f in fs.listStatus(p)) if fs.exists(p) else []

    def _numbers(self) -> list[int]:
        return sorted(int(n) for n in self._names(f"{self.root}/_manifests") if n.isdigit())

    def _manifest(self, number: int) -> dict:
        fs, p = self._fs(f"{self.root}/_manifests/{number:012d}")
        stream = fs.open(p)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def manifest(self) -> dict:
        """{"tables": {name: version}, "notes": {...}} of the newest commit; nothing before the first."""
        numbers = self._numbers()
        return self._manifest(numbers[-1]) if numbers else {"tables": {}, "notes": {}}

    def version(self, name: str) -> int:
        """Number of the table's current snapshot, 0 before the first."""
        return self.manifest()["tables"].get(name, 0)

    def read(self, name: str) -> DataFrame:
        """The current snapshot with the canonical columns; missing columns get their defaults."""
        v = self.version(name)
        if not v:
            return self.spark.createDataFrame([], SCHEMAS[name])
        rows = self.spark.read.parquet(f"{self.root}/{name}/v={v}")
        return canonical(rows, name) if name in SCHEMAS else rows

    def commit(self, tables: dict[str, DataFrame], notes: dict | None = None) -> dict[str, int]:
        """New current snapshots of the tables given, all at once; the versions. ``notes`` are kept with the commit."""
        numbers = self._numbers()
        now = self._manifest(numbers[-1]) if numbers else {"tables": {}, "notes": {}}
        versions = dict(now["tables"])
        for name, df in tables.items():
            versions[name] = versions.get(name, 0) + 1
            path = f"{self.root}/{name}/v={versions[name]}"
            fs, p = self._fs(path)
            if fs.exists(p):  # left by a writer that died before its manifest had its name
                fs.delete(p, True)
            (canonical(df, name) if name in SCHEMAS else df).write.parquet(path)
            self.fail(f"wrote {name}")
        number = numbers[-1] + 1 if numbers else 1
        fs, tmp = self._fs(f"{self.root}/_manifests/.{number:012d}.{uuid.uuid4().hex}")
        out = fs.create(tmp, True)
        out.write(json.dumps({"tables": versions, "notes": {**now["notes"], **(notes or {})}}).encode())
        out.close()
        self.fail("wrote manifest")
        if not fs.rename(tmp, self._fs(f"{self.root}/_manifests/{number:012d}")[1]):
            raise RuntimeError(f"another writer made commit {number}")
        self.fail("committed")
        self._clean([*numbers, number])
        return {name: versions[name] for name in tables}

    def size(self) -> int:
        """Bytes of the current snapshots."""
        total = 0
        for name, v in self.manifest()["tables"].items():
            fs, p = self._fs(f"{self.root}/{name}/v={v}")
            total += fs.getContentSummary(p).getLength()
        return total

    def write(self, name: str, df: DataFrame) -> int:
        """A new current snapshot of one table."""
        return self.commit({name: df})[name]

    def _clean(self, numbers: list[int]) -> None:
        """Old manifests first, then the snapshots that no manifest left names."""
        kept = [self._manifest(n)["tables"] for n in numbers[-self.keep :]]
        fs, _ = self._fs(self.root)
        for n in numbers[: -self.keep]:
            fs.delete(self._fs(f"{self.root}/_manifests/{n:012d}")[1], False)
        for name in {t for k in kept for t in k}:
            live = {f"v={k[name]}" for k in kept if name in k}
            for folder in self._names(f"{self.root}/{name}"):
                if folder.startswith("v=") and folder not in live:
                    fs.delete(self._fs(f"{self.root}/{name}/{folder}")[1], True)


def canonical(df: DataFrame, name: str) -> DataFrame:
    columns = []
    for field in SCHEMAS[name].split(", "):
        c, kind = field.split(" ", 1)
        value = F.col(c).cast(kind) if c in df.columns else F.lit(None).cast(kind)
        columns.append((F.coalesce(value, F.lit(DEFAULTS[c]).cast(kind)) if c in DEFAULTS else value).alias(c))
    return df.select(*columns)


def unpack_vectors(column):  # noqa: ANN001, ANN201
    """Little-endian float32 blobs to arrays; null for a length that isn't a multiple of four."""
    @F.pandas_udf("array<float>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda b: None if b is None or len(b) % 4 else np.frombuffer(b, "<f4"))

    return run(column)


def pack_vectors(column):  # noqa: ANN001, ANN201
    """Arrays to little-endian float32 blobs."""
    @F.pandas_udf("binary")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())

    return run(column)


def import_rows(df: DataFrame, name: str) -> DataFrame:
    """Rows from elsewhere, all columns as text or typed, to the table's types: what can't be read as its type is null,
    then the column's default; vectors may be little-endian float32 blobs."""
    kinds = dict(df.dtypes)
    columns = []
    for field in SCHEMAS[name].split(", "):
        c, kind = field.split(" ", 1)
        if c not in kinds:
            continue
        if kind == "array<float>" and kinds[c] == "binary":
            columns.append(unpack_vectors(F.col(c)).alias(c))
        elif kinds[c] == "string" and kind == "boolean":
            columns.append(F.coalesce(F.expr(f"try_cast(`{c}` as boolean)"), F.expr(f"try_cast(`{c}` as double)") != 0).alias(c))
        elif kinds[c] == "string" and kind not in ("string", "array<float>"):
            columns.append(F.expr(f"try_cast(trim(`{c}`) as {kind})").alias(c))
        else:
            columns.append(F.col(c))
    return canonical(df.select(*columns), name)

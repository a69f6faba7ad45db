"""Intermediate tables in the shared checkpoint folder."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from loomgraph.session import checkpoint_dir

_WRITTEN: list[tuple[SparkSession, str]] = []
_NAMED: list[tuple[SparkSession, str]] = []


@contextmanager
def shuffles(spark: SparkSession, rows: int, per_task: int = 400_000) -> Iterator[None]:
    """Within it, shuffles have at least a partition for each ``per_task`` of ``rows``, so tasks don't grow with the data."""
    name = "spark.sql.shuffle.partitions"
    before = int(spark.conf.get(name))
    spark.conf.set(name, str(max(before, -(-rows // per_task))))
    try:
        yield
    finally:
        spark.conf.set(name, str(before))


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet beside the checkpoints and read it again: computed once, safe against lost executors."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/stage-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def stage_by(df: DataFrame, name: str, key: str) -> DataFrame:
    """As :func:`stage`, with the rows bucketed by ``key``: later joins on it need no shuffle of them.

    ``df`` should be grouped by ``key`` already, so that each task writes its own buckets only.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    label = f"stage_{name.replace('-', '_')}_{uuid.uuid4().hex}"
    path = f"{checkpoint_dir(spark).rstrip('/')}/{label}"
    df.write.bucketBy(n, key).sortBy(key).option("path", path).saveAsTable(label)
    _WRITTEN.append((spark, path))
    _NAMED.append((spark, label))
    return spark.table(label)


@atexit.register
def _clean() -> None:
    for spark, label in _NAMED:
        try:
            spark.sql(f"DROP TABLE IF EXISTS {label}")
        except Exception:  # the session may be gone
            break
    for spark, path in _WRITTEN:
        try:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session may be gone
            return

"""Session helpers: sane defaults, checkpoint folder, column naming."""

from __future__ import annotations

import atexit
import hashlib
import os
import shutil
import tempfile
import threading
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.chunkBase64String.enabled": "false",
    "spark.ui.enabled": "false",
}


def build_session(app: str = "loomgraph", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the engine's defaults; keyword names use ``_`` for ``.``-free overrides via ``conf``."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in {**DEFAULTS, **conf}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session.

    The cluster's ``spark.checkpoint.dir`` is used as it is. Only where it is unset (tests on one machine) a
    temporary folder is made; on a real cluster an unset folder is an error, since executors share no local disk.
    """
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        configured = "file://" + tempfile.mkdtemp(prefix="loomgraph-checkpoint-")
    sc.setCheckpointDir(configured)
    return configured


_WRITTEN: list[tuple[SparkSession, str]] = []


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write ``df`` as Parquet to the shared checkpoint folder and go on from there: computed once, no lineage, safe
    against lost executors; later steps read only the columns that they need, and their plans know its size."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _clean() -> None:
    for spark, path in _WRITTEN:
        try:
            remove(spark, path)
        except Exception:  # the session may be gone
            return


@contextmanager
def deadline(spark: SparkSession, seconds: float | None) -> Iterator[None]:
    """Cancels the Spark jobs that this thread starts within it once ``seconds`` are over (None: never)."""
    if not seconds:
        yield
        return
    sc, group = spark.sparkContext, f"deadline-{uuid.uuid4().hex}"
    timer = threading.Timer(seconds, sc.cancelJobGroup, (group,))
    timer.daemon = True
    before = {key: sc.getLocalProperty(key) for key in ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel")}
    sc.setJobGroup(group, f"at most {seconds} s", interruptOnCancel=True)
    timer.start()
    try:
        yield
    finally:
        timer.cancel()
        for key, value in before.items():  # a stream has a group of its own
            sc.setLocalProperty(key, value)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not use (compared without case)."""
    taken = {c.lower() for c in df.columns}
    name = stem
    while name.lower() in taken:
        name += "_"
    return name


def ship(spark: SparkSession) -> None:
    """Send the package to the executors' Python workers, once per session: they need not find it on their own path."""
    sc = spark.sparkContext
    if getattr(sc, "_loomgraph_shipped", False):
        return
    root = Path(__file__).resolve().parent
    files = sorted(root.rglob("*.py"))
    stamp = hashlib.sha256(b"".join(p.read_bytes() for p in files)).hexdigest()[:12]
    folder = tempfile.mkdtemp(prefix="loomgraph-package-")  # on the driver, which serves the file to the executors
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, f"loomgraph-{stamp}.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for p in files:
            z.write(p, str(p.relative_to(root.parent)))
    sc.addPyFile(path)
    sc._loomgraph_shipped = True


def spread(scan: DataFrame) -> DataFrame:
    """A plain table scan cut into at least as many partitions as there are cores, for work that costs far more than
    moving its input. Tables of many splits, that is all large ones, are left as they are."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores)

"""Session settings and the shared folder used for checkpoints and scratch tables."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def build_session(app_name: str = "plumbline", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the jobs rely on.

    Shuffle width, memory and file split size stay with the cluster unless the
    caller passes them: adaptive execution coalesces small partitions and splits
    skewed ones, so no fixed partition count is baked into any job.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the workers once, unless they find it by themselves (installed, on PYTHONPATH, or in the working directory)."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    found = [os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    context = spark.sparkContext
    if root in found or os.path.abspath(os.getcwd()) == root or "site-packages" in root or context.applicationId in _shipped:
        return
    archive = os.path.join(tempfile.mkdtemp(prefix="plumbline-"), "plumbline.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(os.path.join(root, "plumbline")):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, root))
    context.addPyFile(archive)  # Spark copies it to every executor
    _shipped.add(context.applicationId)


_local_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by the cluster in ``spark.checkpoint.dir``.

    A session of one process that does not set it (a local test) gets a temporary
    folder; on a cluster parts written to one machine's disk would be lost, so there it is an error.
    """
    global _local_dir
    folder = spark.conf.get(CHECKPOINT_KEY, None)
    if not folder:
        master = spark.conf.get("spark.master", "")
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise ValueError(f"{CHECKPOINT_KEY} must name a folder that all executors of {master} share")
        _local_dir = _local_dir or tempfile.mkdtemp(prefix="plumbline-")
        folder = _local_dir
    return folder.rstrip("/")


def _file_status(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    return files.getFileStatus(target) if files.exists(target) else None


def path_exists(spark: SparkSession, path: str) -> bool:
    return _file_status(spark, path) is not None


def is_folder(spark: SparkSession, path: str) -> bool:
    status = _file_status(spark, path)
    return status is not None and status.isDirectory()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh, never reused path below the shared folder."""
    return f"{shared_dir(spark)}/plumbline/{label}-{uuid.uuid4().hex}"


#: Spark's switch for dropping a query's shuffle files when it ends, rather than when the driver's memory is next cleaned.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Queries that end within it leave no shuffle files behind."""
    before = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEAN, before)


#: Spark's bound for the rows that a Python worker gets at a time, and the bytes that jobs which are stored set for it.
_BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Queries that run within it hand their Python workers about BATCH_BYTES of rows at a time, unless the session has a bound of its own.

    Spark's default of 64 MB is held by the executor's JVM and by the worker, for each task that runs.
    """
    if _BATCH in spark.conf.getAll:
        yield
        return
    spark.conf.set(_BATCH, f"{BATCH_BYTES}b")
    try:
        yield
    finally:
        spark.conf.unset(_BATCH)


def stored(df: DataFrame, label: str, by: Sequence[str] = ()) -> DataFrame:
    """The frame written to the shared folder and read back, with a folder for each value of the columns ``by``.

    For results that several jobs read: it is computed once, its real size is
    known to the planner, and a lost executor costs a re-read and no recompute.
    """
    path = scratch_path(df.sparkSession, label)
    with small_batches(df.sparkSession):
        df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path) if by else df.sparkSession.read.parquet(path)


def replaced(df: DataFrame, label: str, by: Sequence[str], instead_of: DataFrame) -> DataFrame:
    """:func:`stored`, and the files of the stored frame ``instead_of``, which nothing reads any more, are deleted."""
    new = stored(df, label, by)
    for file in instead_of.inputFiles():
        target = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.sparkSession._jvm.java.net.URI(file))
        target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(target, False)
    return new

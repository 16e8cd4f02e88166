"""Session construction and the shared folder used to cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "fieldproof", master: str | None = None, **conf) -> SparkSession:
    """Session with adaptive execution on; ``master`` is left to spark-submit unless given."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: the session's ``spark.checkpoint.dir``.

    A temporary folder is used only where the setting is absent and Spark runs
    in local mode; on a cluster the setting is required.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    existing = spark.sparkContext.getCheckpointDir()
    if existing:
        return os.path.dirname(existing.rstrip("/"))
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    local = tempfile.mkdtemp(prefix="spark-", dir="/tmp" if os.path.isdir("/tmp") else None)
    spark.sparkContext.setCheckpointDir(local)
    return local


#: Scratch paths given out since ``dropped_steps`` was entered, by thread.
_steps: ContextVar[list[str] | None] = ContextVar("_steps", default=None)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, unique per call."""
    path = f"{shared_dir(spark).rstrip('/')}/fieldproof/{name}-{uuid.uuid4().hex[:12]}"
    if _steps.get() is not None:
        _steps.get().append(path)
    return path


@contextmanager
def dropped_steps(spark: SparkSession) -> Iterator[None]:
    """Scratch tables that are written within are deleted at the end; what is kept must be written elsewhere by then."""
    outer = _steps.set([])
    try:
        yield
    finally:
        paths = _steps.get()
        _steps.reset(outer)
        for path in map(spark._jvm.org.apache.hadoop.fs.Path, paths):
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def released_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs within go when it ends, not when the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


@contextmanager
def measured_broadcasts(spark: SparkSession) -> Iterator[None]:
    """Within, a join is broadcast by the size measured while it runs, never by an estimate.

    Estimates follow the compressed files and know nothing of what an explode
    adds, so the driver could collect a table far above the session's threshold.
    """
    planned, adaptive = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    before = {key: spark.conf.get(key, None) for key in (planned, adaptive)}
    spark.conf.set(adaptive, before[adaptive] or spark.conf.get(planned))
    spark.conf.set(planned, "-1")
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` below the shared folder and read it back.

    A lost executor then costs one re-read instead of the steps before, and
    the file sizes let Spark decide about broadcasts from what was measured.
    """
    path = scratch_path(df.sparkSession, "step")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

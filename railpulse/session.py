"""Spark session defaults used by the jobs, tests and the bench."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import SparkSession

#: The folder of the job that is running (``scratch_job``), if any.
_JOB: ContextVar[str | None] = ContextVar("scratch_job", default=None)

# Settings every job relies on.  Cluster deployments pass their own
# shuffle-partition count and memory; these only fill what is unset.
_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

# Only for sessions this module starts itself (local tests / bench).
_LOCAL_DEFAULTS = {
    "spark.driver.memory": "8g",
}


def get_spark(
    app: str = "railpulse",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    extra: dict[str, str] | None = None,
) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(_DEFAULTS)
    if master and master.startswith("local"):
        conf.update(_LOCAL_DEFAULTS)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the setting points at shared storage and is used as is.
    Only when it is unset and the master is local (tests), a fresh scratch
    folder is created and registered; elsewhere executors would each write to
    a disk of their own, so an unset folder is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.match(r"local(\[[^]]*\])?$", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="railpulse-ckpt-")
        spark.conf.set("spark.checkpoint.dir", path)
    own = spark.sparkContext.getCheckpointDir()
    if not own or os.path.dirname(own.rstrip("/")).rpartition(":")[2] != path.rstrip("/").rpartition(":")[2]:
        spark.sparkContext.setCheckpointDir(path)  # makes a folder in it at every call
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A sub-folder of the shared checkpoint folder for written tables."""
    return os.path.join(checkpoint_dir(spark), name)


def delete_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder wherever it lies."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def scratch_job(spark: SparkSession, name: str = "job") -> Iterator[str]:
    """All that ``materialize`` writes inside goes to one folder, deleted at the end.

    For jobs that write their result before they end, such as a micro-batch: a DataFrame that
    reads an intermediate table must not outlive the job.  Jobs may nest.
    """
    path = scratch_path(spark, f"{name}-{uuid.uuid4().hex}")
    token = _JOB.set(path)
    try:
        yield path
    finally:
        _JOB.reset(token)
        delete_folder(spark, path)


@contextmanager
def drop_shuffles(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of what is written or collected inside go when that has ended.

    Else they stay until the driver happens to collect its garbage, and those of one step lie beside the next one's.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def materialize(df, name: str):
    """Write ``df`` as Parquet under the shared checkpoint folder and read it back.

    Used where a derived table is consumed by many joins (dimensions, the
    resolved-name lookup): the plan below becomes a plain scan with real
    size statistics (AQE sizes its broadcast decisions on them), and a lost
    executor re-reads files instead of recomputing the lineage.  Each call
    writes a fresh folder; it stays for as long as the DataFrame may be read, or until the
    ``scratch_job`` around it ends.
    """
    spark = df.sparkSession
    path = os.path.join(_JOB.get() or checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex}")
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)

"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_lock = threading.Lock()
#: Folders of local sessions (tests) whose ``spark.checkpoint.dir`` is not set, by application.
_local: dict[str, str] = {}
#: How many ``stage`` calls are writing, and the setting before the first of them.
_writers: list = [0, None]


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of a few MB, as ``text_slices`` cuts them, unless the session has a bound of its own: the JVM
    fills a whole batch before a worker sees its first row."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, "8m")


def shared_dir(spark: SparkSession) -> str:
    """A new folder name under ``spark.checkpoint.dir``; a local one only where that is unset and the master is local (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        with _lock:
            root = _local.setdefault(spark.sparkContext.applicationId, "") or "file://" + tempfile.mkdtemp(prefix="cuespark-")
            _local[spark.sparkContext.applicationId] = root
    return f"{root.rstrip('/')}/cuespark-{uuid.uuid4().hex}"


def spread(files: DataFrame, key: str) -> DataFrame:
    """Rows of files, dealt by ``key`` where the files have fewer parts than there are cores; else as they are."""
    cores = files.sparkSession.sparkContext.defaultParallelism
    return files.repartition(2 * cores, key) if files.rdd.getNumPartitions() < cores else files


def stage(df: DataFrame, **options: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lost executors cost one read, not a recomputation.

    The shuffles that made it are not needed any more; Spark is asked to remove their files.  That setting is read
    when a write begins, so writes that begin in other threads meanwhile see it too; it costs them nothing but
    shuffle files that they are done with.  The table stays until ``discard`` or until the folder is cleaned.
    """
    spark = df.sparkSession
    path = shared_dir(spark)
    with _lock:  # the setting is put back by the last of several writers
        _writers[0] += 1
        if _writers[0] == 1:
            _writers[1] = spark.conf.get(_CLEANUP)
            spark.conf.set(_CLEANUP, "true")
    try:
        df.write.options(**options).parquet(path)
    finally:
        with _lock:
            _writers[0] -= 1
            if not _writers[0]:
                spark.conf.set(_CLEANUP, _writers[1])
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def exists(spark: SparkSession, path: str) -> bool:
    file = spark._jvm.org.apache.hadoop.fs.Path(path)
    return file.getFileSystem(spark._jsc.hadoopConfiguration()).exists(file)


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``stage`` wrote and that nothing reads any more."""
    for table in tables:
        file = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table.staged_at)
        file.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(file, True)


def delete_files(spark: SparkSession, paths: list[str]) -> int:
    """Delete files by name; how many of them were there."""
    gone = 0
    for path in paths:
        file = spark._jvm.org.apache.hadoop.fs.Path(path)
        gone += bool(file.getFileSystem(spark._jsc.hadoopConfiguration()).delete(file, False))
    return gone

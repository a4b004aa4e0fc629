"""Shared plumbing of the training-data operators.

* ``tidy``        - lets go of a worker's memory after each task.
* ``text_slices`` - Arrow batches cut by bytes, so a worker's memory does not depend on row sizes.
* ``stage``, ``discard``, ``shared_dir`` - intermediate tables in the cluster's ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuespark.sources import tables
from cuespark.sources.tables import discard, shared_dir, small_batches  # noqa: F401

#: ASCII white space as the contracts spell it; ``bytes.split()`` and ``bytes.strip()`` use the same six.
ASCII_SPACE = r"[\x20\x09-\x0D]"


def stage(df: DataFrame) -> DataFrame:
    """``tables.stage`` with small Arrow batches."""
    small_batches(df.sparkSession)
    return tables.stage(df)


def tidy(function):
    """``function`` over batches; a worker that has done a task keeps none of the memory it took."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from function(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # C libraries other than glibc
            ctypes.CDLL(None).malloc_trim(0)

    return run


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def docs_of(docs: DataFrame) -> DataFrame:
    """Only ``doc_id`` and ``text``; every other column, whatever its name, is pruned at the scan."""
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def text_key(text: Column) -> Column:
    """128 bits of the text; null for null."""
    return F.md5(text.cast("binary"))


def with_key(docs: DataFrame) -> DataFrame:
    """``text_key``: with the id, what tells rows apart; rows equal in both have equal results."""
    return docs.withColumn("text_key", text_key(F.col("text")))


def text_slices(batches: Iterator[pa.RecordBatch], max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each slice's ``text`` holds about ``max_bytes`` (one longer text stands alone)."""
    import numpy as np

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sizes = pc.binary_length(batch.column("text")).fill_null(0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        at = 0
        while at < n:
            before = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, before + max_bytes, side="right")))
            yield batch.slice(at, stop - at)
            at = stop


def raw_texts(column: pa.Array) -> list[bytes]:
    """The texts as UTF-8 bytes, null as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def input_bytes(docs: DataFrame) -> int:
    """About how many bytes ``docs`` has, to size partitions: what the planner knows of its files, or else a scan
    that reads the lengths of the texts."""
    planned = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return planned if planned < 1 << 60 else int(docs.agg(F.sum(F.octet_length("text"))).head()[0] or 0)


def parts_for(total: int, per_part: int, least: int) -> int:
    return max(least, -(-total // per_part))

"""Status documents as a table: keyed JSON objects that many writers update.

The table is a log of immutable updates ``key, update, replace, at, writer, seq``; the state of a key is all its updates
merged in the order of their version (at, writer, seq).  Objects merge key by key, anything else replaces what was
there, null too; an update that replaces drops what came before it.  Writers only append, so two of them never lose an
update, and a job that fails adds none.  ``compact`` writes each key's state as one replacing update of the same version
and then removes the files it has read: what is appended meanwhile stays, and reading both gives the same state.
"""

from __future__ import annotations

import json
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from cuespark.sources.tables import delete_files, exists
from cuespark.sources.writers import deep_merge

LOG = "key string, update string, replace boolean, at timestamp, writer string, seq long"


def append(updates: DataFrame, path: str) -> None:
    """Add ``updates(key, update)``, objects as JSON; with ``replace`` where a row is to drop what its key had, and with
    ``seq`` where one key has several (else any order of these)."""
    replace = F.coalesce(F.col("replace").cast("boolean"), F.lit(False)) if "replace" in updates.columns else F.lit(False)
    seq = F.col("seq").cast("long") if "seq" in updates.columns else F.monotonically_increasing_id()
    rows = updates.select(F.col("key").cast("string").alias("key"), "update", replace.alias("replace"), F.current_timestamp().alias("at"), F.lit(uuid.uuid4().hex).alias("writer"), seq.alias("seq"))
    _write(rows, path)


def _write(rows: DataFrame, path: str) -> None:
    rows.write.parquet(f"{path}/batch={uuid.uuid4().hex}")


def log_of(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{LOG}, batch string").parquet(path).drop("batch") if exists(spark, path) else spark.createDataFrame([], LOG)


def _merge(updates: pa.Array) -> pa.Array:
    """Each row's objects merged from the first to the last."""
    stops, texts, out = updates.offsets.to_pylist(), updates.flatten().to_pylist(), []
    for a, b in zip(stops, stops[1:], strict=False):
        state: dict = {}
        for text in texts[a - stops[0] : b - stops[0]]:
            value = json.loads(text) if text else {}
            if not isinstance(value, dict):
                raise TypeError(f"an update is a JSON object, not {type(value).__name__}")
            state = deep_merge(state, value)
        out.append(json.dumps(state, ensure_ascii=False))
    return pa.array(out, pa.string())


def current(log: DataFrame) -> DataFrame:
    """``key, status`` (JSON), the version ``at, writer, seq`` of the last update, and how many there are since the last one
    that replaced."""
    version = F.struct("at", "writer", "seq").alias("v")
    cut = log.where("replace").groupBy("key").agg(F.max(version).alias("since")).select(F.struct("key").alias("k"), "since")
    rows = log.select(F.struct("key").alias("k"), version, "update").join(cut, "k", "left")  # a null key is a key
    kept = rows.where(F.col("since").isNull() | (F.col("v") >= F.col("since")))
    listed = kept.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("v", "update"))).alias("u"))
    merged = F.arrow_udf(_merge, StringType())(F.transform("u", lambda u: u["update"]))
    last = F.element_at("u", -1)["v"]
    return listed.select("k.key", merged.alias("status"), last["at"].alias("at"), last["writer"].alias("writer"), last["seq"].alias("seq"), F.size("u").alias("n_updates"))


def compact(spark: SparkSession, path: str) -> int:
    """One row a key; the number of files that are gone."""
    if not exists(spark, path):
        return 0
    read = log_of(spark, path).inputFiles()
    if not read:
        return 0
    state = current(spark.read.schema(LOG).parquet(*read))
    _write(state.select("key", F.col("status").alias("update"), F.lit(True).alias("replace"), "at", "writer", "seq"), path)
    return delete_files(spark, read)

"""Result caches as tables: keys, probes, time to live, compaction.

A cache is a Parquet table ``cache_key, value, created_at, expires_at`` in folders by write and by ``bucket``, the first
digits of the key's hash.  A probe splits requests into hits (joined with the newest live value) and misses (anti join); only misses
reach a completer (see ``completion.remembered``).  ``entries_for`` reads only the buckets that requests fall in, so a
probe of few keys reads few files of a large cache; inside a file rows are sorted by key, so pages have narrow key
ranges.  ``compact`` leaves one file a bucket with the newest live entry of
each key: it writes new files first and then removes those it has read, so a reader sees entries twice at worst, and
what is appended meanwhile stays.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuespark.sources.tables import delete_files, exists

ENTRY = "cache_key string, value string, created_at timestamp, expires_at timestamp"
_STORED = f"{ENTRY}, run string, bucket string"
#: Hexadecimal digits of a bucket: 256 buckets.
DIGITS = 2

# Seconds a result lives.
COMPLETION_TTL, TRANSLATION_TTL = 3_600_000, 604_800


def cache_key(*parts: Column) -> Column:
    """SHA-256 of the parts as a JSON object with fixed names; nulls are part of the key."""
    fields = F.struct(*[F.coalesce(p.cast("string"), F.lit("\0")).alias(f"p{i}") for i, p in enumerate(parts)])
    return F.sha2(F.to_json(fields), 256)


def chunk_key(kind: str, chunk: Column, language: str, model: str | None = None, prompt: str | None = None) -> Column:
    """``kind:hash:language`` and, with a model, ``:model:prompt hash``."""
    parts = [F.lit(kind), F.sha2(F.to_json(chunk), 256), F.lit(language)]
    if model is not None:
        parts += [F.lit(model), F.sha2(F.lit(prompt or ""), 256)]
    return F.concat_ws(":", *parts)


def bucket(key: Column) -> Column:
    return F.substring(F.md5(key.cast("binary")), 1, DIGITS)


def live(cache: DataFrame, now: Column) -> DataFrame:
    """The newest entry of each key that has not expired."""
    newest = F.max_by(F.struct("value", "created_at", "expires_at"), F.struct("created_at", "expires_at", "value"))
    return cache.where(F.col("expires_at") > now).groupBy("cache_key").agg(newest.alias("e")).select("cache_key", "e.value", "e.created_at", "e.expires_at")


def hits(requests: DataFrame, cache: DataFrame, now: Column) -> DataFrame:
    return requests.join(live(cache, now).select("cache_key", "value"), "cache_key")


def misses(requests: DataFrame, cache: DataFrame, now: Column) -> DataFrame:
    return requests.join(cache.where(F.col("expires_at") > now).select("cache_key"), "cache_key", "left_anti")


def entries(results: DataFrame, now: Column, ttl_seconds: int) -> DataFrame:
    """``results(cache_key, value)`` as rows to append."""
    return results.select("cache_key", "value", now.alias("created_at"), (now + F.make_interval(secs=F.lit(ttl_seconds))).alias("expires_at"))


def entries_of(spark: SparkSession, path: str) -> DataFrame | None:
    """The cache table at ``path``; None if nothing was ever added to it."""
    return spark.read.schema(_STORED).parquet(path) if exists(spark, path) else None


def entries_for(requests: DataFrame, path: str) -> DataFrame | None:
    """The entries that ``requests(cache_key)`` may hit, from the folders of their buckets alone."""
    stored = entries_of(requests.sparkSession, path)
    if stored is None:
        return None
    wanted = [r[0] for r in requests.select(bucket(F.col("cache_key"))).distinct().collect()]  # 16**DIGITS at most
    return stored.where(F.col("bucket").isin(wanted)).drop("run", "bucket")


def add(rows: DataFrame, path: str) -> None:
    """Add ``ENTRY`` rows, sorted by key in the files of their buckets, in a folder of their own (``run``): two jobs that
    commit to one folder would remove each other's files."""
    placed = rows.select("cache_key", "value", "created_at", "expires_at", bucket(F.col("cache_key")).alias("bucket"))
    spread = placed.repartition("bucket").sortWithinPartitions("bucket", "cache_key")
    spread.write.partitionBy("bucket").parquet(f"{path}/run={uuid.uuid4().hex}")


def append(results: DataFrame, path: str, ttl_seconds: int) -> None:
    add(entries(results, F.current_timestamp(), ttl_seconds), path)


def compact(spark: SparkSession, path: str, now: Column | None = None) -> int:
    """Rewrite the cache without expired and outdated entries; the number of files that are gone."""
    stored = entries_of(spark, path)
    if stored is None:
        return 0
    read = stored.inputFiles()
    snapshot = spark.read.schema(_STORED).option("basePath", path).parquet(*read) if read else stored
    add(live(snapshot, F.current_timestamp() if now is None else now), path)
    return delete_files(spark, read)

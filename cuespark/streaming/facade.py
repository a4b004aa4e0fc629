"""Streaming: new recordings in a landing folder go through the batch operators.

Each micro-batch of files is handled by ``foreachBatch`` with the same plans as a batch run; results are
appended under the batch's number, so a batch that runs again replaces its own output only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from cuespark.operators import sentences as S
from cuespark.sources import readers


def landing(spark: SparkSession, path: str) -> DataFrame:
    """A stream of whole text files: ``doc_id, content`` and, where one cannot be decoded, a ``fault``."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").load(path)
    return readers.texts_of(files)


def sentences_of(batch: DataFrame) -> DataFrame:
    return S.sentences(readers.parse_word_json(batch))


def run(stream: DataFrame, work: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Process what is there, then stop; later calls take only new files."""

    def write(batch: DataFrame, number: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

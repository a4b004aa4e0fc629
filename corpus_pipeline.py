"""The corpus pipeline: quality rules, line dedup, near dedup, source mixing, tokenising.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows its predecessor kept; all but the last
return the columns of ``documents``.  ``run`` applies them to ``documents``, writing the rows between
stages to the shared folder; a stage's rows are deleted once the next one's are written.

Defined results: null and empty texts fail the quality rules; a later stage that is given them keeps
them (line dedup), takes them for copies of each other (near dedup), takes nothing of them (mixing) or encodes
them as no tokens.  Null and repeated ids, repeated rows and further columns, whatever their names, pass through
every stage as rows of their own, but near dedup keeps one of equal rows.  Of ties the smallest id stays.  An empty
table gives an empty table with the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cuespark.llm import bpe, line_dedup, mixing, quality, simhash, similar
from cuespark.llm.common import discard, documents, stage
from cuespark.llm.queries import vocabulary


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the trees."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep(docs, quality.train(docs, labels))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that ten or more of them share."""
    return line_dedup.drop_frequent_lines(docs, whole=True)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of exact or near copies: texts with SimHash fingerprints at two bits or fewer are
    linked, and those with similar sets of shingles that fingerprints miss."""
    return similar.keep_one(docs, linked=simhash.text_links)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it (0 to 3 times)."""
    return mixing.emit(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every emitted document."""
    return bpe.round_trip(docs, vocabulary())


STAGES = [("quality rules", quality_rules), ("line dedup", drop_lines), ("near dedup", near_dedup), ("source mixing", mix_sources), ("BPE encoding", encode)]

#: Boosted trees, SimHash and byte-pair merges have no SQL form; ``tests/llm`` compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, written = documents(spark, sf_dir), []
    for _, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir))
        discard(*written)
        written = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)

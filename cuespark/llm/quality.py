"""Quality rules: base rules on document statistics, then gradient-boosted trees over them.

The trees are fitted on at most ``max_train`` labelled documents (those with the smallest hash of their
id; the bound is a parameter), sent to the executors as flat arrays, and score every document that
passes the base rules.  Three features are constrained: more symbols, duplicate lines or repeated words
never raise a document's score.

Defined results: null text is an empty text (base_failed); labels with null quality or null ids, and
labels of unknown documents, are not used; without usable labels the base rules alone decide; several
labels or rows of one id each count; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuespark.llm import boosted
from cuespark.llm.common import docs_of, raw_texts, text_slices, tidy
from cuespark.llm.text_stats import FIELDS, statistics

MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20
FEATURES = ["log_words", "mean_word", "symbols", "dup_lines", "repeats", "upper", "digits", "punct", "beyond_ascii", "ended", "distinct"]
MONOTONE = np.array([0, 0, -1, -1, -1, 0, 0, 0, 0, 0, 0])
OUT = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, score double"


def features(stats: np.ndarray) -> np.ndarray:
    """``FEATURES`` of rows of ``FIELDS``."""
    s = {name: stats[:, i].astype(np.float64) for i, name in enumerate(FIELDS)}
    words, chars, lines = np.maximum(s["n_words"], 1), np.maximum(s["n_chars"], 1), np.maximum(s["n_lines"], 1)
    columns = [np.log1p(s["n_words"]), s["word_chars"] / words, s["n_symbols"] / words, s["n_dup_lines"] / lines, s["n_repeat_words"] / words, s["n_upper"] / chars]
    columns += [s["n_digits"] / chars, s["n_punct"] / chars, (s["n_bytes"] - s["n_chars"]) / chars, s["n_ended"] / lines, s["n_distinct"] / words]
    return np.column_stack(columns)


def base_failed(stats: np.ndarray) -> np.ndarray:
    words, repeats = stats[:, FIELDS.index("n_words")], stats[:, FIELDS.index("n_repeat_words")]
    return (words < MIN_WORDS) | (100 * repeats > MAX_REPEAT_PERCENT * words)


def _stats_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_slices(batches):
        stats = statistics(raw_texts(batch.column("text")))
        yield pa.RecordBatch.from_arrays([batch.column("quality"), *map(pa.array, stats.T.copy())], ["quality", *FIELDS])


def train(docs: DataFrame, labels: DataFrame, max_train: int = 20_000) -> boosted.Trees:
    """Trees for P(quality = 1) from a bounded sample of the labelled documents."""
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("long").alias("quality")).dropna()
    sample = usable.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(max_train)
    # the sample has at most max_train rows of two numbers, so its size is bounded whatever the tables hold
    joined = docs_of(docs).join(F.broadcast(sample), "doc_id").select("text", "quality")
    schema = ", ".join(f"{c} long" for c in ["quality", *FIELDS])
    rows = joined.mapInArrow(tidy(_stats_of), schema).orderBy(F.xxhash64(*FIELDS), *FIELDS, "quality").limit(max_train).toArrow()
    stats = np.column_stack([rows.column(c).to_numpy() for c in FIELDS]) if rows.num_rows else np.zeros((0, len(FIELDS)), np.int64)
    usable_rows = ~base_failed(stats)
    y = np.asarray(rows.column("quality").to_numpy(), np.float64)
    return boosted.fit(features(stats)[usable_rows], (y[usable_rows] > 0).astype(np.float64), MONOTONE)


def _score(sent, threshold: float, extra: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: boosted.Trees = sent.value
        for batch in text_slices(batches):
            stats = statistics(raw_texts(batch.column("text")))
            failed = base_failed(stats)
            score = model.probability(features(stats))
            kept = ~failed & (score >= threshold)
            if extra:  # the rows that are kept, all their columns
                yield batch.filter(pa.array(kept))
                continue
            columns = [pa.array(stats[:, FIELDS.index(c)]) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
            names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score"]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns, pa.array(failed), pa.array(kept), pa.array(score)], names)

    return run


def judge(docs: DataFrame, model: boosted.Trees, threshold: float = 0.5) -> DataFrame:
    """The statistics and verdict of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return docs_of(docs).mapInArrow(tidy(_score(sent, threshold, False)), OUT)


def keep(docs: DataFrame, model: boosted.Trees, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(tidy(_score(sent, threshold, True)), docs.schema)

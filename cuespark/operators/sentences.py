"""Word streams: ordering, sentence grouping, batching, line numbering.

All operators take and give DataFrames keyed by ``doc_id``; every window is partitioned by it, so one
shuffle on ``doc_id`` serves a whole chain.  Where single recordings are too long for a task, ``chunk`` (words or
sentences) or ``chunk_ms`` spreads them (``prefix``); the rows are the same.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, IntegerType, LongType, StringType, StructField, StructType

from cuespark.functions import text as T
from cuespark.operators import prefix

SEGMENT = "struct<text:string,start_ms:bigint,end_ms:bigint>"


def _part(column: str, size: int | None) -> Column | None:
    return F.floor(F.col(column) / size) if size else None


def order_segments(segments: DataFrame, src_ord: str = "ord", chunk_ms: int | None = None) -> DataFrame:
    """Drop blank segments and number the rest by (start, end, source order) from 0 in ``ord``."""
    kept = segments.where(T.not_blank(F.col("text")))
    name = prefix.unused("place", kept)
    numbered = prefix.number(kept, name, ["start_ms", "end_ms", src_ord], _part("start_ms", chunk_ms))
    return numbered.withColumn("ord", F.col(name).cast("int")).drop(name)


def sentence_ids(words: DataFrame, chunk: int | None = None) -> DataFrame:
    """``sentence_index``: the number of sentence ends before each word."""
    ended = prefix.sum_before(words, "sentence_index", T.ends_sentence(F.col("text")).cast("int"), ["ord"], _part("ord", chunk))
    return ended.withColumn("sentence_index", F.col("sentence_index").cast("int"))


def ordered(column: Column, by: str = "ord") -> Column:
    """``column`` of a group as an array in the order of ``by``."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(by).alias("o"), column.alias("v"))))
    return F.transform(rows, lambda r: r["v"])


def joined(segments: Column) -> Column:
    """The segments' texts without white space at their ends, joined by spaces.

    Where joining leaves no white space at an end and none twice in a row, no text had any at its ends."""
    plain = F.array_join(segments["text"], " ")  # a field of all structs at once; a lambda would copy each text
    loose = rf"{T.SPACE}(?:{T.SPACE}|\z)|^{T.SPACE}"
    stripped = F.array_join(F.transform(segments, lambda s: T.strip(s["text"])), " ")
    return F.transform(F.array(plain), lambda t: F.when(t.rlike(loose), stripped).otherwise(t))[0]  # joined once


def sentences(words: DataFrame, chunk: int | None = None) -> DataFrame:
    """``doc_id, sentence_index, text, segments, optimized_text, optimize_log``."""
    grouped = sentence_ids(words, chunk).groupBy("doc_id", "sentence_index").agg(ordered(F.struct("text", F.col("start_ms").cast("long"), F.col("end_ms").cast("long"))).cast(f"array<{SEGMENT}>").alias("segments"))
    text = joined(F.col("segments"))
    return grouped.select("doc_id", "sentence_index", text.alias("text"), "segments", F.lit("").alias("optimized_text"), F.lit("").alias("optimize_log"))


#: What ``T.SPACE`` matches, and the last bytes of ``T.SENTENCE_END``'s marks.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
ASCII_MARKS, WIDE_MARKS = b"?!.", ("？", "！", "。")


def _spans(first: np.ndarray, last: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans in pieces of ``size``: where each piece begins, which span it is of, its place in it."""
    n = -(-(last - first) // size)
    of = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    return first[of] + place * size, of, place


class _Flat:
    """The words of a batch of recordings in a row, and where each sentence begins.  Null recordings have no words."""

    def __init__(self, words: pa.Array):
        if words.null_count:
            words = pc.if_else(words.is_valid(), words, pa.scalar([], words.type))
        offsets = words.offsets.to_numpy().astype(np.int64)
        self.words = words.flatten()
        self.bounds = offsets - offsets[0]
        self.texts = pc.utf8_trim(self.words.field("text").cast(pa.large_string()), characters=SPACES)
        starts = np.zeros(len(self.words) + 1, bool)
        starts[1:] = self._ends()
        starts[self.bounds] = True  # a recording's last word ends a sentence
        at = np.flatnonzero(starts)
        self.first, self.last = at[:-1], at[1:]
        self.before = np.searchsorted(self.first, self.bounds)  # sentences before each recording

    def _ends(self) -> np.ndarray:
        """Which words end in a mark."""
        _, offsets, data = self.texts.buffers()
        at = np.frombuffer(offsets, np.int64)[self.texts.offset :][: len(self.texts) + 1]
        tail = np.frombuffer(data, np.uint8)[at[1:] - 1] if data is not None and data.size else np.zeros(len(self.texts), np.uint8)
        some = (at[1:] > at[:-1]) & self.texts.is_valid().to_numpy(zero_copy_only=False)
        ends = some & np.isin(tail, np.frombuffer(ASCII_MARKS, np.uint8))
        wide = np.flatnonzero(some & np.isin(tail, [m.encode()[-1] for m in WIDE_MARKS]))
        if len(wide):
            found = self.texts.take(pa.array(wide))
            ends[wide] = np.logical_or.reduce([pc.ends_with(found, m).to_numpy(zero_copy_only=False) for m in WIDE_MARKS])
        return ends

    def joined(self, first: np.ndarray, end: int) -> pa.Array:
        """The texts of stretches that follow each other up to ``end``, joined by spaces; nulls are left out."""
        texts, bounds = self.texts, np.append(first, end)
        if texts.null_count:
            known = texts.is_valid().to_numpy(zero_copy_only=False)
            texts, bounds = texts.drop_null(), np.concatenate([[0], np.cumsum(known)])[bounds]
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), texts), pa.scalar(" ", pa.large_string())).cast(pa.string())


def arrays(bounds: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), values)


def lists(bounds: np.ndarray, **fields: pa.Array) -> pa.Array:
    return arrays(bounds, pa.StructArray.from_arrays([*fields.values()], [*fields]))


def cut_sentences(words: pa.Array) -> pa.Array:
    flat = _Flat(words)
    segments = arrays(np.append(flat.first, len(flat.words)), flat.words)
    return lists(flat.before, text=flat.joined(flat.first, len(flat.words)), segments=segments)


def _lines(words: pa.Array, size: pa.Array) -> pa.Array:
    flat = _Flat(words)
    first, of, place = _spans(flat.first, flat.last, size[0].as_py() if len(size) else 1)
    own = np.repeat(np.arange(len(words)), np.diff(flat.before))  # the recording of each sentence
    last = np.append(first, len(flat.words))[1:] - 1
    return lists(
        np.searchsorted(first, flat.bounds), sentence_index=pa.array(of - flat.before[own[of]], pa.int32()), split_index=pa.array(place, pa.int32()), text=flat.joined(first, len(flat.words)),
        start_ms=flat.words.field("start_ms").take(pa.array(first)), end_ms=flat.words.field("end_ms").take(pa.array(last)),
    )


def struct_type(**fields: DataType) -> StructType:
    return StructType([StructField(*f) for f in fields.items()])


_WORDS = ArrayType(struct_type(text=StringType(), start_ms=LongType(), end_ms=LongType()))
sentences_udf = F.arrow_udf(cut_sentences, ArrayType(struct_type(text=StringType(), segments=_WORDS)))
lines_udf = F.arrow_udf(_lines, ArrayType(struct_type(sentence_index=IntegerType(), split_index=IntegerType(), text=StringType(), start_ms=LongType(), end_ms=LongType())))


def _words(low: Column, high: Column, words: str = "words") -> Column:
    """Both ends included; ``slice`` in a lambda would copy all words each time."""
    return F.transform(F.sequence(low, high), lambda i: F.get(words, i))


def pieces(segments: str, words: int) -> Column:
    """The column's words in arrays of ``words``; none where there are none."""
    n = F.size(segments)
    cut = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(words)), lambda at: _words(at, F.least(at + (words - 1), n - 1), segments))
    return F.when(n > 0, cut)


def recording_sentences(recordings: DataFrame) -> DataFrame:
    """As ``sentences``, of ``doc_id, words`` with a row for each recording, whose words (``SEGMENT``) stand in order: no row
    moves.  Words are cut as whole Arrow batches; a lambda of SQL would visit each of them several times."""
    cut = recordings.select("doc_id", F.posexplode(sentences_udf(F.col("words").cast(f"array<{SEGMENT}>"))).alias("sentence_index", "s"))
    return cut.select("doc_id", "sentence_index", "s.text", "s.segments", F.lit("").alias("optimized_text"), F.lit("").alias("optimize_log"))


def recording_lines(recordings: DataFrame, words: int) -> DataFrame:
    """As ``chunk_lines`` of ``sentences``, of ``doc_id, words`` with a row for each recording: no row moves."""
    cut = recordings.select("doc_id", F.posexplode(lines_udf(F.col("words").cast(f"array<{SEGMENT}>"), F.lit(words))).alias("line_index", "l"))
    return cut.select("doc_id", "l.sentence_index", "l.split_index", "l.text", F.lit("").alias("translate_text"), "l.start_ms", "l.end_ms", "line_index")


def recordings(table: DataFrame) -> DataFrame:
    """Sentences back to ``doc_id, words``: as ``flatten``, with a row for each recording."""
    rows = F.array_sort(F.collect_list(F.struct("sentence_index", "segments")))
    flat = table.groupBy("doc_id").agg(F.flatten(F.transform(rows, lambda r: F.coalesce(r["segments"], F.array().cast(f"array<{SEGMENT}>")))).alias("flat"))
    placed = F.transform("flat", lambda s, i: F.when(T.not_blank(s["text"]), F.struct(s["start_ms"].alias("start_ms"), s["end_ms"].alias("end_ms"), i.alias("place"), s["text"].alias("text"))))
    kept = F.array_sort(F.filter(placed, lambda s: s.isNotNull()))
    return flat.select("doc_id", F.transform(kept, lambda s: F.struct(s["text"].alias("text"), s["start_ms"].alias("start_ms"), s["end_ms"].alias("end_ms"))).alias("words"))


def flatten(table: DataFrame, chunk: int | None = None, chunk_ms: int | None = None) -> DataFrame:
    """Sentences back to words, in order."""
    placed = prefix.sum_before(table.select("doc_id", "sentence_index", "segments"), "first", F.greatest(F.size("segments"), F.lit(0)), ["sentence_index"], _part("sentence_index", chunk))
    rows = placed.select("doc_id", "first", F.posexplode("segments").alias("at", "s"))
    return order_segments(rows.select("doc_id", (F.col("first") + F.col("at")).alias("ord"), "s.text", "s.start_ms", "s.end_ms"), chunk_ms=chunk_ms)


def batches(table: DataFrame, size: int, chunk: int | None = None) -> DataFrame:
    """``batch_id``: consecutive groups of ``size`` sentences, numbered after any filter upstream."""
    placed = prefix.number(table, "batch_id", ["sentence_index"], _part("sentence_index", chunk))
    return placed.withColumn("batch_id", F.floor(F.col("batch_id") / size).cast("int"))


def line_batches(lines: DataFrame, size: int = 20, chunk: int | None = None) -> DataFrame:
    """``batch_id`` of lines: ``size`` sentences a batch, no sentence divided."""
    placed = prefix.dense_number(lines, "batch_id", "sentence_index", _part("sentence_index", chunk))
    return placed.withColumn("batch_id", F.floor(F.col("batch_id") / size).cast("int"))


def payloads(batched: DataFrame) -> DataFrame:
    """A row for each batch: ``payload`` {index: text} and the time bounds of its first and last words."""
    index = F.col("sentence_index")
    pairs = F.array_sort(F.collect_list(F.struct(index.alias("o"), F.struct(index.cast("string").alias("key"), F.col("text").alias("value")).alias("kv"))))
    return batched.groupBy("doc_id", "batch_id").agg(
        F.map_from_entries(F.transform(pairs, lambda p: p["kv"])).alias("payload"),
        F.min_by(F.col("segments")[0]["start_ms"], index).alias("start_ms"),
        F.max_by(F.element_at("segments", -1)["end_ms"], index).alias("end_ms"),
        F.count("*").cast("int").alias("n_sentences"),
    )


def over_length(table: DataFrame, limit: Column | int) -> DataFrame:
    """Sentences of more words than the limit."""
    return table.where(T.count_words(F.col("text")) > limit)


def script_profile(docs: DataFrame, cjk_limit: int = 16, english_limit: int = 18) -> DataFrame:
    """Per document: characters by script, whether it is mainly without spaces, and the word limit that follows."""
    counted = docs.groupBy("doc_id").agg(F.sum(T.no_space_chars(F.col("text"))).alias("no_space_chars"), F.sum(T.visible_chars(F.col("text"))).alias("visible_chars"))
    cjk = F.coalesce(F.when(F.col("visible_chars") > 0, F.col("no_space_chars") / F.col("visible_chars") > 0.5), F.lit(False))
    return counted.withColumn("mainly_cjk", cjk).withColumn("max_word_count", F.when(cjk, cjk_limit).otherwise(english_limit))


def number_lines(parts: DataFrame, chunk: int | None = None) -> DataFrame:
    """``line_index`` from 0 over (sentence, part) in each document."""
    placed = prefix.number(parts, "line_index", ["sentence_index", "split_index"], _part("sentence_index", chunk))
    return placed.withColumn("line_index", F.col("line_index").cast("int"))


def chunk_lines(table: DataFrame, words: int, chunk: int | None = None) -> DataFrame:
    """Sentences cut every ``words`` words: the line table without a model."""
    n = F.size("segments")
    starts = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(words))
    rows = table.select("doc_id", "sentence_index", "segments", F.posexplode(starts).alias("split_index", "at"))
    part = F.slice("segments", F.col("at") + 1, words)
    cut = rows.select("doc_id", "sentence_index", F.col("split_index").cast("int").alias("split_index"), part.alias("part"))
    text = joined(F.col("part"))
    lines = cut.select("doc_id", "sentence_index", "split_index", text.alias("text"), F.lit("").alias("translate_text"), F.col("part")[0]["start_ms"].alias("start_ms"), F.element_at("part", -1)["end_ms"].alias("end_ms"))
    return number_lines(lines, chunk)

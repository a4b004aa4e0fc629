"""Repeated runs in token streams: detection, selection, excerpts, summary.

Tokens: ``doc_id, segment_index, i, raw, norm, start, end``.  A run of period p is an island of positions
where a token equals the one p places on; islands are folded per (segment, p) from left to right, each
clipped to the end of the last hit, which is the greedy leftmost-longest scan without visiting tokens
one by one.  Only islands and hits are collected, never tokens.  Folding and selection go once through a segment's
islands and hits (Arrow functions over whole batches), however many there are.

Segments that are rows (``doc_id, segment_index, words``, the words ``RAW`` in order) are scanned in their rows
(``recording_scan``): no token moves, only hits leave a batch.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from cuespark.functions import text as T
from cuespark.operators.matching import spans

SEGMENT = ["doc_id", "segment_index"]


HITS = ArrayType(StructType([StructField(c, IntegerType()) for c in ("st", "k", "island")]))
#: Words of a segment that is a row.
RAW = "array<struct<raw:string,start:double,end:double>>"
_PLACES = ("phrase_len", "start_token", "end_token", "repeat_count")
_SCANNED = StructType([
    StructField("n_tokens", LongType()),
    StructField("hits", ArrayType(StructType([*(StructField(c, IntegerType()) for c in _PLACES), StructField("phrase_tokens", ArrayType(StringType())), StructField("start", DoubleType()), StructField("end", DoubleType()), StructField("text_excerpt", StringType())]))),
])
_TOKEN = re.compile(T.ASCII_TOKEN)


def _lists(column: pa.Array) -> list[list]:
    stops = column.offsets.to_numpy()
    flat = column.flatten().to_pylist()
    first = int(stops[0]) if len(stops) else 0
    return [flat[a - first : b - first] for a, b in zip(stops.tolist(), stops.tolist()[1:], strict=False)]


def _folded(starts: pa.Array, lengths: pa.Array, least: pa.Array, period: pa.Array) -> pa.Array:
    """Hits of islands in order: each island is clipped to the end of the last hit."""
    out = []
    for st, ln, fewest, p in zip(_lists(starts), _lists(lengths), least.to_pylist(), period.to_pylist(), strict=True):
        end, hits = 0, []
        for island, (a, n) in enumerate(zip(st, ln, strict=True)):
            begin = max(a, end)
            k = (a + n - begin) // p + 1
            if a + n > end and k >= fewest:
                hits.append({"st": begin, "k": k, "island": island})
                end = begin + p * k
        out.append(hits)
    return pa.array(out, pa.list_(pa.struct([(c, pa.int32()) for c in ("st", "k", "island")])))


def _kept(starts: pa.Array, ends: pa.Array) -> pa.Array:
    """Which of a segment's hits, in the order of preference, overlap none that is kept before.

    No hit is longer than those before it, so one that overlaps it covers its first or its last token."""
    out = []
    for st, en in zip(_lists(starts), _lists(ends), strict=True):
        low = min(st, default=0)
        taken, keep = bytearray(max(en, default=low) - low), []
        for a, b in zip(st, en, strict=True):
            free = not (taken[a - low] or taken[b - 1 - low])
            if free:
                taken[a - low : b - low] = b"\x01" * (b - a)
            keep.append(free)
        out.append(keep)
    return pa.array(out, pa.list_(pa.bool_()))


def normal_forms(words: pa.Array) -> tuple[np.ndarray, list[str]]:
    """``normalize_token`` of words as numbers (-1 for null), and the forms they stand for; equal words are looked at once."""
    coded = words.dictionary_encode()
    forms: dict[str, int] = {}
    number = np.full(len(coded.dictionary) + 1, -1)
    for at, word in enumerate(coded.dictionary.to_pylist()):
        found = _TOKEN.search(word.lower())
        if found:
            number[at] = forms.setdefault(found[0], len(forms))
    return number[coded.indices.fill_null(-1).to_numpy(zero_copy_only=False)], [*forms]


def _tokens(words: pa.Array) -> pa.Array:
    if words.null_count:
        words = pc.if_else(words.is_valid(), words, pa.scalar([], words.type))
    bounds, flat = words.offsets.to_numpy().astype(np.int64), words.flatten()
    norm, forms = normal_forms(flat.field("raw"))
    known = np.flatnonzero(norm >= 0)
    at = pa.array(known)
    fields = {"raw": flat.field("raw").take(at), "norm": pa.array(forms, pa.string()).take(pa.array(norm[known])), "start": flat.field("start").take(at), "end": flat.field("end").take(at)}
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(known, bounds - bounds[0]), pa.int32()), pa.StructArray.from_arrays([*fields.values()], [*fields]))


_tokens_udf = F.arrow_udf(_tokens, ArrayType(StructType([StructField("raw", StringType()), StructField("norm", StringType()), StructField("start", DoubleType()), StructField("end", DoubleType())])))


def recording_tokens(recordings: DataFrame) -> DataFrame:
    """``doc_id, segment_index, tokens`` of segments that are rows: what ``number_tokens`` gives, in the order of its numbers."""
    return recordings.select(*SEGMENT, _tokens_udf(F.col("words").cast(RAW)).alias("tokens"))


def _found(norm: np.ndarray, owner: np.ndarray, limits: tuple[int, int, int]) -> np.ndarray:
    """``phrase_len, start, end, repeat_count`` of all runs, as columns; tokens of all segments in a row, ``owner`` tells whose they are.

    Positions rise from segment to segment and no run leaves its own, so islands of a period are folded in one go."""
    hits = []
    for p in range(1, limits[2] + 1):
        fewest = limits[0] if p == 1 else limits[1]
        same = (norm[:-p] == norm[p:]) & (owner[:-p] == owner[p:])
        edges = np.flatnonzero(np.diff(np.concatenate([[0], same.astype(np.int8), [0]])))
        first, size = edges[::2], edges[1::2] - edges[::2]
        long = size >= p * (fewest - 1)
        end = 0
        for a, n in zip(first[long].tolist(), size[long].tolist(), strict=True):
            begin = max(a, end)
            k = (a + n - begin) // p + 1
            if a + n > end and k >= fewest:
                end = begin + p * k
                hits.append((p, begin, end, k))
    return np.array(hits, np.int64).reshape(-1, 4).T


def _chosen(hits: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """The greedy selection of ``select_hits``."""
    p, start, end, k = hits
    hits = hits[:, np.lexsort((start, -k, -p, start - end, owner[start]))]
    kept = _kept(*(pa.ListArray.from_arrays(pa.array([0, hits.shape[1]], pa.int32()), pa.array(x)) for x in hits[1:3]))
    return hits[:, kept.flatten().to_numpy(zero_copy_only=False)]


def _scan_udf(select: bool, radius: int, limits: tuple[int, int, int]):
    def scanned(words: pa.Array) -> pa.Array:
        if words.null_count:
            words = pc.if_else(words.is_valid(), words, pa.scalar([], words.type))
        bounds, flat = words.offsets.to_numpy().astype(np.int64), words.flatten()
        norm, forms = normal_forms(flat.field("raw"))
        known = np.flatnonzero(norm >= 0)
        norm, owner = norm[known], np.repeat(np.arange(len(words)), np.diff(bounds))[known]
        first = np.searchsorted(known, bounds - bounds[0])  # tokens before each segment
        hits = _found(norm, owner, limits)
        if select and hits.size:
            hits = _chosen(hits, owner)
        p, start, end, k = hits = hits[:, np.argsort(owner[hits[1]], kind="stable")]
        of = owner[start]
        low, high = np.maximum(start - radius, first[of]), np.minimum(end + radius, first[of + 1])
        listed = lambda sizes: pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
        around = pa.ListArray.from_arrays(listed(high - low), flat.field("raw").take(pa.array(known[spans(low, high - low)])))
        marks = [pa.array(np.where(cut, mark, ""), pa.string()) for cut, mark in ((start - first[of] > radius, "... "), (end + radius < first[of + 1], " ..."))]
        phrase = pa.array([forms[x] for x in norm[spans(start, p)].tolist()], pa.string())
        fields = {
            "phrase_len": pa.array(p, pa.int32()), "start_token": pa.array(start - first[of], pa.int32()), "end_token": pa.array(end - first[of], pa.int32()), "repeat_count": pa.array(k, pa.int32()),
            "phrase_tokens": pa.ListArray.from_arrays(listed(p), phrase), "start": flat.field("start").take(pa.array(known[start])), "end": flat.field("end").take(pa.array(known[end - 1])),
            "text_excerpt": pc.binary_join_element_wise(marks[0], pc.binary_join(around, " "), marks[1], ""),
        }
        rows = pa.ListArray.from_arrays(listed(np.bincount(of, minlength=len(words))), pa.StructArray.from_arrays([*fields.values()], [*fields]))
        return pa.StructArray.from_arrays([pa.array(np.diff(first), pa.int64()), rows], ["n_tokens", "hits"])

    return F.arrow_udf(scanned, _SCANNED)


def scanned(recordings: DataFrame, min_word_run: int = 5, min_phrase_run: int = 4, max_phrase_len: int = 4, select: bool = True, radius: int = 6) -> DataFrame:
    """``doc_id, segment_index, n_tokens, hits`` of segments that are rows; without ``select`` all runs are hits."""
    _check_limits(min_word_run, min_phrase_run, max_phrase_len)
    found = _scan_udf(select, radius, (min_word_run, min_phrase_run, max_phrase_len))(F.col("words").cast(RAW))
    return recordings.select(*SEGMENT, found.alias("s")).select(*SEGMENT, "s.n_tokens", "s.hits")


def recording_scan(recordings: DataFrame, **options: int) -> DataFrame:
    """As ``scan``, of segments that are rows: no row moves."""
    phrase = F.array_join("phrase_tokens", " ").alias("phrase")
    hits = scanned(recordings, **options).select(*SEGMENT, F.inline("hits"))
    return hits.select(*SEGMENT, *_PLACES, "phrase_tokens", phrase, (F.col("end_token") - F.col("start_token")).alias("token_count"), "start", "end", "text_excerpt")


def recording_runs(recordings: DataFrame, select: bool = False, **limits: int) -> DataFrame:
    """As ``runs``, or with ``select`` as ``select_hits`` of them, of segments that are rows."""
    return recording_scan(recordings, select=select, **limits).select(*SEGMENT, *_PLACES)


def recording_summary(recordings: DataFrame, **limits: int) -> DataFrame:
    """As ``summary``, of segments that are rows: one row a segment is grouped by its document, no token."""
    flagged = F.aggregate("hits", F.lit(0).cast("long"), lambda n, h: n + h["end_token"] - h["start_token"])
    rows = scanned(recordings, **limits).select("doc_id", "n_tokens", F.size("hits").cast("long").alias("n"), flagged.alias("flagged"))
    return _with_ratio(rows.groupBy("doc_id").agg(
        F.count("*").alias("total_segments"), F.sum("n_tokens").alias("total_tokens"), F.count_if(F.col("n") > 0).alias("flagged_segments"), F.sum("n").alias("total_hits"), F.sum("flagged").alias("flagged_tokens")
    ))


def _check_limits(min_word_run: int, min_phrase_run: int, max_phrase_len: int) -> None:
    if min_word_run < 2 or min_phrase_run < 2 or max_phrase_len < 1:
        raise ValueError("runs need min_word_run >= 2, min_phrase_run >= 2 and max_phrase_len >= 1")


def number_tokens(words: DataFrame, normalize=T.normalize_token) -> DataFrame:
    """Words (``doc_id, segment_index, ord, raw, start, end``) with a normal form, numbered from 0 in ``i``."""
    order = W.partitionBy(*SEGMENT).orderBy("ord")
    known = words.withColumn("norm", normalize(F.col("raw"))).where("norm IS NOT NULL")
    return known.select(*SEGMENT, (F.row_number().over(order) - 1).cast("int").alias("i"), "raw", "norm", "start", "end")


def runs(tokens: DataFrame, min_word_run: int = 5, min_phrase_run: int = 4, max_phrase_len: int = 4, phrases: bool = False) -> DataFrame:
    """``doc_id, segment_index, phrase_len, start_token, end_token, repeat_count``; with ``phrases`` also ``phrase``.

    An island carries its first p tokens; a hit that begins later in it has them rotated.
    """
    _check_limits(min_word_run, min_phrase_run, max_phrase_len)
    order = W.partitionBy(*SEGMENT).orderBy("i")
    same = [F.when(F.col("norm") == F.lead("norm", p).over(order), F.lit(p)) for p in range(1, max_phrase_len + 1)]
    none = F.lit(None).cast("array<string>")
    ahead = [F.array(F.col("norm"), *[F.lead("norm", p).over(order) for p in range(1, max_phrase_len)]).alias("ahead")] if phrases else []
    periods = tokens.select(*SEGMENT, "i", *ahead, F.array_compact(F.array(*same)).alias("periods"))
    hit = periods.select(*periods.columns[:-1], F.explode("periods").alias("p"))
    island = F.col("i") - F.row_number().over(W.partitionBy(*SEGMENT, "p").orderBy("i"))
    islands = hit.withColumn("g", island).groupBy(*SEGMENT, "p", "g").agg(F.min("i").alias("st"), F.count("*").cast("int").alias("len"), *([F.min_by("ahead", "i").alias("ahead")] if phrases else []))
    # an island of period p shorter than p * (least - 1) cannot hold a hit
    least = F.when(F.col("p") == 1, min_word_run).otherwise(min_phrase_run)
    islands = islands.where(F.col("len") >= F.col("p") * (least - 1))
    folded = islands.groupBy(*SEGMENT, "p").agg(F.array_sort(F.collect_list(F.struct("st", "len", (F.col("ahead") if phrases else none).alias("ahead")))).alias("islands"))
    hits = F.arrow_udf(_folded, HITS)("islands.st", "islands.len", F.when(F.col("p") == 1, min_word_run).otherwise(min_phrase_run), "p")
    found = folded.select(*SEGMENT, "p", "islands", F.explode(hits).alias("x"))
    found = found.select(*SEGMENT, "p", F.struct("x.st", "x.k", F.col("islands")[F.col("x.island")]["st"].alias("at"), F.col("islands")[F.col("x.island")]["ahead"].alias("ahead")).alias("h"))
    turn = F.pmod(F.col("h.st") - F.col("h.at"), "p")
    rotated = F.concat(F.slice("h.ahead", turn + 1, F.col("p") - turn), F.slice("h.ahead", F.lit(1), turn))
    columns = [F.col("p").alias("phrase_len"), F.col("h.st").alias("start_token"), (F.col("h.st") + F.col("p") * F.col("h.k")).alias("end_token"), F.col("h.k").alias("repeat_count")]
    return found.select(*SEGMENT, *columns, *([F.array_join(rotated, " ").alias("phrase")] if phrases else []))


def select_hits(hits: DataFrame) -> DataFrame:
    """Greedy selection without overlap: most tokens, then longest phrase, most repeats, first start."""
    key = F.struct(
        (F.col("start_token") - F.col("end_token")).alias("a"), (-F.col("phrase_len")).alias("b"), (-F.col("repeat_count")).alias("c"),
        F.col("start_token").alias("st"), F.col("end_token").alias("en"), (F.col("phrase") if "phrase" in hits.columns else F.lit(None).cast("string")).alias("phrase"),
    )
    grouped = hits.groupBy(*SEGMENT).agg(F.array_sort(F.collect_list(key)).alias("hits"))
    keep = F.arrow_udf(_kept, ArrayType(BooleanType()))("hits.st", "hits.en")
    marked = grouped.select(*SEGMENT, "hits", keep.alias("keep"))
    rows = marked.select(*SEGMENT, F.explode(F.filter("hits", lambda _, i: F.col("keep")[i])).alias("h"))
    return rows.select(*SEGMENT, (-F.col("h.b")).alias("phrase_len"), F.col("h.st").alias("start_token"), F.col("h.en").alias("end_token"), (-F.col("h.c")).alias("repeat_count"), *(["h.phrase"] if "phrase" in hits.columns else []))


def describe_hits(hits: DataFrame, tokens: DataFrame, radius: int = 6) -> DataFrame:
    """Hits with ``phrase, token_count, start, end, text_excerpt``.

    Each hit is joined by position with the tokens it and its surroundings need; nothing else of a
    document is gathered.
    """
    key = [*SEGMENT, "phrase_len", "start_token", "end_token", "repeat_count"]
    past = F.col("end_token") + radius  # one token more than is shown tells whether the segment goes on
    spots = hits.select(*key, F.explode(F.sequence(F.greatest(F.lit(0), F.col("start_token") - radius), past)).alias("i"))
    met = spots.join(tokens, [*SEGMENT, "i"])
    inside = (F.col("i") >= F.col("start_token")) & (F.col("i") < F.col("start_token") + F.col("phrase_len"))
    rows = met.groupBy(*key).agg(
        F.array_sort(F.collect_list(F.when(F.col("i") < past, F.struct("i", "raw")))).alias("around"), F.max("i").alias("last"),
        F.array_sort(F.collect_list(F.when(inside, F.struct("i", "norm")))).alias("within"),
        F.max(F.when(F.col("i") == F.col("start_token"), F.col("start"))).alias("start"),
        F.max(F.when(F.col("i") == F.col("end_token") - 1, F.col("end"))).alias("end"),
    )
    words = F.array_join(F.transform("around", lambda r: r["raw"]), " ")
    excerpt = F.concat(F.when(F.col("start_token") > radius, "... ").otherwise(""), words, F.when(F.col("last") == past, " ...").otherwise(""))
    phrase = F.transform("within", lambda r: r["norm"])
    return rows.select(
        *SEGMENT, "phrase_len", "start_token", "end_token", "repeat_count", phrase.alias("phrase_tokens"), F.array_join(phrase, " ").alias("phrase"),
        (F.col("end_token") - F.col("start_token")).alias("token_count"), "start", "end", excerpt.alias("text_excerpt"),
    )


def scan(words: DataFrame, **limits: int) -> DataFrame:
    """Words to selected, described hits."""
    tokens = number_tokens(words)
    return describe_hits(select_hits(runs(tokens, **limits)), tokens)


def frequent_phrases(words: DataFrame, n: int = 10, **limits: int) -> DataFrame:
    """``top_phrases`` of a scan, without describing its hits: one pass over the words."""
    return top_phrases(select_hits(runs(number_tokens(words), phrases=True, **limits)), n)


def summary(segments: DataFrame, tokens: DataFrame, hits: DataFrame) -> DataFrame:
    """One row for each document: totals, flagged segments and tokens, their ratio.

    ``segments(doc_id)`` has a row for every segment, malformed ones included.
    """
    total = segments.groupBy("doc_id").agg(F.count("*").alias("total_segments"))
    seen = tokens.groupBy("doc_id").agg(F.count("*").alias("total_tokens"))
    flagged = hits.groupBy("doc_id").agg(
        F.countDistinct("segment_index").alias("flagged_segments"), F.count("*").alias("total_hits"), F.sum(F.col("end_token") - F.col("start_token")).alias("flagged_tokens")
    )
    return _with_ratio(total.join(seen, "doc_id", "left").join(flagged, "doc_id", "left").na.fill(0))


def _with_ratio(joined: DataFrame) -> DataFrame:
    ratio = F.when(F.col("total_tokens") > 0, F.col("flagged_tokens") / F.col("total_tokens")).otherwise(F.lit(0.0))
    return joined.withColumn("flagged_token_ratio", ratio).withColumn("has_repeats", F.col("total_hits") > 0)


def top_phrases(described: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` most frequent phrases; ties by first appearance in (document, segment, start, end, length)."""
    seen = F.min(F.struct("doc_id", "segment_index", "start_token", "end_token", "phrase_len"))
    return described.groupBy("phrase").agg(F.count("*").alias("count"), seen.alias("seen")).orderBy(F.desc("count"), "seen").limit(n).select("phrase", "count")


def ranked(described: DataFrame, n: int = 30) -> DataFrame:
    """The ``n`` heaviest hits, ranked as the selection ranks them."""
    order = [F.desc("token_count"), F.desc("phrase_len"), F.desc("repeat_count"), "doc_id", "segment_index", "start_token"]
    return described.orderBy(*order).limit(n)

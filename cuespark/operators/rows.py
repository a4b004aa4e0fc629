"""The caption stages in the rows of their recordings: ``doc_id, words`` with a row for each, whose words stand in order.

Every stage has two steps for an Arrow batch: what is to be asked for each row, and the row with its answers.  No row
moves, and a row keeps its words once: what was corrected stands beside them as ``edits``, sentences are cut anew.  The
rows are those of the stages over word streams (``plans.captions``).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

from cuespark.operators import align
from cuespark.operators import sentences as S
from cuespark.operators.completion import NO_SPACE, count_words

EDITS = "array<struct<sentence_index:int,text:string>>"
LINE = "sentence_index:int,split_index:int,text:string,start_ms:bigint,end_ms:bigint"
#: What the tables of the stages have besides ``doc_id``.
CORRECTED = f"words array<{S.SEGMENT}>, edits {EDITS}"
CUT = f"n_sentences int, logged array<int>, lines array<struct<{LINE}>>"
TRANSLATED = f"n_sentences int, logged array<int>, lines array<struct<{LINE},translate_text:string>>, failed_lines bigint, total_lines bigint"
_SEGMENT = pa.struct([("text", pa.string()), ("start_ms", pa.int64()), ("end_ms", pa.int64())])
_EDITS = pa.list_(pa.struct([("sentence_index", pa.int32()), ("text", pa.string())]))

#: A batch with what its answers are worked into, and the requests of each of its rows.
Asked = tuple[pa.RecordBatch, list[list[dict]]]


@dataclass
class Stage:
    """``requests`` of a batch, ``finish`` of some of its rows with the ``(result, status, attempts)`` of their requests."""

    schema: str
    requests: Callable[[pa.RecordBatch], Asked]
    finish: Callable[[pa.RecordBatch, list[list[tuple]]], pa.RecordBatch]


def _bounds(lists: pa.Array) -> np.ndarray:
    offsets = lists.offsets.to_numpy().astype(np.int64)
    return offsets - offsets[0]


def _per_row(values: list, bounds: np.ndarray) -> list[list]:
    return [values[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


def _batches(texts: dict[str, str], size: int, **more) -> list[dict]:
    pairs = [*texts.items()]
    return [{"payload": dict(pairs[i : i + size]), **more} for i in range(0, len(pairs), size)]


def _with(batch: pa.RecordBatch, **columns: pa.Array) -> pa.RecordBatch:
    kept = [c for c in batch.schema.names if c not in columns]
    return pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *columns.values()], [*kept, *columns])


def _plain(words: pa.Array) -> pa.Array:
    """The words without null recordings, in types of their own."""
    words = words.cast(pa.list_(_SEGMENT))
    return pc.if_else(words.is_valid(), words, pa.scalar([], words.type)) if words.null_count else words


def _texts(sentences: pa.Array) -> list[list[str]]:
    return _per_row(sentences.flatten().field("text").to_pylist(), _bounds(sentences))


def _answers(outcomes: list[tuple]) -> dict[int, object]:
    """All answers of a row by number; keys that are none are left out."""
    found: dict[int, object] = {}
    for result, _, _ in outcomes:
        for key, value in result.items():
            try:
                found[int(key)] = value
            except ValueError:
                continue
    return found


# --- correction


def correcting(size: int) -> Stage:
    def requests(batch: pa.RecordBatch) -> Asked:
        words = _plain(batch.column("words"))
        sentences = S.cut_sentences(words)
        asked = [_batches({str(i): t for i, t in enumerate(own)}, size, reference_text="") for own in _texts(sentences)]
        return _with(batch, words=words, sentences=sentences), asked

    def finish(batch: pa.RecordBatch, outcomes: list[list[tuple]]) -> pa.RecordBatch:
        edits = [[(i, t) for i, t in sorted(_answers(own).items()) if 0 <= i < len(texts) and t and t.strip() and t.strip() != texts[i].strip()] for own, texts in zip(outcomes, _texts(batch.column("sentences")), strict=True)]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("words"), pa.array(edits, _EDITS)], ["doc_id", "words", "edits"])

    return Stage(CORRECTED, requests, finish)


def _edited(sentences: pa.Array, edits: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Which of all sentences in a row were edited, and their new texts."""
    flat = edits.flatten()
    row = np.repeat(np.arange(len(edits)), np.diff(_bounds(edits)))
    return _bounds(sentences)[row] + flat.field("sentence_index").to_numpy().astype(np.int64), flat.field("text")


def _audit(words: pa.Array, edits: pa.Array) -> pa.Array:
    sentences = S.cut_sentences(_plain(words))
    flat, (at, new) = sentences.flatten(), _edited(sentences, edits)
    place = np.zeros(len(flat), np.int64)
    place[at] = np.arange(1, len(at) + 1)
    shown = lambda found: pa.concat_arrays([pa.array([""], pa.string()), found.cast(pa.string())]).take(pa.array(place))
    old = flat.field("text").take(pa.array(at))
    return S.lists(_bounds(sentences), text=flat.field("text"), segments=flat.field("segments"), optimized_text=shown(new), optimize_log=shown(align.change_log_arrow(old, new)))


def rewritten(words: pa.Array, sentences: pa.Array, edits: pa.Array) -> pa.Array:
    """The recordings with their edited sentences: times are carried over, blank words go, the rest is in the order of times."""
    at, new = _edited(sentences, edits)
    bounds, flat = _bounds(words), words.flatten()
    if len(at):
        segments = sentences.flatten().field("segments").cast(pa.list_(_SEGMENT))
        which = np.arange(len(segments))
        which[at] = len(segments) + np.arange(len(at))
        moved = align.carry_times_arrow(segments.take(pa.array(at)), new).cast(segments.type)
        segments = pa.concat_arrays([segments, moved]).take(pa.array(which))
        bounds, flat = _bounds(segments)[_bounds(sentences)], segments.flatten()
    trimmed = pc.utf8_trim(flat.field("text"), characters=S.SPACES)
    kept = pc.fill_null(pc.not_equal(trimmed, ""), False).to_numpy(zero_copy_only=False)
    start, end = (flat.field(c).fill_null(np.iinfo(np.int64).min).to_numpy() for c in ("start_ms", "end_ms"))
    row = np.repeat(np.arange(len(words)), np.diff(bounds))
    later = (row[1:] > row[:-1]) | (start[1:] > start[:-1]) | ((start[1:] == start[:-1]) & (end[1:] >= end[:-1]))
    order = np.arange(len(flat)) if later.all() else np.lexsort((end, start, row))  # stable: ties stay in place
    if kept.all() and later.all():
        return S.arrays(bounds, flat)
    order = order[kept[order]]
    return S.arrays(np.concatenate([[0], np.cumsum(np.bincount(row[order], minlength=len(words)))]), flat.take(pa.array(order)))


def _regrouped(words: pa.Array, edits: pa.Array) -> pa.Array:
    words = _plain(words)
    return S.cut_sentences(rewritten(words, S.cut_sentences(words), edits))


audit_udf = F.arrow_udf(_audit, ArrayType(S.struct_type(text=StringType(), segments=align.SEGMENTS, optimized_text=StringType(), optimize_log=StringType())))
regrouped_udf = F.arrow_udf(_regrouped, ArrayType(S.struct_type(text=StringType(), segments=align.SEGMENTS)))


# --- splitting


def _mainly_cjk(texts: list[str]) -> bool:
    whole = " ".join(texts)
    return not whole.isascii() and 2 * len(NO_SPACE.findall(whole)) > sum(map(len, whole.split()))


def splitting(size: int, cjk_limit: int, english_limit: int) -> Stage:
    """Lines of the rewritten sentences: those over the limit of their recording are split, all are aligned to words."""

    def requests(batch: pa.RecordBatch) -> Asked:
        words, edits = _plain(batch.column("words")), batch.column("edits")
        before = S.cut_sentences(words)
        texts = _texts(before)
        at, new = _edited(before, edits)
        differs = [a.split() != b.split() for a, b in zip(before.flatten().field("text").take(pa.array(at)).to_pylist(), new.to_pylist(), strict=True)]
        number = edits.flatten().field("sentence_index").to_pylist()
        logged = [[i for i, d in pairs if d] for pairs in _per_row([*zip(number, differs, strict=True)], _bounds(edits))]
        after = S.cut_sentences(rewritten(words, before, edits))
        asked = []
        for old, own in zip(texts, _texts(after), strict=True):
            limit = cjk_limit if _mainly_cjk(old) else english_limit
            asked.append(_batches({str(i): t for i, t in enumerate(own) if count_words(t) > limit}, size, max_word_count=limit))
        counts = pa.array([*map(len, texts)], pa.int32())
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), counts, pa.array(logged, pa.list_(pa.int32())), after], ["doc_id", "n_sentences", "logged", "sentences"]), asked

    def finish(batch: pa.RecordBatch, outcomes: list[list[tuple]]) -> pa.RecordBatch:
        sentences = batch.column("sentences")
        bounds, flat = _bounds(sentences), sentences.flatten()
        parts = {first + i: p for first, own in zip(bounds.tolist(), outcomes, strict=False) for i, p in _answers(own).items()}
        return _with(batch, lines=_lines(flat, bounds, parts)).select(["doc_id", "n_sentences", "logged", "lines"])

    return Stage(CUT, requests, finish)


def _lines(sentences: pa.Array, bounds: np.ndarray, parts: dict[int, list[str]]) -> pa.Array:
    """Lines of all sentences in a row; ``parts`` of some: one is the line's text, of several each is a line."""
    text, segments = sentences.field("text"), sentences.field("segments")
    words, ends = segments.flatten(), _bounds(segments)
    one, several = ([i for i, p in parts.items() if (len(p) > 1) == more and p] for more in (False, True))
    which = np.arange(len(sentences))
    which[one] = len(sentences) + np.arange(len(one))
    said = pa.concat_arrays([text, pa.array([parts[i][0] for i in one], pa.string())]).take(pa.array(which))
    whole = pa.StructArray.from_arrays([said, words.field("start_ms").take(pa.array(ends[:-1])), words.field("end_ms").take(pa.array(ends[1:] - 1))], ["text", "start_ms", "end_ms"]).cast(_SEGMENT)
    lines = S.arrays(np.arange(len(sentences) + 1), whole)
    if several:
        chosen = pa.array(several, pa.int64())
        cut = align.lines_arrow(segments.take(chosen), pa.array([parts[i] for i in several], pa.list_(pa.string())), text.take(chosen))
        which = np.arange(len(sentences))
        which[several] = len(sentences) + np.arange(len(several))
        lines = pa.concat_arrays([lines, cut.cast(lines.type)]).take(pa.array(which))
    at, flat = _bounds(lines), lines.flatten()
    n = np.diff(at)
    own = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))  # the recording of each sentence
    index, split = np.repeat(np.arange(len(sentences)) - bounds[own], n), np.arange(len(flat)) - np.repeat(at[:-1], n)
    return S.lists(at[bounds], sentence_index=pa.array(index, pa.int32()), split_index=pa.array(split, pa.int32()), text=flat.field("text"), start_ms=flat.field("start_ms"), end_ms=flat.field("end_ms"))


# --- translation


def translating(size: int = 20) -> Stage:
    """Lines in batches of ``size`` sentences, no sentence divided.  ``translate_text`` is null where it is the line's text."""

    def requests(batch: pa.RecordBatch) -> Asked:
        lines = batch.column("lines")
        bounds, flat = _bounds(lines), lines.flatten()
        asked = []
        for own in _per_row([*zip(flat.field("sentence_index").to_pylist(), flat.field("text").to_pylist(), strict=True)], bounds):
            groups: dict[int, dict[str, str]] = {}
            for i, (sentence, text) in enumerate(own):  # every sentence has a line, so its index is its place
                groups.setdefault(sentence // size, {})[str(i)] = text
            asked.append([{"payload": g} for g in groups.values()])
        return _with(batch, sizes=pa.array([[len(r["payload"]) for r in own] for own in asked], pa.list_(pa.int32()))), asked

    def finish(batch: pa.RecordBatch, outcomes: list[list[tuple]]) -> pa.RecordBatch:
        lines, sizes = batch.column("lines"), batch.column("sizes").to_pylist()
        bounds, flat = _bounds(lines), lines.flatten()
        said = []
        for texts, own in zip(_per_row(flat.field("text").to_pylist(), bounds), outcomes, strict=True):
            found = _answers(own)
            said += [None if found.get(i) == t else found.get(i) or "" for i, t in enumerate(texts)]
        failed = [sum(n for n, (_, status, _) in zip(own, got, strict=True) if status.startswith("error")) for own, got in zip(sizes, outcomes, strict=True)]
        fields = {c: flat.field(c) for c in ("sentence_index", "split_index", "text", "start_ms", "end_ms")}
        full = S.lists(bounds, **fields, translate_text=pa.array(said, pa.string()))
        return _with(batch, lines=full, failed_lines=pa.array(failed, pa.int64()), total_lines=pa.array(np.diff(bounds), pa.int64())).select(["doc_id", "n_sentences", "logged", "lines", "failed_lines", "total_lines"])

    return Stage(TRANSLATED, requests, finish)

"""Token alignment: diffs, similarity, timestamps carried through edits, parts matched to words.

Alignment is that of Python's ``difflib`` (its rules are part of the results), found for whole Arrow batches at once
on integers (``matching``).  Words arrive as flat Arrow arrays, times are moved with numpy; Python sees tokens only.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from cuespark.operators import matching

Words = list[dict]
SEGMENTS = ArrayType(StructType([StructField("text", StringType()), StructField("start_ms", LongType()), StructField("end_ms", LongType())]))
OPCODES = ArrayType(StructType([StructField("tag", StringType()), *(StructField(c, IntegerType()) for c in ("i1", "i2", "j1", "j2"))]))
#: Least similarity of a part to the words it stands for.
MATCH = 0.8
_EDGES = re.compile(r"^[^\w]+|[^\w]+$")


def bases(tokens: list[str]) -> list[str]:
    """Lower-cased tokens without punctuation at their edges; tokens of nothing else stay, empty."""
    return [_EDGES.sub("", t.strip()).lower() for t in tokens]


def edits(before: Sequence[list[str]], after: Sequence[list[str]], relaxed: bool = False) -> tuple[np.ndarray, ...]:
    """``pair, i1, i2, j1, j2, equal`` of the edit operations of each pair of token lists; ``relaxed`` compares bases."""
    return matching.batch(*([*map(bases, x)] for x in (before, after))).edits() if relaxed else matching.batch(before, after).edits()


def _tagged(rows: tuple[np.ndarray, ...], pairs: int) -> list[list[tuple[str, int, int, int, int]]]:
    out: list[list[tuple[str, int, int, int, int]]] = [[] for _ in range(pairs)]
    for pair, i1, i2, j1, j2, equal in zip(*(x.tolist() for x in rows), strict=True):
        out[pair].append(("equal" if equal else "insert" if i1 == i2 else "delete" if j1 == j2 else "replace", i1, i2, j1, j2))
    return out


def opcodes(before: list[str], after: list[str], relaxed: bool = False) -> list[tuple[str, int, int, int, int]]:
    """Edit operations from one token list to another."""
    return _tagged(edits([before], [after], relaxed), 1)[0]


def coalesced(operations: list[tuple[str, int, int, int, int]]) -> list[tuple[str, int, int, int, int]]:
    """Neighbouring edits become one, tagged by which of its sides is empty."""
    out: list[tuple[str, int, int, int, int]] = []
    for operation in operations:
        if operation[0] != "equal" and out and out[-1][0] != "equal":
            _, i1, _, j1, _ = out.pop()
            _, _, i2, _, j2 = operation
            operation = ("edit", i1, i2, j1, j2)
        out.append(operation)
    named = {(True, False): "insert", (False, True): "delete", (False, False): "replace", (True, True): "insert"}
    return [o if o[0] == "equal" else (named[o[1] == o[2], o[3] == o[4]], *o[1:]) for o in out]


def inline_diffs(before: Sequence[str], after: Sequence[str]) -> list[str]:
    """The new tokens of each pair, each edit as ``【old/new】`` with ``∅`` for an empty side."""
    old, new = [t.split() for t in before], [t.split() for t in after]
    show = lambda tokens: " ".join(tokens) or "∅"
    pieces: list[list[str]] = [[] for _ in old]
    for pair, i1, i2, j1, j2, equal in zip(*(x.tolist() for x in edits(old, new)), strict=True):
        kept = new[pair][j1:j2]
        pieces[pair].append(" ".join(kept) if equal else f"【{show(old[pair][i1:i2])}/{show(kept)}】")
    return [*map(" ".join, pieces)]


def inline_diff(before: str, after: str) -> str:
    return inline_diffs([before], [after])[0]


def change_logs(before: Sequence[str], after: Sequence[str]) -> list[str]:
    """The inline diffs; empty where nothing changed."""
    return ["" if shown == " ".join(new.split()) else shown for shown, new in zip(inline_diffs(before, after), after, strict=True)]


def change_log(before: str, after: str) -> str:
    return change_logs([before], [after])[0]


def _ratios(left: Sequence[str], right: Sequence[str], equal_below: float) -> list[float]:
    """Pairs that agree are 1 without the matcher, which sees the others only."""
    out, rest = [1.0] * len(left), []
    for at, (x, y) in enumerate(zip(left, right, strict=True)):
        if x == y and (len(y) < equal_below or len(y.split()) < equal_below):
            continue
        x, y = bases(x.split()), bases(y.split())
        if x != y or len(y) >= equal_below:
            rest.append((at, x, y))
    if rest:
        for (at, _, _), ratio in zip(rest, matching.batch([x for _, x, _ in rest], [y for _, _, y in rest]).ratios().tolist(), strict=True):
            out[at] = ratio
    return out


def similarities(left: Sequence[str], right: Sequence[str]) -> list[float]:
    """Ratios of matching bases; 1 where they agree."""
    return _ratios(left, right, float("inf"))


def similarity(left: str, right: str) -> float:
    return similarities([left], [right])[0]


def edit_ratios(before: Sequence[str], after: Sequence[str]) -> list[float]:
    """Ratios of matching bases; equal lists give 1 unless they are so long that the matcher's own rule for
    frequent tokens applies, which then decides."""
    return _ratios(before, after, matching.POPULAR_FROM)


def carried(words: Sequence[list[str]], starts: np.ndarray, ends: np.ndarray, tokens: Sequence[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """Times of all ``tokens`` in a row, taken from ``words`` (``starts`` and ``ends`` in a row) through relaxed diffs.

    Kept tokens keep their times; a replacement of equal size does too; one of another size divides the span of what it
    replaces evenly; insertions share the gap they fall in, or its one edge, or begin at 0.
    """
    n = np.array([*map(len, words)], np.int64)
    first, base = np.cumsum(n) - n, np.cumsum([0, *map(len, tokens)])
    pair, i1, i2, j1, j2, equal = edits(words, tokens, relaxed=True)
    some = j2 > j1  # deletions leave nothing
    pair, i1, i2, j1, j2, equal = (x[some] for x in (pair, i1, i2, j1, j2, equal))
    count, kept = j2 - j1, (equal > 0) | (i2 - i1 == j2 - j1)
    pick = lambda values, at, ok: np.where(ok, values[np.where(ok, first[pair] + at, 0)], 0) if len(values) else np.zeros(len(pair), np.int64)
    before, after = i1 > 0, i1 < n[pair]
    left, right = pick(ends, i1 - 1, before), pick(starts, i1, after)
    gap = before & after & (right > left)
    point = np.where(after, right, left)  # 0 without words
    replaced = i2 > i1
    low = np.where(replaced, pick(starts, i1, replaced), np.where(gap, left, point))
    high = np.where(replaced, pick(ends, i2 - 1, replaced), np.where(gap, right, point))
    op = np.repeat(np.arange(len(pair)), count)
    k = np.arange(len(op)) - np.repeat(np.cumsum(count) - count, count)
    source = np.where(kept[op], first[pair[op]] + i1[op] + k, 0)
    share = lambda x: low[op] + (high - low)[op] * x // count[op]
    own = (starts[source], ends[source]) if len(starts) else (np.zeros(len(op), np.int64),) * 2
    out = np.zeros((2, base[-1]), np.int64)
    out[:, base[pair[op]] + j1[op] + k] = np.where(kept[op], own[0], share(k)), np.where(kept[op], own[1], share(k + 1))
    return out[0], out[1]


def carry_times(words: Words, text: str) -> Words:
    """The tokens of ``text`` with times taken from ``words``."""
    tokens, times = text.split(), (np.array([w[c] for w in words], np.int64) for c in ("start_ms", "end_ms"))
    start, end = carried([[w["text"].strip() for w in words]], *times, [tokens])
    return [{"text": t, "start_ms": a, "end_ms": b} for t, a, b in zip(tokens, start.tolist(), end.tolist(), strict=True)]


class _Places:
    """A sentence's words as numbered bases, and which range of words is most like a part."""

    def __init__(self, texts: list[str], numbers: dict[str, int]):
        self.tokens, self.of = matching.numbered([bases(t.split()) for t in texts], numbers)

    def best_end(self, wanted: np.ndarray, at: int, stop: int, only_last: bool) -> int | None:
        """The first word of ``at`` to ``stop`` (exclusive) at which a range from ``at`` on that is most like ``wanted`` ends;
        None where none reaches ``MATCH``.

        A range is compared only if it could be the best one: it has at most as much in common with the part as the two
        have tokens in common in any order, or, where that leaves many ranges, as their longest common subsequence.
        """
        sizes = self.of[at + 1 : stop + 1] - self.of[at]  # tokens up to each end
        ends = np.arange(at, stop)
        if only_last:
            sizes, ends = sizes[-1:], ends[-1:]
        near = 2.0 * len(wanted) >= MATCH * (len(wanted) + sizes)  # longer ranges have less in common
        sizes, ends = sizes[near], ends[near]
        if not len(ends):
            return None
        found = self.tokens[self.of[at] : self.of[at] + sizes[-1]]
        exact = np.flatnonzero(sizes == len(wanted))
        if len(exact) and (found[: len(wanted)] == wanted).all():
            return int(ends[exact[0]])
        total = np.maximum(len(wanted) + sizes, 1)
        most = 2.0 * matching.common_in_prefixes(wanted, found)[sizes] / total
        best, best_end, group, refined = -1.0, None, 4, False
        while True:
            open_ends = np.flatnonzero(most >= max(MATCH, best))
            if not len(open_ends):
                return best_end if best >= MATCH else None
            if not refined and best_end is not None and len(open_ends) > 32:
                refined, most = True, np.minimum(most, 2.0 * matching.subsequence_in_prefixes(wanted, found)[sizes] / total)
                continue
            now = open_ends[np.argsort(-most[open_ends], kind="stable")][:group]
            lengths = sizes[now]
            ranges = matching.Batch(np.tile(wanted, len(now)), len(wanted) * np.arange(len(now) + 1), found[matching.spans(np.zeros(len(now), np.int64), lengths)], np.cumsum([0, *lengths]))
            for score, end in zip(ranges.ratios().tolist(), ends[now].tolist(), strict=True):
                if score > best or (score == best and end < best_end):
                    best, best_end = score, end
            most[now], group = -1.0, min(64, 2 * group)


def match_all(sentences: Sequence[list[str]], parts: Sequence[list[str]]) -> list[list[tuple[int, int]] | None]:
    """Word ranges (first, last) of each sentence's parts in turn, or None where they cannot be aligned.

    Every part but the last takes the first range of highest similarity that leaves a word for each part
    after it, and must reach ``MATCH``; the last must reach it against all words that remain.
    """
    numbers: dict[str, int] = {}
    return [_match(texts, own, numbers) for texts, own in zip(sentences, parts, strict=True)]


def _followed(texts: list[str], parts: list[str]) -> list[tuple[int, int]] | None:
    """Ranges of parts that are, word by word, the texts one after the other up to the last; None where one is not.

    Such a range is exact, and the first: every text in it is one token, so no shorter range has as many."""
    ranges, at = [], 0
    for part in parts:
        wanted = part.split()
        end = at + len(wanted)
        if not wanted or texts[at:end] != wanted:
            return None
        ranges.append((at, end - 1))
        at = end
    return ranges if at == len(texts) else None


def _match(texts: list[str], parts: list[str], numbers: dict[str, int]) -> list[tuple[int, int]] | None:
    if not texts or not parts:
        return None
    if len(parts) == 1:
        return [(0, len(texts) - 1)]
    followed = _followed(texts, parts)
    if followed is not None:
        return followed
    places, ranges, at = _Places(texts, numbers), [], 0
    wanted, of = matching.numbered([bases(p.split()) for p in parts], numbers)
    for k in range(len(parts)):
        left = len(parts) - 1 - k
        end = places.best_end(wanted[of[k] : of[k + 1]], at, len(texts) - left, only_last=not left) if at < len(texts) - left else None
        if end is None:
            return None
        ranges.append((at, end))
        at = end + 1
    return ranges


def match_parts(texts: list[str], parts: list[str]) -> list[tuple[int, int]] | None:
    return match_all([texts], [parts])[0]


def lines_of(words: Words, parts: list[str], text: str) -> list[dict]:
    """A sentence's lines: its parts with the times of their words, or one line where they do not align."""
    ranges = match_parts([w["text"] for w in words], parts)
    if ranges is None:
        ranges, parts = [(0, len(words) - 1)], [text]
    return [{"text": p, "start_ms": words[a]["start_ms"], "end_ms": words[b]["end_ms"]} for p, (a, b) in zip(parts, ranges, strict=True)]


# --- over Arrow batches: a row with a null argument gives null


def _valid(*columns: pa.Array) -> np.ndarray:
    return np.logical_and.reduce([c.is_valid().to_numpy(zero_copy_only=False) for c in columns])


def _rows_back(valid: np.ndarray, values: list, kind: pa.DataType) -> pa.Array:
    out = np.full(len(valid), None, object)
    for at, value in zip(np.flatnonzero(valid).tolist(), values, strict=True):
        out[at] = value
    return pa.array(out.tolist(), kind)


def _lists_back(valid: np.ndarray, sizes: np.ndarray, fields: dict[str, pa.Array]) -> pa.Array:
    """Lists of structs, ``sizes`` long in the valid rows, from their fields in a row."""
    every = np.zeros(len(valid), np.int64)
    every[valid] = sizes
    offsets = np.concatenate([[0], np.cumsum(every)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([*fields.values()], [*fields]), mask=pa.array(~valid))


#: Bytes of text that are aligned together; a longer pair stands alone.
TEXTS_AT_ONCE = 1 << 20


def _slices(left: pa.Array, right: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of rows (null ones count as empty) of about ``TEXTS_AT_ONCE`` bytes, so that memory does not follow the batch."""
    ends = np.cumsum(sum(pc.binary_length(x).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for x in (left, right)))
    at = 0
    while at < len(left):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + TEXTS_AT_ONCE, side="right")))
        yield at, stop
        at = stop


def _of_texts(function: Callable, kind: pa.DataType):
    def part(left: pa.Array, right: pa.Array) -> pa.Array:
        valid = _valid(left, right)
        keep = pa.array(valid)
        return _rows_back(valid, function(left.filter(keep).to_pylist(), right.filter(keep).to_pylist()), kind)

    def over(left: pa.Array, right: pa.Array) -> pa.Array:
        return pa.concat_arrays([pa.array([], kind), *(part(left.slice(a, b - a), right.slice(a, b - a)) for a, b in _slices(left, right))])

    return over


def _words(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """How many words each row has, and their fields in a row."""
    return np.diff(column.offsets.to_numpy()), column.flatten()


def _split_at(values: list, sizes: np.ndarray) -> list[list]:
    stops = np.cumsum(sizes).tolist()
    return [values[a:b] for a, b in zip([0, *stops], stops, strict=False)]


def _carry(words: pa.Array, text: pa.Array) -> pa.Array:
    valid = _valid(words, text)
    sizes, flat = _words(words.filter(pa.array(valid)))
    tokens = [t.split() for t in text.filter(pa.array(valid)).to_pylist()]
    before = _split_at([(t or "").strip() for t in flat.field("text").to_pylist()], sizes)
    start, end = carried(before, *(flat.field(c).fill_null(0).to_numpy(zero_copy_only=False) for c in ("start_ms", "end_ms")), tokens)
    return _lists_back(valid, np.array([*map(len, tokens)], np.int64), {"text": pa.array([t for x in tokens for t in x], pa.string()), "start_ms": pa.array(start), "end_ms": pa.array(end)})


def _cut(words: pa.Array, parts: pa.Array, text: pa.Array) -> pa.Array:
    valid = _valid(words, parts, text)
    keep = pa.array(valid)
    sizes, flat = _words(words.filter(keep))
    wanted, whole = parts.filter(keep).to_pylist(), text.filter(keep).to_pylist()
    ranges = match_all(_split_at([t or "" for t in flat.field("text").to_pylist()], sizes), wanted)
    first = np.cumsum(sizes) - sizes
    lines = [own if found is not None else [line] for own, found, line in zip(wanted, ranges, whole, strict=True)]
    spans = [(at + a, at + b) for found, at, n in zip(ranges, first.tolist(), sizes.tolist(), strict=True) for a, b in (found if found is not None else [(0, n - 1)])]
    low, high = (pa.array([s[i] for s in spans], pa.int64()) for i in (0, 1))
    fields = {"text": pa.array([t for x in lines for t in x], pa.string()), "start_ms": flat.field("start_ms").take(low), "end_ms": flat.field("end_ms").take(high)}
    return _lists_back(valid, np.array([*map(len, lines)], np.int64), fields)


def _operations(before: pa.Array, after: pa.Array) -> pa.Array:
    valid = _valid(before, after)
    old, new = ([t.split() for t in x.filter(pa.array(valid)).to_pylist()] for x in (before, after))
    found = [coalesced(x) for x in _tagged(edits(old, new), len(old))]
    flat = [o for x in found for o in x]
    kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32())
    fields = {c: pa.array([o[i] for o in flat], k) for i, (c, k) in enumerate(zip(("tag", "i1", "i2", "j1", "j2"), kinds, strict=True))}
    return _lists_back(valid, np.array([*map(len, found)], np.int64), fields)


inline_diff_udf = F.arrow_udf(_of_texts(inline_diffs, pa.string()), StringType())
change_log_arrow, carry_times_arrow, lines_arrow = _of_texts(change_logs, pa.string()), _carry, _cut
change_log_udf = F.arrow_udf(change_log_arrow, StringType())
similarity_udf = F.arrow_udf(_of_texts(similarities, pa.float64()), DoubleType())
opcodes_udf = F.arrow_udf(_operations, OPCODES)
carry_times_udf = F.arrow_udf(_carry, SEGMENTS)
lines_udf = F.arrow_udf(_cut, SEGMENTS)

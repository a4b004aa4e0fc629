"""Substring dedup: windows of words that an earlier document has too, found with FM-indexes.

Windows are routed by their minimizers (``routing``), so all occurrences of a window meet in one part.  The
part's distinct fragments, by ascending smallest document, are cut into shards; each shard becomes an
FM-index, and its own and all later fragments are streamed through it by backward search.  Where the
matching statistic reaches the window, the smallest document in the interval has it too; the smallest over
all shards decides.  Only fragments with a minimizer or a whole payload that occurs twice can matter; the
others are not indexed.

Defined results: null text has no words; an id of null is larger than every other, and rows with equal
ids are no smaller than each other; a text shorter than a window is left alone; rows are told apart by
their place, so equal rows get equal results and no row gets another's; an empty table gives an empty
result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from cuespark.llm.fm_index import FmIndex, matching
from cuespark.llm.routing import LAST, MOST_WINDOWS, Hot, Part, Routes, Verdict, fragments, marked

WINDOW, RUN = 13, 3
OUT = "doc_id long, n_words long, n_removed long, kept_text string, kept_sha256 string"


def cutter(window: int):
    def cut(text: bytes, hot: Hot) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
        words = text.split()
        if len(words) < window:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, bool), []
        digest = xxhash.xxh3_64_intdigest
        units = np.fromiter(map(digest, words), np.uint64, len(words))
        first, size, low, again = fragments(units, window, min(RUN, window), MOST_WINDOWS["word"], hot)
        joined = b" ".join(words)
        gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
        begin = np.concatenate([[0], gaps + 1])[first].tolist()
        end = np.append(gaps, len(joined))[first + size + window - 2].tolist()
        return first, low, again, [joined[a:b] for a, b in zip(begin, end, strict=True)]

    return cut


def bounds(number: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The least and the greatest id of each payload's places."""
    least, most = np.full(n, LAST), np.full(n, np.iinfo(np.int64).min)
    np.minimum.at(least, number, value)
    np.maximum.at(most, number, value)
    return least, most


def smallest_documents(texts: list[np.ndarray], least: np.ndarray, window: int, shard_words: int) -> list[np.ndarray]:
    """For each window of each text (word numbers from 1), the smallest of ``least`` over all texts that have it."""
    order = np.argsort(least, kind="stable")
    sizes = np.array([len(texts[i]) for i in order])
    ends = np.cumsum(sizes + 1)
    starts = ends - sizes - 1
    flat = np.zeros(int(ends[-1]), np.int64)
    inside = np.ones(len(flat), bool)
    inside[ends - 1] = False
    flat[inside] = np.concatenate([texts[i] for i in order])
    words = int(flat.max()) + 1
    first = np.full(len(flat), LAST)
    at = 0
    while at < len(order):  # a shard, and everything from it on
        stop = max(at + 1, int(np.searchsorted(ends, starts[at] + shard_words, side="right")))
        index = FmIndex(flat[starts[at] : ends[stop - 1]], window, np.repeat(least[order[at:stop]], sizes[at:stop] + 1), words)
        place, low, high = matching(index, flat, starts[at:], sizes[at:])
        first[place] = np.minimum(first[place], index.least(low, high))
        at = stop
    out: list[np.ndarray] = [first[:0]] * len(order)
    for i, s, n in zip(order.tolist(), starts.tolist(), sizes.tolist(), strict=True):
        out[i] = first[s : s + n - window + 1]
    return out


def solver(window: int, shard_words: int):
    def solve(part: Part) -> Iterator[Verdict]:
        least, most = bounds(part.payload, part.a, len(part.payloads))[0], bounds(part.payload, part.b, len(part.payloads))[1]
        shared = part.shared((np.bincount(part.payload, minlength=len(part.payloads)) > 1) | (least < most))
        if not len(shared):
            return
        numbers: dict[bytes, int] = defaultdict(count(1).__next__)
        texts = [np.fromiter(map(numbers.__getitem__, part.payloads[i].split(b" ")), np.int64) for i in shared]
        firsts = smallest_documents(texts, least[shared], window, shard_words)
        # runs of windows with the same smallest document
        sizes = np.array([len(f) for f in firsts])
        flat, owner, starts = np.concatenate(firsts), np.repeat(np.arange(len(firsts)), sizes), np.cumsum(sizes) - sizes
        begin = np.flatnonzero(np.concatenate([[True], (flat[1:] != flat[:-1]) | (owner[1:] != owner[:-1])]))
        end = np.append(begin[1:], len(flat))
        n_runs = np.bincount(owner[begin], minlength=len(firsts))
        run_start = np.cumsum(n_runs) - n_runs
        slot = np.full(len(part.payloads), -1)
        slot[shared] = np.arange(len(shared))
        entries = np.flatnonzero(slot[part.payload] >= 0)
        for at in range(0, len(entries), 100_000):
            group = entries[at : at + 100_000]
            which = slot[part.payload[group]]
            n = n_runs[which]
            mine = np.repeat(np.arange(len(group)), n)
            run = run_start[which][mine] + np.arange(len(mine)) - np.repeat(np.cumsum(n) - n, n)
            tells = flat[begin[run]] < part.b[group][mine]
            mine, run = mine[tells], run[tells]
            base = starts[which][mine]
            yield Verdict(group[mine], begin[run] - base, end[run] - base, flat[begin[run]])

    return solve


def remove(ids: list[int | None], texts: list[bytes], marks: list[np.ndarray | None]) -> pa.RecordBatch:
    columns: list[list] = [[], [], [], []]
    for text, gone in zip(texts, marks, strict=True):
        words = text.split()
        n = 0 if gone is None else int(gone.sum())
        kept = b" ".join(words if not n else [words[i] for i in np.flatnonzero(~np.append(gone, np.zeros(len(words) - len(gone), bool)))])
        for column, value in zip(columns, (len(words), n, kept.decode(), hashlib.sha256(kept).hexdigest()), strict=True):
            column.append(value)
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], ["doc_id", "n_words", "n_removed", "kept_text", "kept_sha256"])


def drop_repeated_words(docs: DataFrame, window: int = WINDOW, shard_words: int = 1 << 20, routes: Routes | None = None) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_text, kept_sha256`` for every row."""
    return marked(docs, cutter(window), lambda ids: ids, bounds, solver(window, shard_words), window, remove, OUT, routes or Routes())

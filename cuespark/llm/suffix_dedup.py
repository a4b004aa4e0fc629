"""Suffix-array dedup: bytes covered by a long string that starts anywhere else are removed.

Strings of ``length`` bytes are routed by their minimizers (``routing``), so all places of a string meet
in one part.  A part's distinct fragments are put in shards of at most ``shard_bytes``; each shard gets a
suffix array (Larsson-Sadakane) with common prefixes (Kasai).  Strings that are equal within a shard are
neighbours in its array; shards of a part are merged by searching the strings of each in the arrays of
the ones before it.  A string with two places or more, in whatever documents, marks all of them.

Defined results: null text is empty; matches never cross documents and count within one document too;
overlaps count; equal rows are copies of each other, and rows are told apart by their place, so no row
gets another's result; removed bytes may cut a character, so the kept text is bytes; an empty table gives
an empty result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cuespark.llm.routing import MOST_WINDOWS, Hot, Part, Routes, Verdict, fragments, marked, runs
from cuespark.llm.suffix_array import SuffixArray

LENGTH, RUN = 400, 32
OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string"
#: Windows of a long text that are cut at a time; fragments end at these borders, windows do not.
STRIDE = 2 << 20


def cutter(length: int, stride: int = STRIDE):
    run = min(RUN, length)

    def cut(text: bytes, hot: Hot) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
        firsts, lows, agains, payloads = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, bool)], []
        for at in range(0, len(text) - length + 1, stride):
            units = np.frombuffer(text, np.uint8)[at : at + stride + length - 1].astype(np.uint64) + np.uint64(1)
            first, size, low, again = fragments(units, length, run, MOST_WINDOWS["byte"], hot, within=True)
            firsts.append(first + at)
            lows.append(low)
            agains.append(again)
            payloads += [text[a:b] for a, b in zip((first + at).tolist(), (first + at + size + length - 1).tolist(), strict=True)]
        return np.concatenate(firsts), np.concatenate(lows), np.concatenate(agains), payloads

    return cut


def counts(number: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of each payload (twice: the second number is not needed)."""
    places = np.bincount(number, minlength=n)
    return places, places


def repeated_strings(payloads: list[bytes], times: np.ndarray, length: int, shard_bytes: int) -> list[np.ndarray]:
    """For each payload, found ``times`` times, which of its strings have two places or more."""
    cuts, held = [0], 0
    for i, p in enumerate(payloads):
        if held and held + len(p) > shard_bytes:
            cuts.append(i)
            held = 0
        held += len(p)
    cuts.append(len(payloads))
    shards = [SuffixArray(payloads[a:b], length) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    weights = []  # of each class of equal strings of each shard: its places
    for shard, a, b in zip(shards, cuts[:-1], cuts[1:], strict=True):
        owner = np.repeat(np.arange(a, b), shard.sizes + 1)
        weight = np.where(shard.windows(length), times[owner], 0)
        weights.append(np.bincount(shard.classes(length), weight[shard.order]).astype(np.int64))
    own = [w.copy() for w in weights]
    for j in range(1, len(shards)):  # cross-shard: strings of shard j in the arrays before it
        lead = np.flatnonzero(np.diff(shards[j].classes(length), prepend=-1))
        lead = lead[own[j][shards[j].classes(length)[lead]] > 0]
        classes = shards[j].classes(length)[lead]
        for i in range(j):
            place = shards[i].find(shards[j], shards[j].order[lead], length)
            met = place >= 0
            there = shards[i].classes(length)[place[met]]
            np.add.at(weights[j], classes[met], own[i][there])
            np.add.at(weights[i], there, own[j][classes[met]])
    out = []
    for shard, weight in zip(shards, weights, strict=True):
        repeated = np.empty(len(shard.order), bool)
        repeated[shard.order] = weight[shard.classes(length)] > 1
        repeated &= shard.windows(length)
        out += [repeated[s : s + n - length + 1] for s, n in zip(shard.starts.tolist(), shard.sizes.tolist(), strict=True)]
    return out


def solver(length: int, shard_bytes: int):
    def solve(part: Part) -> Iterator[Verdict]:
        times = np.bincount(part.payload, part.a, len(part.payloads)).astype(np.int64)
        shared = part.shared(times > 1)
        if not len(shared):
            return
        flags = repeated_strings([part.payloads[i] for i in shared], times[shared], length, shard_bytes)
        sizes = np.array([len(f) for f in flags])
        flat, starts = np.concatenate(flags), np.cumsum(sizes) - sizes
        first, last = runs(flat, np.repeat(np.arange(len(flags)), sizes))
        owner = np.searchsorted(starts, first, side="right") - 1
        n_runs = np.bincount(owner, minlength=len(flags))
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
            base = starts[which][mine]
            yield Verdict(group[mine], first[run] - base, last[run] + 1 - base, np.full(len(mine), -1))

    return solve


def remove(ids: list[int | None], texts: list[bytes], marks: list[np.ndarray | None]) -> pa.RecordBatch:
    columns: list[list] = [[], [], [], [], []]
    for text, gone in zip(texts, marks, strict=True):
        gone = np.zeros(0, bool) if gone is None else gone
        kept = np.frombuffer(text, np.uint8)[: len(gone)][~gone].tobytes() + text[len(gone) :] if len(gone) else text
        n_spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        for column, value in zip(columns, (len(text), int(gone.sum()), n_spans, kept, hashlib.sha256(kept).hexdigest()), strict=True):
            column.append(value)
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string())
    arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *arrays], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])


def drop_repeated_bytes(docs: DataFrame, length: int = LENGTH, shard_bytes: int = 4 << 20, routes: Routes | None = None) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept, kept_sha256`` for every row."""
    return marked(docs, cutter(length), np.zeros_like, counts, solver(length, shard_bytes), length, remove, OUT, routes or Routes(part_bytes=8 << 20))

"""Bring repeated windows together without comparing shards with shards.

A *window* is W consecutive units (words or bytes) of one document.  Its minimizer, the smallest hash of
the runs of M units inside it, depends on its content alone, so equal windows have equal minimizers.
Neighbouring windows with the same minimizer travel as one *fragment*, to the part that the minimizer
names: every occurrence of a window is in the same part, and each part can be solved by itself.
Expected fragments of random text hold (W - M + 2) / 2 windows.

1. ``chunked``: the rows are packed in chunks of about ``chunk_bytes`` and written once.  From here on a row
   is a place in a chunk, so null ids, repeated ids and equal texts cannot be mistaken for each other.
2. ``hot_runs``: a sample of rows shows which runs are minimizers of many different fragments; these
   come last in the order of runs, so that a popular phrase does not name the part of all the texts
   around it.  The sample settles the order of runs only: any order gives the same windows.
3. Each chunk sends every distinct fragment once, with two numbers that sum up its places (a count, or the
   least and the greatest id): a passage that a third of all documents share is one entry a chunk.
4. Parts are solved; the verdict on a fragment goes back to the chunks that sent it.
5. With the places of its fragments, which each chunk also sent along, its verdicts become spans of rows.

The exchange has at most ``most_parts`` parts.  Where that makes them larger than ``part_bytes``, a part's
task cuts it by further bits of the minimizer, sorts the pieces (Spark's sort spills) and solves one
after the other.  A lost executor recomputes the fragments it held, from the written chunks.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuespark.llm.common import docs_of, raw_texts, stage, text_slices, tidy

#: More windows than this are cut into several fragments (periodic text has the same minimizer throughout).
MOST_WINDOWS = {"word": 64, "byte": 1024}
#: Stands for a null id: larger than every other.
LAST = np.iinfo(np.int64).max
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_HOT = np.uint64(1 << 63)
_NEAR = np.uint64((1 << 20) - 1)


def run_hashes(units: np.ndarray, m: int) -> np.ndarray:
    """A 63-bit hash of every run of ``m`` units, by doubling."""
    if len(units) < m:
        return np.zeros(0, np.uint64)
    out, have, power = None, 0, _MULTIPLIER
    block, size, factor = units, 1, power  # block: hashes of runs of `size` units; factor: multiplier ** size
    left = m
    while left:
        if left & 1:
            n = len(units) - have - size + 1
            out = block[:n].copy() if out is None else out[:n] * factor + block[have : have + n]
            have += size
        left >>= 1
        if left:
            n = len(units) - 2 * size + 1
            block = block[:n] * factor + block[size : size + n]
            size, factor = 2 * size, np.uint64(pow(int(factor), 2, 1 << 64))
    out = (out ^ (out >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (out ^ (out >> np.uint64(29))) >> np.uint64(1)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values, by doubling."""
    size, n = 1, len(values) - width + 1
    if n < 1:
        return values[:0]
    while 2 * size <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    return np.minimum(values[:n], values[width - size : width - size + n])


class Hot:
    """Runs that come last in the order of runs."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.unique(hashes.astype(np.uint64))
        self.near = np.zeros(int(_NEAR) + 1, bool)
        self.near[(self.hashes & _NEAR).astype(np.int64)] = True

    def last(self, hashes: np.ndarray) -> np.ndarray:
        if len(self.hashes):
            at = np.flatnonzero(self.near[(hashes & _NEAR).astype(np.int64)])
            slot = np.minimum(np.searchsorted(self.hashes, hashes[at]), len(self.hashes) - 1)
            hashes[at[self.hashes[slot] == hashes[at]]] |= _HOT
        return hashes


def fragments(units: np.ndarray, window: int, m: int, most: int, hot: Hot, within: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows, minimizer of each fragment of one document's unit hashes; and, for
    ``within``, whether the minimizer stands in the fragment more than once, so that a window may repeat
    inside it (else all false)."""
    hashes, width = hot.last(run_hashes(units, m)), window - m + 1
    low = sliding_min(hashes, width)
    if not len(low):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, bool)
    first = np.concatenate([[0], np.flatnonzero(low[1:] != low[:-1]) + 1])
    size = np.diff(np.append(first, len(low)))
    if size.max() > most:
        pieces = -(-size // most)
        step = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        whole = np.repeat(size, pieces)
        first = np.repeat(first, pieces) + step * most
        size = np.minimum(most, whole - step * most)
    least = low[first]
    again = np.zeros(len(first), bool)
    if within:
        again[:] = [np.count_nonzero(hashes[a : a + n + width - 1] == x) > 1 for a, n, x in zip(first.tolist(), size.tolist(), least, strict=True)]
    return first, size, least, again


# --- chunks


def packed(ids: list[int | None], texts: list[bytes]) -> bytes:
    head = [np.array([len(ids)], "<i8"), np.array([i or 0 for i in ids], "<i8"), np.array([i is None for i in ids], "u1"), np.array([len(t) for t in texts], "<i8")]
    return zstandard.ZstdCompressor(level=3).compress(b"".join([*(x.tobytes() for x in head), *texts]))


def unpacked(pack: bytes) -> tuple[list[int | None], list[bytes]]:
    raw = zstandard.ZstdDecompressor().decompress(pack)
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    ids, nulls, sizes = np.frombuffer(raw, "<i8", n, 8), np.frombuffer(raw, "u1", n, 8 + 8 * n), np.frombuffer(raw, "<i8", n, 8 + 9 * n)
    ends = 8 + 17 * n + np.cumsum(sizes)
    texts = [raw[a:b] for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True)]
    return [None if z else i for i, z in zip(ids.tolist(), nulls.tolist(), strict=True)], texts


def chunked(docs: DataFrame, chunk_bytes: int) -> DataFrame:
    """``chunk, n_bytes, pack``: all rows' ids and texts, written to the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids: list[int | None] = []
        texts: list[bytes] = []
        held = 0

        def full() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([number]), pa.array([held]), pa.array([packed(ids, texts)], pa.binary())], ["chunk", "n_bytes", "pack"])

        for batch in text_slices(batches, 1 << 20):
            ids += batch.column("doc_id").to_pylist()
            texts += raw_texts(batch.column("text"))
            held += batch.column("text").nbytes
            if held >= chunk_bytes:
                yield full()
                number, ids, texts, held = number + 1, [], [], 0
        if ids:
            yield full()

    return stage(docs_of(docs).mapInArrow(tidy(run), "chunk long, n_bytes long, pack binary"))


#: ``cut(text, hot) -> first windows, minimizers, whether they stand there again, payloads``
Cut = Callable[[bytes, Hot], tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]]


class Fragments:
    """The distinct payloads of a chunk, numbered in order of appearance, and all their places."""

    def __init__(self, texts: list[bytes], cut: Cut, hot: Hot):
        known: dict[bytes, int] = {}
        number = known.setdefault
        numbers, starts, lows, agains, sizes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, bool)], []
        for text in texts:
            start, low, again, payloads = cut(text, hot)
            sizes.append(len(start))
            if len(start):
                numbers.append(np.array([number(p, len(known)) for p in payloads], np.int64))
                starts.append(start)
                lows.append(low)
                agains.append(again)
        self.payloads = list(known)
        self.number, self.start = np.concatenate(numbers), np.concatenate(starts)
        self.doc = np.repeat(np.arange(len(texts)), sizes)
        self.low, self.again = np.empty(len(known), np.uint64), np.empty(len(known), bool)
        self.low[self.number], self.again[self.number] = np.concatenate(lows), np.concatenate(agains)  # equal for all places


@dataclass
class Places:
    """Where the payloads of a chunk stand: payload number, first window and row of each place."""

    number: np.ndarray
    start: np.ndarray
    doc: np.ndarray

    @staticmethod
    def of(found: Fragments) -> Places:
        return Places(found.number, found.start, found.doc)

    def packed(self) -> bytes:
        arrays = [np.array([len(self.number)], "<i8"), *(np.diff(x, prepend=0).astype("<i4") for x in (self.number, self.start, self.doc))]
        return zstandard.ZstdCompressor(level=3).compress(b"".join(x.tobytes() for x in arrays))

    @staticmethod
    def unpacked(blob: bytes) -> Places:
        raw = zstandard.ZstdDecompressor().decompress(blob)
        n = int(np.frombuffer(raw, "<i8", 1)[0])
        return Places(*(np.cumsum(np.frombuffer(raw, "<i4", n, 8 + 4 * n * k), dtype=np.int64) for k in range(3)))


# --- what a part receives


def encoded(low: np.ndarray, again: np.ndarray, payloads: list[bytes], entries: tuple[np.ndarray, ...]) -> bytes:
    """Payloads (32 bits of the minimizer, again, bytes) and entries (payload, number, chunk, a, b)."""
    payload, number, chunk, a, b = entries
    arrays = [
        np.array([len(payloads), len(payload)], "<i8"), low.astype("<u4"), again.astype("u1"), np.array([len(p) for p in payloads], "<u4"),
        np.diff(payload, prepend=0).astype("<i4"), np.diff(number, prepend=0).astype("<i4"), chunk.astype("<i8"), a.astype("<i8"), (b - a).astype("<i8"),
    ]
    return zstandard.ZstdCompressor(level=3).compress(b"".join([*(x.tobytes() for x in arrays), *payloads]))


def sent_to(found: Fragments, chunk: int, a: np.ndarray, b: np.ndarray, parts: int) -> tuple[list[int], list[bytes]]:
    """The parts that a chunk's fragments go to, and a blob for each."""
    part_of = (found.low % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part_of, kind="stable")
    names, first = np.unique(part_of[order], return_index=True)
    blobs = []
    for mine in np.split(order, first[1:]):
        entries = np.arange(len(mine)), mine, np.full(len(mine), chunk, np.int64), a[mine], b[mine]
        blobs.append(encoded(found.low[mine] >> np.uint64(32), found.again[mine], [found.payloads[i] for i in mine], entries))
    return names.tolist(), blobs


class Part:
    """All fragments of a part: distinct payloads, and for each chunk that has one an entry."""

    def __init__(self, blobs: list[bytes]):
        known: dict[bytes, int] = {}
        number = known.setdefault
        columns: list[list[np.ndarray]] = [[] for _ in range(5)]
        heads: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for blob in blobs:
            raw = zstandard.ZstdDecompressor().decompress(blob)
            n, k = np.frombuffer(raw, "<i8", 2).tolist()
            at = 16

            def take(kind: str, count: int, raw=raw) -> np.ndarray:
                nonlocal at
                out = np.frombuffer(raw, kind, count, at)
                at += out.nbytes
                return out

            low, again, sizes = take("<u4", n), take("u1", n), take("<u4", n)
            payload, own = np.cumsum(take("<i4", k), dtype=np.int64), np.cumsum(take("<i4", k), dtype=np.int64)
            chunk, a, b = take("<i8", k), take("<i8", k), take("<i8", k)
            ends = at + np.cumsum(sizes, dtype=np.int64)
            numbers = np.array([number(raw[x:y], len(known)) for x, y in zip((ends - sizes).tolist(), ends.tolist(), strict=True)], np.int64)
            heads.append((numbers, low, again))
            for column, values in zip(columns, (numbers[payload], own, chunk, a, a + b), strict=True):
                column.append(values)
        self.payloads = list(known)
        self.minimizers, self.again = np.empty(len(known), np.uint32), np.empty(len(known), bool)
        for numbers, low, again in heads:
            self.minimizers[numbers], self.again[numbers] = low, again
        self.payload, self.number, self.chunk, self.a, self.b = (np.concatenate(c) for c in columns)

    def shared(self, several: np.ndarray) -> np.ndarray:
        """Payloads that can hold a repeated window: those with ``several`` places, with a minimizer that
        another has too, or with one that stands in them more than once."""
        _, group, n = np.unique(self.minimizers, return_inverse=True, return_counts=True)
        return np.flatnonzero(several | (n[group] > 1) | self.again)

    def pieces(self, n: int) -> Iterator[tuple[int, bytes]]:
        """The part cut in ``n`` by further bits of the minimizers."""
        piece = (self.minimizers % np.uint32(n)).astype(np.int64)
        local = np.empty(len(piece), np.int64)
        for k in np.unique(piece).tolist():
            mine, rows = np.flatnonzero(piece == k), np.flatnonzero(piece[self.payload] == k)
            local[mine] = np.arange(len(mine))
            yield k, encoded(self.minimizers[mine], self.again[mine], [self.payloads[i] for i in mine], (local[self.payload[rows]], self.number[rows], self.chunk[rows], self.a[rows], self.b[rows]))


@dataclass
class Verdict:
    """For entries (positions in a part): runs of windows from ``begin`` to ``end`` of the payload, and ``than``."""

    entry: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    than: np.ndarray

    def rows(self, part: Part) -> pa.RecordBatch:
        """One row for each chunk."""
        order = np.argsort(part.chunk[self.entry], kind="stable")
        chunk, number = part.chunk[self.entry][order], part.number[self.entry][order]
        table = np.column_stack([number, self.begin[order], self.end[order], self.than[order]]).astype("<i8")
        first = np.flatnonzero(np.diff(chunk, prepend=chunk[:1] - 1))
        blobs = [table[x:y].tobytes() for x, y in zip(first.tolist(), [*first[1:].tolist(), len(table)], strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(chunk[first]), pa.array(blobs, pa.binary()), pa.nulls(len(blobs), pa.binary())], ["chunk", "verdict", "places"])


# --- the plan


@dataclass
class Routes:
    """Where fragments go; sizes in bytes."""

    chunk_bytes: int = 8 << 20
    part_bytes: int = 12 << 20
    most_parts: int = 8192
    #: One text in so many, by its hash, is in the sample that shows hot runs, of which at most ``most_hot`` are kept.
    share: int = 16
    most_hot: int = 1 << 16


def hot_runs(chunks: DataFrame, cut: Cut, routes: Routes, rounds: int = 2) -> Hot:
    """Runs that are minimizers of so many fragments that these would fill a quarter of a part."""
    hot = Hot(np.zeros(0, np.uint64))
    for _ in range(rounds):
        sent = chunks.sparkSession.sparkContext.broadcast(hot)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for pack in (p for batch in batches for p in batch.column("pack").to_pylist()):
                found = Fragments([t for t in unpacked(pack)[1] if zlib.crc32(t) % routes.share == 0], cut, sent.value)
                run_of, group, n = np.unique(found.low & ~_HOT, return_inverse=True, return_counts=True)
                size = np.bincount(group, [len(p) for p in found.payloads], len(run_of)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(run_of.view(np.int64)), pa.array(size), pa.array(n)], ["run", "size", "n"])

        counted = chunks.select("pack").mapInArrow(tidy(run), "run long, size long, n long").groupBy("run").agg(F.sum("size").alias("size"), F.sum("n").alias("n"))
        rows = counted.where((F.col("size") * routes.share > routes.part_bytes // 4) & (F.col("n") > 8)).orderBy(F.desc("size"), "run").limit(routes.most_hot).toArrow()
        more = Hot(np.concatenate([hot.hashes, rows.column("run").to_numpy().view(np.uint64)])[: routes.most_hot])
        if len(more.hashes) == len(hot.hashes):
            break
        hot = more
    return hot


def marked(
    docs: DataFrame, cut: Cut, values: Callable[[np.ndarray], np.ndarray], reduce: Callable[[np.ndarray, np.ndarray, int], tuple[np.ndarray, np.ndarray]],
    solve: Callable[[Part], Iterator[Verdict]], window: int, remove: Callable[[list, list[bytes], list[np.ndarray | None]], pa.RecordBatch], out: str, routes: Routes,
) -> DataFrame:
    """``remove(ids, texts, marks)`` for all rows, where marks flag the units in spans (None: there are none).

    ``values(ids)``: a number for each row (ids have nulls as ``LAST``); ``reduce(number, value, n)``: two numbers
    that sum up the places of each of ``n`` payloads; a place is in a span if its number is above ``than``.
    """
    spark = docs.sparkSession
    chunks = chunked(docs, routes.chunk_bytes)
    total = 3 * int(chunks.agg(F.sum("n_bytes")).head()[0] or 0)
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(1, min(routes.most_parts, max(least, -(-total // routes.part_bytes))))
    pieces = max(1, -(-total // (routes.part_bytes * parts)))
    hot = spark.sparkContext.broadcast(hot_runs(chunks, cut, routes))

    def numbers_of(ids: list[int | None]) -> np.ndarray:
        return values(np.array([LAST if i is None else i for i in ids], np.int64))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, pack in ((c, p) for batch in batches for c, p in zip(batch.column("chunk").to_pylist(), batch.column("pack").to_pylist(), strict=True)):
            ids, texts = unpacked(pack)
            found = Fragments(texts, cut, hot.value)
            del texts, pack
            if not found.payloads:
                continue
            names, blobs = sent_to(found, chunk, *reduce(found.number, numbers_of(ids)[found.doc], len(found.payloads)), parts)
            # the places go through any part; the row says whose they are
            names, blobs, owner = [*names, chunk % parts], [*blobs, Places.of(found).packed()], [*[None] * len(names), chunk]
            for x in range(0, len(names), 1024):
                columns = ((names, pa.int32()), (owner, pa.int64()), (blobs, pa.binary()))
                yield pa.RecordBatch.from_arrays([pa.array(c[x : x + 1024], kind) for c, kind in columns], ["part", "owner", "blob"])

    def rows_of(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, int | None, bytes]]:
        for batch in batches:
            yield from zip(*(batch.column(c).to_pylist() for c in (key, "owner", "blob")), strict=True)

    def places_of(chunk: int, blob: bytes) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([chunk]), pa.nulls(1, pa.binary()), pa.array([blob], pa.binary())], ["chunk", "verdict", "places"])

    def solved(blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        part = Part(blobs)
        blobs.clear()
        for verdict in solve(part):
            if len(verdict.entry):
                yield verdict.rows(part)

    def receive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole parts, in any order."""
        blobs: dict[int, list[bytes]] = {}
        for part, owner, blob in rows_of(batches, "part"):
            if owner is None:
                blobs.setdefault(part, []).append(blob)
            else:
                yield places_of(owner, blob)
        for part in sorted(blobs):
            yield from solved(blobs.pop(part))

    def divide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A few blobs of a part at a time, cut into pieces."""
        held: list[tuple[int, bytes]] = []

        def rows() -> Iterator[pa.RecordBatch]:
            for part in sorted({p for p, _ in held}):
                for piece, blob in Part([b for p, b in held if p == part]).pieces(pieces):
                    yield row_of(part * pieces + piece, None, blob)

        def row_of(piece: int, owner: int | None, blob: bytes) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([piece]), pa.array([owner], pa.int64()), pa.array([blob], pa.binary())], ["piece", "owner", "blob"])

        size = 0
        for part, owner, blob in rows_of(batches, "part"):
            if owner is not None:
                yield row_of(-1, owner, blob)
                continue
            held.append((part, blob))
            size += len(blob)
            if size > routes.part_bytes:
                yield from rows()
                held, size = [], 0
        yield from rows()

    def in_turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pieces, sorted."""
        now, blobs = -1, []
        for piece, owner, blob in rows_of(batches, "piece"):
            if owner is not None:
                yield places_of(owner, blob)
                continue
            if piece != now and blobs:
                yield from solved(blobs)
                blobs = []
            now = piece
            blobs.append(blob)
        if blobs:
            yield from solved(blobs)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pack, verdicts, places in (row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in ("pack", "verdicts", "places")), strict=True)):
            ids, texts = unpacked(pack)
            marks: list[np.ndarray | None] = [None] * len(ids)
            if verdicts:
                table = np.frombuffer(b"".join(verdicts), "<i8").reshape(-1, 4)
                for doc, flags in spans_of(Places.unpacked(places[0]), numbers_of(ids), table, window):
                    marks[doc] = flags
            size, at = 0, 0
            for stop, text in enumerate(texts, 1):
                size += len(text)
                if size > 4 << 20 or stop == len(texts):
                    yield remove(ids[at:stop], texts[at:stop], marks[at:stop])
                    size, at = 0, stop

    sent = chunks.select("chunk", "pack").mapInArrow(tidy(send), "part int, owner long, blob binary").repartitionById(parts, "part")
    kind = "chunk long, verdict binary, places binary"
    if pieces == 1:
        verdicts = sent.mapInArrow(tidy(receive), kind)
    else:
        verdicts = sent.mapInArrow(tidy(divide), "piece long, owner long, blob binary").sortWithinPartitions("piece").mapInArrow(tidy(in_turn), kind)
    gathered = stage(verdicts).groupBy("chunk").agg(F.collect_list("verdict").alias("verdicts"), F.collect_list("places").alias("places"))
    return chunks.join(gathered, "chunk", "left").select("pack", "verdicts", "places").mapInArrow(tidy(finish), out)


def spans_of(found: Places, values: np.ndarray, table: np.ndarray, window: int) -> Iterator[tuple[int, np.ndarray]]:
    """The row and its flags, for each row with a place that a verdict (number, begin, end, than) is on.

    Flags end with the last flagged unit."""
    table = table[np.argsort(table[:, 0], kind="stable")]
    n_runs = np.bincount(table[:, 0], minlength=int(found.number.max()) + 1)
    run_start = np.cumsum(n_runs) - n_runs
    times = n_runs[found.number]
    place = np.repeat(np.arange(len(times)), times)
    run = run_start[found.number[place]] + np.arange(len(place)) - np.repeat(np.cumsum(times) - times, times)
    above = values[found.doc[place]] > table[run, 3]
    place, run = place[above], run[above]
    doc, begin, end = found.doc[place], found.start[place] + table[run, 1], found.start[place] + table[run, 2] + window - 1
    first = np.flatnonzero(np.diff(doc, prepend=-1))
    for x, y in zip(first.tolist(), [*first[1:].tolist(), len(doc)], strict=True):
        yield int(doc[x]), covered(int(end[x:y].max()), begin[x:y], end[x:y])


def runs(flags: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last position of every run of true flags within one owner."""
    joined = flags[1:] & flags[:-1] & (owner[1:] == owner[:-1])
    first = flags & ~np.concatenate([[False], joined])
    last = flags & ~np.concatenate([joined, [False]])
    return np.flatnonzero(first), np.flatnonzero(last)


def covered(n: int, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of ``n`` units lie in a span."""
    depth = np.zeros(n + 1, np.int64)
    np.add.at(depth, begins, 1)
    np.add.at(depth, ends, -1)
    return np.cumsum(depth[:-1]) > 0

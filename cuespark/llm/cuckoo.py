"""Exact dedup with a cuckoo-filter index of live digests.

A digest is the SHA-256 of a text whose white space runs are single spaces.  Digests are dealt to shards by their first
bits.  A shard's index has

* a cuckoo filter: buckets of four 16-bit fingerprints; a digest may stand in two buckets, the second one found from
  the first and the fingerprint alone, so entries move without their digests;
* beside each fingerprint the number of its stored key: the whole digest, how many live rows have it, and the first
  of these rows.

A fingerprint that matches is a hit only if the stored digest is equal.  When an insertion moves entries too often, or
the filter is filled beyond ``FULL``, the buckets are doubled and filled again from the stored keys.  A digest whose
last row is deleted leaves the filter and its place is used again.  Whole batches are probed and placed with numpy;
only entries that find both buckets full are moved one by one.

``first_of_equal`` indexes a table: rows are counted by digest before they are shuffled (a text that a third of all rows
have is one entry a task), each task builds the indexes of its shards, and rows look up the digests that several rows
have.  Digests of more than 1/1024 of all rows, of which there are 1,024 at most, are broadcast; all others are joined by
shuffle.  ``index_of``, ``changed`` and ``live`` keep an index as a table: rows are added, deleted and asked for later.

Defined results: null text counts as empty; of rows equal in text the smallest id stays, null ids (and the
largest 64-bit number) last; of rows equal in id too, exactly one stays; every row has a result; columns other than the id and the text, whatever their names, are
not read; an empty table gives an empty result.  Deleting a digest that is not live changes nothing; ``first_id`` of a
digest is the smallest id inserted since it became live.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuespark.llm.common import ASCII_SPACE, docs_of, parts_for, stage, tidy

SLOTS, FULL, MOVES = 4, 0.9, 500
LAST = np.iinfo(np.int64).max


def normal(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), ASCII_SPACE + "+", " ")


class CuckooIndex:
    """Digests (rows of four uint64) with counts and first rows, found through a cuckoo filter."""

    def __init__(self, expected: int = 0):
        self.keys = np.zeros((64, 4), np.uint64)
        self.count, self.first, self.row = np.zeros(64, np.int64), np.zeros(64, np.int64), np.zeros(64, np.int64)
        self.used, self.free = 0, np.zeros(0, np.int64)
        self.resized = 0
        self._empty(max(16, 1 << int(expected / (SLOTS * 0.8)).bit_length()))

    def _empty(self, buckets: int) -> None:
        self.prints = np.zeros((buckets, SLOTS), np.uint16)  # 0: free
        self.entry = np.full((buckets, SLOTS), -1, np.int64)

    def __len__(self) -> int:
        return self.used - len(self.free)

    def places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Fingerprint and both buckets of each digest (whose first word has dealt it to the shard)."""
        prints = ((keys[:, 1] & np.uint64(0xFFFF)).astype(np.int64) % 0xFFFF + 1).astype(np.uint16)
        one = (keys[:, 2] & np.uint64(len(self.prints) - 1)).astype(np.int64)
        return prints, one, self.other(one, prints)

    def other(self, bucket: np.ndarray, prints: np.ndarray) -> np.ndarray:
        """The other bucket of an entry, from either one; never the same one."""
        return bucket ^ ((prints.astype(np.int64) * 0x5BD1E995 >> 3 | 1) & (len(self.prints) - 1))

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Stored key of each digest, -1 where it is not live."""
        prints, one, two = self.places(keys)
        out = np.full(len(keys), -1, np.int64)
        for bucket in (one, two):
            hit, slot = np.nonzero(self.prints[bucket] == prints[:, None])
            there = self.entry[bucket[hit], slot]
            same = (self.keys[there] == keys[hit]).all(axis=1)  # a fingerprint alone proves nothing
            out[hit[same]] = there[same]
        return out

    def _store(self, keys: np.ndarray) -> np.ndarray:
        reused = self.free[: len(keys)]
        self.free = self.free[len(reused) :]
        fresh = len(keys) - len(reused)
        while self.used + fresh > len(self.keys):
            grow = len(self.keys)
            self.keys = np.concatenate([self.keys, np.zeros((grow, 4), np.uint64)])
            self.count, self.first, self.row = (np.concatenate([x, np.zeros(grow, np.int64)]) for x in (self.count, self.first, self.row))
        at = np.concatenate([reused, np.arange(self.used, self.used + fresh)])
        self.used += fresh
        self.keys[at] = keys
        self.count[at], self.first[at], self.row[at] = 0, LAST, LAST
        return at

    def _place(self, entries: np.ndarray) -> None:
        """Put stored keys in the filter; resizes it where they do not fit."""
        if len(self) > FULL * self.prints.size:
            return self._resize()
        prints, one, two = self.places(self.keys[entries])
        for turn in range(2):
            if not len(entries):
                return None
            order = np.argsort(two if turn else one, kind="stable")
            entries, prints, one, two = entries[order], prints[order], one[order], two[order]
            bucket = two if turn else one
            begins = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
            nth = np.arange(len(order)) - np.repeat(begins, np.diff(np.append(begins, len(order))))
            # the nth newcomer of a bucket takes its nth free slot
            free = self.prints[bucket] == 0
            fits, slot = np.nonzero((np.cumsum(free, axis=1) == (nth + 1)[:, None]) & free)
            self.prints[bucket[fits], slot], self.entry[bucket[fits], slot] = prints[fits], entries[fits]
            rest = np.ones(len(order), bool)
            rest[fits] = False
            entries, prints, one, two = entries[rest], prints[rest], one[rest], two[rest]
        rng = np.random.default_rng(len(entries))
        for e, f, b in zip(entries.tolist(), prints.tolist(), two.tolist(), strict=True):
            for turn in range(MOVES):
                slots = np.flatnonzero(self.prints[b] == 0)
                if len(slots):
                    self.prints[b, slots[0]], self.entry[b, slots[0]] = f, e
                    break
                s = int(rng.integers(SLOTS))  # the newcomer takes a place, whose entry moves to its other bucket
                f, self.prints[b, s] = int(self.prints[b, s]), f
                e, self.entry[b, s] = int(self.entry[b, s]), e
                b = int(self.other(np.array([b]), np.array([f], np.uint16))[0])
            else:
                return self._resize()
        return None

    def _resize(self) -> None:
        """Twice the buckets, filled from the stored keys."""
        self.resized += 1
        self._empty(2 * len(self.prints))
        live = np.ones(self.used, bool)
        live[self.free] = False
        self._place(np.flatnonzero(live))

    def insert(self, keys: np.ndarray, first: np.ndarray, row: np.ndarray, count: np.ndarray) -> None:
        """Add ``count`` rows of each digest, the first of them ``(first, row)``; digests may repeat."""
        if not len(keys):
            return
        order = np.lexsort((row, first, *keys.T[::-1]))
        keys, first, row, count = keys[order], first[order], row[order], count[order]
        begins = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(axis=1)))
        keys, first, row, count = keys[begins], first[begins], row[begins], np.add.reduceat(count, begins)
        at = self.find(keys)
        new = at < 0
        if new.any():
            at[new] = self._store(keys[new])
            self._place(at[new])
        earlier = (first < self.first[at]) | ((first == self.first[at]) & (row < self.row[at]))
        self.first[at[earlier]], self.row[at[earlier]] = first[earlier], row[earlier]
        self.count[at] += count

    def delete(self, keys: np.ndarray, count: np.ndarray) -> None:
        """Take ``count`` rows of each digest away; a digest without rows is live no more."""
        if not len(keys):
            return
        order = np.lexsort(keys.T[::-1])
        keys, count = keys[order], count[order]
        begins = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(axis=1)))
        keys, count = keys[begins], np.add.reduceat(count, begins)
        at = self.find(keys)
        keys, count, at = keys[at >= 0], count[at >= 0], at[at >= 0]
        self.count[at] -= count
        gone = at[self.count[at] <= 0]
        prints, one, two = self.places(self.keys[gone])
        for bucket in (one, two):
            which, slot = np.nonzero(self.entry[bucket] == gone[:, None])
            self.prints[bucket[which], slot] = 0
            self.entry[bucket[which], slot] = -1
        self.free = np.concatenate([self.free, gone])

    def live(self) -> np.ndarray:
        """Numbers of the stored keys that are live."""
        out = np.ones(self.used, bool)
        out[self.free] = False
        return np.flatnonzero(out)


#: ``row`` tells rows apart that are equal in text and id; a null id stands as ``LAST``.
ENTRIES = "shard int, digest binary, first_id long, row long, n long"


def shard_of(digest: Column, shards: int) -> Column:
    return F.pmod(F.conv(F.substring(F.hex(digest), 1, 8), 16, 10).cast("long"), F.lit(shards)).cast("int")


def words_of(digests: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(digests.to_pylist()), ">u8").astype(np.uint64).reshape(-1, 4)


def entries_of(shard: int, index: CuckooIndex, at_once: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    live = index.live()
    for begin in range(0, len(live), at_once):
        at = live[begin : begin + at_once]
        raw = pa.FixedSizeBinaryArray.from_buffers(pa.binary(32), len(at), [None, pa.py_buffer(index.keys[at].astype(">u8").tobytes())]).cast(pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), shard, np.int32)), raw, pa.array(index.first[at]), pa.array(index.row[at]), pa.array(index.count[at])], ["shard", "digest", "first_id", "row", "n"])


def _indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by shard; ``n`` below zero deletes.  One shard's index is held at a time."""
    shard, index = None, CuckooIndex()
    for batch in batches:
        shards = batch.column("shard").to_numpy()
        cuts = [0, *(np.flatnonzero(shards[1:] != shards[:-1]) + 1).tolist(), len(shards)]
        for x, y in zip(cuts[:-1], cuts[1:], strict=True):
            if x == y:
                continue
            if shards[x] != shard:
                if shard is not None:
                    yield from entries_of(shard, index)
                shard, index = int(shards[x]), CuckooIndex()
            keys = words_of(batch.column("digest").slice(x, y - x))
            first, row, n = (batch.column(c).slice(x, y - x).to_numpy() for c in ("first_id", "row", "n"))
            added = n > 0
            index.insert(keys[added], first[added], row[added], n[added])
            index.delete(keys[~added], -n[~added])
    if shard is not None:
        yield from entries_of(shard, index)


def digests(docs: DataFrame) -> DataFrame:
    """``doc_id, row, digest`` of every row, written once so that ``row`` stays."""
    return stage(docs_of(docs).select("doc_id", F.monotonically_increasing_id().alias("row"), F.unhex(F.sha2(normal(F.col("text")).cast("binary"), 256)).alias("digest")))


def counted(rows: DataFrame) -> DataFrame:
    """``digest, first_id, row, n``: rows by digest, added up in each task before they are shuffled."""
    first = F.coalesce("doc_id", F.lit(LAST))
    return rows.groupBy("digest").agg(F.min(first).alias("first_id"), F.min_by("row", first).alias("row"), F.count(F.lit(1)).alias("n"))


def index_of(rows: DataFrame, shard_rows: int = 1 << 19, least: int | None = None) -> DataFrame:
    """The index of ``digests`` rows as a table of ``ENTRIES``."""
    shards = parts_for(rows.count(), shard_rows, least or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return _built(counted(rows).select(shard_of(F.col("digest"), shards).alias("shard"), "digest", "first_id", "row", "n"), shards)


def _built(entries: DataFrame, shards: int) -> DataFrame:
    spread = entries.repartition(min(shards, 8192), "shard").sortWithinPartitions("shard", F.desc(F.col("n") > 0))
    return stage(spread.mapInArrow(tidy(_indexed), ENTRIES))


def changed(index: DataFrame, shards: int, added: DataFrame | None = None, removed: DataFrame | None = None) -> DataFrame:
    """``index`` (of ``shards`` shards) after ``added`` rows come and then ``removed`` ones go, both of ``digests``."""
    rows = index.select("shard", "digest", "first_id", "row", "n")
    for change, sign in ((added, 1), (removed, -1)):
        if change is not None:
            rows = rows.unionByName(counted(change).select(shard_of(F.col("digest"), shards).alias("shard"), "digest", "first_id", "row", (F.col("n") * sign).alias("n")))
    return _built(rows, shards)


def live(index: DataFrame, rows: DataFrame) -> DataFrame:
    """``doc_id, row, digest, n`` of ``digests`` rows: how many live rows of the index have the digest (0: none)."""
    return rows.join(index.select("digest", "n"), "digest", "left").select("doc_id", "row", "digest", F.coalesce("n", F.lit(0)).alias("n"))


def first_of_equal(docs: DataFrame, **options) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` of every row."""
    rows = digests(docs)
    total = rows.count()
    repeated = index_of(rows, **options).where("n > 1").select("digest", F.struct("first_id", "row", "n").alias("of"))
    hot = F.col("of.n") > total // 1024  # 1,024 digests at most
    known = rows.join(F.broadcast(repeated.where(hot)), "digest", "left")
    cold = known.where("of IS NULL").drop("of").join(repeated.where(~hot), "digest", "left")
    found = known.where("of IS NOT NULL").unionByName(cold)
    keep = F.when(F.col("of").isNull(), F.col("doc_id")).when(F.col("of.first_id") < LAST, F.col("of.first_id"))
    return found.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("of.n", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("of.row") == F.col("row"), F.lit(True)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )

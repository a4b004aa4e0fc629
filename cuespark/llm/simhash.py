"""SimHash near-dedup with deletion-variant signatures.

Fingerprints: XXH64 (seed 42) of each word shingle, repeats included; a bit is 1 if set in over half.

Links at Hamming distance d or less: cut the 64 bits into ``d // 2 + 1`` segments, fewer than the d + 1
that exact segments need; two fingerprints that link then differ by at most one bit in some segment.
Each distinct fingerprint is indexed under all one-wildcard variants of its segments (the segment with
one bit masked out), variants are matched by equality, and the matches are verified on all 64 bits.

Copies meet as one fingerprint before anything is paired.  A set of fingerprints that share a variant is
never expanded into all pairs: the worker that holds it verifies within the set and emits the links of a
spanning forest (at most one link less than members), which has the same components.  Variants that a sample
shows to be crowded are cut by further bits (see ``finer``), so that no task gathers such a set: with d = 2
a cut set has 512 prints at most.  Sets above ``large_set`` members that the sample did not show (and more than
there are ways to flip bits) are not compared with themselves: each print with up to d bits flipped is looked
up among the others (see ``_forest``), so their work grows with the set and not with its square.

Defined results: fewer words than a shingle: the whole sequence is the shingle; no words or null text:
fingerprint 0, linked like any other; null ids never become a component's id unless all of it is null;
repeated rows each get a row; columns other than the id and the text, whatever their names, are not read;
an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuespark.llm.common import docs_of, raw_texts, stage, text_slices, tidy
from cuespark.llm.components import components

SEED, BITS = 42, 64


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(joined, SEED)], np.uint64)
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts = [0, *(gaps[: len(gaps) - width + 1] + 1).tolist()]
    ends = [*gaps[width - 1 :].tolist(), len(joined)]
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends, strict=True)], np.uint64)


def fingerprints(texts: list[bytes], width: int = 3) -> np.ndarray:
    """One unsigned 64-bit fingerprint for each text."""
    out = np.zeros(len(texts), np.uint64)
    for i, text in enumerate(texts):
        n_set, n = np.zeros(BITS, np.int64), 0
        hashes = shingle_hashes(text, width)
        for at in range(0, len(hashes), 1 << 16):
            part = hashes[at : at + (1 << 16)]
            bits = np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            n_set += bits.sum(axis=0, dtype=np.int64)
            n += len(part)
        if n:
            out[i] = np.packbits(2 * n_set > n, bitorder="little").view("<u8")[0]
    return out


def segments(distance: int) -> list[tuple[int, int]]:
    """``(first bit, bits)`` of the ``distance // 2 + 1`` segments."""
    n = distance // 2 + 1
    cuts = [BITS * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def variants(prints: np.ndarray, first: int, bits: int, tag: int = 0) -> np.ndarray:
    """Keys (rows: prints, columns: wildcard positions) of one segment; a key mixes segment, position and bits."""
    part = (prints >> np.uint64(first)) & np.uint64((1 << bits) - 1)
    holes = np.arange(bits, dtype=np.uint64)
    masked = part[:, None] & ~(np.uint64(1) << holes)
    # 57 bits would hold segment bits and position exactly up to 50-bit segments; mixing spreads partitions
    key = masked | (holes << np.uint64(50)) | (np.uint64(tag) << np.uint64(57)) if bits <= 50 else masked * np.uint64(64) + holes
    key = (key ^ (key >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return key ^ (key >> np.uint64(29))


class Forest:
    """Union-find over fingerprints; ``link`` says whether two were apart."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return int(i)

    def roots(self, at: np.ndarray) -> np.ndarray:
        while (self.up[at] != at).any():
            at = self.up[at]
        return at

    def link(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)
        return i != j

    def links(self, a: np.ndarray, b: np.ndarray) -> Iterator[tuple[int, int]]:
        """The pairs that join what was apart."""
        apart = self.roots(a) != self.roots(b)
        for i, j in zip(a[apart].tolist(), b[apart].tolist(), strict=True):
            if self.link(i, j):
                yield i, j


def _forest(prints: np.ndarray, distance: int, large_set: int) -> Iterator[tuple[int, int]]:
    """Links (positions in ``prints``, which are distinct and ascending) of a spanning forest of the pairs at
    ``distance`` or less."""
    n = len(prints)
    forest = Forest(n)
    flips = sum(comb(BITS, size) for size in range(1, distance + 1))
    if n <= large_set or n <= flips:  # in blocks of rows against all later ones
        step = max(1, (1 << 20) // n)
        for at in range(0, n, step):
            apart = np.bitwise_count(prints[at : at + step, None] ^ prints[None, at:]) <= distance
            a, b = np.nonzero(np.triu(apart, 1))
            yield from forest.links(at + a, at + b)
        return
    for size in range(1, distance + 1):
        for bits in combinations(range(BITS), size):
            flipped = prints ^ np.uint64(sum(1 << b for b in bits))
            at = np.minimum(np.searchsorted(prints, flipped), n - 1)
            met = np.flatnonzero((prints[at] == flipped) & (at > np.arange(n)))
            yield from forest.links(met, at[met])


#: Pieces that the bits outside a segment are cut into where a variant is crowded.
PIECES = 8


def finer(prints: np.ndarray, keys: np.ndarray, first: int, bits: int, distance: int) -> np.ndarray:
    """Keys (rows: prints, columns: choices of pieces) within sets of equal ``keys``: the bits outside the segment are cut
    into pieces, of which two prints differ in ``distance`` at most, so in some choice all others are equal.  A set then
    holds no more prints than the pieces left out have values, times the two of the wildcard."""
    outside = [b for b in range(BITS) if not first <= b < first + bits]
    cuts = [len(outside) * i // PIECES for i in range(PIECES + 1)]
    masks = [sum(1 << b for b in outside[a:z]) for a, z in zip(cuts[:-1], cuts[1:], strict=True)]
    choices = list(combinations(range(PIECES), min(distance, PIECES)))
    out = np.empty((len(prints), len(choices)), np.uint64)
    for n, left_out in enumerate(choices):
        kept = np.uint64(sum(m for i, m in enumerate(masks) if i not in left_out))
        mixed = ((prints & kept) ^ (keys + np.uint64(n + 1))) * np.uint64(0x9E3779B97F4A7C15)
        out[:, n] = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93) ^ keys
    return out


def _keys(distance: int, crowded=None):
    """``key, print`` rows; for a key that ``crowded`` holds its ``finer`` ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = np.zeros(0, np.uint64) if crowded is None else crowded.value
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                prints = batch.column("print").slice(at, 4096).to_numpy().view(np.uint64)
                for tag, (first, bits) in enumerate(segments(distance)):
                    keys = variants(prints, first, bits, tag)
                    row, column = np.nonzero(np.isin(keys, hot)) if len(hot) else (np.zeros(0, np.int64),) * 2
                    plain = np.ones(keys.shape, bool)
                    plain[row, column] = False
                    yield _pairs(keys[plain], np.broadcast_to(prints[:, None], keys.shape)[plain])
                    for begin in range(0, len(row), 4096):
                        some = row[begin : begin + 4096]
                        split = finer(prints[some], keys[some, column[begin : begin + 4096]], first, bits, distance)
                        yield _pairs(split.ravel(), np.repeat(prints[some], split.shape[1]))

    return run


def _pairs(keys: np.ndarray, prints: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(prints.copy().view(np.int64))], ["key", "print"])


def crowded_keys(prints: DataFrame, distance: int, most: int, share: int = 16, limit: int = 1 << 20) -> np.ndarray:
    """Variants that ``most`` prints or more have, by the ``share``-th part of the prints.  This settles how sets are cut, not
    which prints meet; should there be more than ``limit``, the largest are given, and other sets are solved whole."""
    sample = prints.where(F.pmod(F.xxhash64("print"), F.lit(share)) == 0).select("print").mapInArrow(tidy(_keys(distance)), "key long, print long")
    found = sample.groupBy("key").count().where(F.col("count") * share >= most).orderBy(F.desc("count"), "key").limit(limit).select("key").toArrow()
    return np.sort(found.column("key").to_numpy().view(np.uint64))


def _links(distance: int, large_set: int):
    """Rows sorted by key: sets are cut at key changes; a set may span batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_keys, held = np.zeros(0, np.int64), np.zeros(0, np.uint64)

        def solve(keys: np.ndarray, prints: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
            found = []
            starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            sizes = np.diff(np.append(starts, len(keys)))
            pair = starts[sizes == 2]  # most sets: one vectorised check
            near = np.bitwise_count(prints[pair] ^ prints[pair + 1]) <= distance
            found.append((prints[pair][near], prints[pair + 1][near]))
            for s, k in zip(starts[sizes > 2], sizes[sizes > 2], strict=True):
                members = np.unique(prints[s : s + k])
                links = list(_forest(members, distance, large_set))
                if links:
                    a, b = np.array(links).T
                    found.append((members[a], members[b]))
            return found

        def rows(found):
            a, b = np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])
            both = np.unique(np.column_stack([a, b]), axis=0) if len(a) else np.zeros((0, 2), np.uint64)
            return pa.RecordBatch.from_arrays([pa.array(both[:, 0].copy().view(np.int64)), pa.array(both[:, 1].copy().view(np.int64))], ["a", "b"])

        for batch in batches:
            keys = np.concatenate([held_keys, batch.column("key").to_numpy()])
            prints = np.concatenate([held, batch.column("print").to_numpy().view(np.uint64)])
            if not len(keys):
                continue
            cut = int(np.searchsorted(keys, keys[-1], side="left"))  # the last set may go on
            if cut:
                yield rows(solve(keys[:cut], prints[:cut]))
            held_keys, held = keys[cut:], prints[cut:]
        if len(held):
            yield rows(solve(held_keys, held))

    return run


def links(prints: DataFrame, distance: int = 2, large_set: int = 1 << 15, most: int = 1 << 13) -> DataFrame:
    """``prints(print)``, distinct -> ``a, b``: links whose components are those of all pairs at ``distance``.

    Sets of ``most`` prints or more that share a variant are cut again by further bits (``finer``)."""
    spark = prints.sparkSession
    sent = spark.sparkContext.broadcast(crowded_keys(prints, distance, most))
    keyed = prints.select("print").mapInArrow(tidy(_keys(distance, sent)), "key long, print long")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    met = keyed.repartition(n, "key").sortWithinPartitions("key")
    return met.mapInArrow(tidy(_links(distance, large_set)), "a long, b long").distinct()


def with_fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """``doc_id, print`` (the fingerprint as a signed long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            prints = fingerprints(raw_texts(batch.column("text")), width)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints.view(np.int64))], ["doc_id", "print"])

    return docs_of(docs).mapInArrow(tidy(run), "doc_id long, print long")


def near_duplicates(docs: DataFrame, width: int = 3, distance: int = 2) -> DataFrame:
    """``doc_id, fingerprint, component_id``: one row for each input row."""
    prints = stage(with_fingerprints(docs, width))
    distinct = stage(prints.groupBy("print").agg(F.min("doc_id").alias("first_id")))
    joined = components(links(distinct, distance))
    member = distinct.join(joined.withColumnRenamed("node", "print"), "print", "left").select("print", F.coalesce("label", "print").alias("label"), "first_id")
    smallest = member.groupBy("label").agg(F.min("first_id").alias("component_id"))
    classes = member.join(smallest, "label").select("print", "component_id")
    hexed = F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint")
    return prints.join(classes, "print").select("doc_id", hexed, "component_id")


def text_links(docs: DataFrame, width: int = 3, distance: int = 2) -> DataFrame:
    """``docs(doc_id, text)``, no null text -> ``a, b``: text keys (``xxhash64``) whose components are those of all texts
    with fingerprints at ``distance``."""
    prints = stage(with_fingerprints(docs.select(F.xxhash64("text").alias("doc_id"), "text"), width).distinct())
    first = stage(prints.groupBy("print").agg(F.min("doc_id").alias("first")))
    same = prints.join(first, "print").where("doc_id <> first").select(F.col("doc_id").alias("a"), F.col("first").alias("b"))
    near = links(first, distance).join(first.toDF("a", "ka"), "a").join(first.toDF("b", "kb"), "b")
    return same.union(near.select("ka", "kb"))

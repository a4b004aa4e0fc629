"""Near-duplicate texts by exact shingle similarity; one document a group stays.

Similar: Jaccard similarity of the sets of ``width``-word shingles, lower-cased, of ``similarity`` or more.
``groups`` finds the components of *all* similar pairs, by prefix filtering: whatever the order of shingles,
the sets of a similar pair share one among the first ``n - ceil(similarity * n) + 1`` of each.  Two sets whose
first common shingle stands too late, or whose sizes differ too much, cannot be similar; no other pair is
dropped before its sets are compared.

1. Keys: each text's prefix in the order of hashes, after them the shingles that a sample of texts shows to be
   common (the sample settles this order and which keys are not sent).  Sets of texts that share a key are expanded
   into pairs up to ``most`` members.  Texts of larger sets are crowded, and so are those with a common shingle in
   their prefix: all texts with that key are, so it need not be sent and no task gathers it.
2. Crowded texts are indexed again among themselves, rare shingles first by exact counts, so that shared passages
   fall out of the prefixes.
3. A pair whose sketches (one parity bit for each residue of the shingles) differ in more bits than a similar pair's
   sets can differ in shingles is dropped: an upper bound, so none too few. Only what passes has its sets compared.
4. Sets that are still larger, by counts taken before they meet, consist of texts that are made of common
   shingles, near copies mostly.  They are joined by their key, not gathered; those that overlap are one family,
   which one worker compares (see ``family_links``) without expanding it into pairs.

Defined results: null and empty texts are copies of each other; texts without words are similar; fewer words
than a shingle: the whole sequence is the one shingle; of a group the smallest id stays (null ids last; ties by
text hash), and of repeated rows one; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuespark.llm.common import discard, raw_texts, stage, text_slices, tidy
from cuespark.llm.components import components
from cuespark.llm.simhash import shingle_hashes

#: Slack against rounding of products with the similarity: keeps a pair too many, never one too few.
SLACK = 1e-9
KEYS = "key long, node long, n int, at int, sketch binary, crowded boolean"
MET = "a long, b long, large boolean, n int, sketch binary"


def text_key(text: bytes) -> int:
    """Spark's ``xxhash64(text)``, a signed number."""
    value = xxhash.xxh64_intdigest(text, 42)
    return value - (1 << 64) if value >= 1 << 63 else value


def shingle_set(text: bytes, width: int) -> np.ndarray:
    """Distinct shingle hashes in ascending order; a text without words has the one shingle 0."""
    found = np.unique(shingle_hashes(text, width))
    return found if len(found) else np.zeros(1, np.uint64)


def prefix_length(n: int, similarity: float) -> int:
    return n - math.ceil(similarity * n - SLACK) + 1


def common_shingles(docs: DataFrame, width: int, share: int = 8, least: int = 4, limit: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that ``least`` or more of every ``share``-th text hold, ascending, and how many do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            sets = [shingle_set(t, width) for t in {*raw_texts(batch.column("text"))}]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64))], ["key"])

    sample = docs.where(F.pmod(F.xxhash64("text"), F.lit(share)) == 0).select("text").mapInArrow(tidy(run), "key long")
    rows = sample.groupBy("key").agg(F.count("*").alias("texts")).where(F.col("texts") >= least).orderBy(F.desc("texts"), "key").limit(limit).toArrow()
    keys, texts = rows.column("key").to_numpy().view(np.uint64), rows.column("texts").to_numpy()
    order = np.argsort(keys)
    return keys[order], texts[order]


def ordered(shingles: np.ndarray, common: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Ascending shingles by the order (texts of the sample that hold it if it is common, hash)."""
    if not len(common):
        return shingles
    at = np.minimum(np.searchsorted(common, shingles), len(common) - 1)
    rank = np.where(common[at] == shingles, texts[at], 0)
    return shingles[np.argsort(rank, kind="stable")] if rank.any() else shingles


def _keys(width: int, similarity: float, sent):
    """Rows for the keys of each text, and one with ``at`` -1 for the text itself: its sketch, whether it is crowded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # copies in one task give their keys once
        common = sent.value[0]
        for batch in text_slices(batches, 1 << 20):
            keys, places, nodes, sizes, sketches, crowded = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [], [], [], []
            for text in raw_texts(batch.column("text")):
                node = text_key(text)
                if node in seen:
                    continue
                seen.add(node)
                shingles = shingle_set(text, width)
                prefix = ordered(shingles, *sent.value)[: prefix_length(len(shingles), similarity)]
                hot = np.zeros(len(prefix), bool)
                if len(common):
                    hot = common[np.minimum(np.searchsorted(common, prefix), len(common) - 1)] == prefix
                keys.append(prefix[~hot])
                places.append(np.flatnonzero(~hot))
                nodes.append(node)
                sizes.append(len(shingles))
                sketches.append(sketch(shingles))
                crowded.append(bool(hot.any()))
            if not nodes:
                continue
            own, n = np.array(nodes, np.int64), np.array(sizes, np.int32)
            counts = [len(k) for k in keys[1:]]
            columns = [np.concatenate(keys).view(np.int64), np.repeat(own, counts), np.repeat(n, counts), np.concatenate(places).astype(np.int32)]
            names = ["key", "node", "n", "at", "sketch", "crowded"]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.nulls(len(columns[0]), pa.binary()), pa.nulls(len(columns[0]), pa.bool_())], names)
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(own), pa.array(n), pa.array(np.full(len(own), -1, np.int32)), pa.array(sketches, pa.binary()), pa.array(crowded)], names)

    return run


def sketch(shingles: np.ndarray) -> bytes:
    """Parities of the numbers of shingles in each residue class; as many classes as shingles, a power of two."""
    size = max(64, 1 << (len(shingles) - 1).bit_length())
    return np.packbits(np.bincount((shingles & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1).tobytes()


def most_common(n: np.ndarray, m: np.ndarray, left: list[bytes], right: list[bytes]) -> np.ndarray:
    """At most so many shingles are in both sets of each pair: each parity that differs is a shingle in one only."""
    out = np.empty(len(n), np.int64)
    for i, (a, b) in enumerate(zip(left, right, strict=True)):
        x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
        while len(x) > len(y):
            x = x[: len(x) // 2] ^ x[len(x) // 2 :]
        while len(y) > len(x):
            y = y[: len(y) // 2] ^ y[len(y) // 2 :]
        out[i] = (n[i] + m[i] - int(np.bitwise_count(x ^ y).sum())) // 2
    return out


def _met(similarity: float, most: int):
    """Rows sorted by key and node -> the pairs of each set of equal keys that can be similar; of sets above
    ``most`` members, each member with the first (``large``); and of each text (``a``) its sketch, with ``large`` if it
    is crowded.  A set may span batches; of a large one only the first member is held."""
    names = ("key", "node", "n", "at")

    def rows(a: np.ndarray | pa.Array, b=None, large=None, n=None, sketches=None) -> pa.RecordBatch:
        columns = ((b, pa.int64()), (large, pa.bool_()), (n, pa.int32()), (sketches, pa.binary()))
        return pa.RecordBatch.from_arrays([pa.array(a), *(pa.nulls(len(a), kind) if x is None else pa.array(x) for x, kind in columns)], ["a", "b", "large", "n", "sketch"])

    def solve(key: np.ndarray, node: np.ndarray, n: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
        n, at = n.astype(np.int64), at.astype(np.int64)
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        sizes = np.diff(np.append(starts, len(key)))
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for size in np.unique(sizes[(sizes > 1) & (sizes <= most)]):
            i, j = np.triu_indices(size, 1)
            first = starts[sizes == size][:, None]
            x, y = (first + i).ravel(), (first + j).ravel()
            need = similarity / (1 + similarity) * (n[x] + n[y]) - SLACK
            fits = (np.minimum(n[x], n[y]) >= similarity * np.maximum(n[x], n[y]) - SLACK) & (np.minimum(n[x] - at[x], n[y] - at[y]) >= need)
            left.append(node[x[fits]])
            right.append(node[y[fits]])
        pairs = np.unique(np.column_stack([np.concatenate(left), np.concatenate(right)]), axis=0)
        large = np.repeat(sizes > most, sizes)
        stars = np.unique(np.column_stack([np.repeat(node[starts], sizes)[large], node[large]]), axis=0)
        both = np.concatenate([pairs, stars])
        return rows(both[:, 0].copy(), both[:, 1].copy(), np.arange(len(both)) >= len(pairs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, kind) for kind in (np.int64, np.int64, np.int32, np.int32)]  # the last set so far
        hub: tuple[int, int] | None = None  # key and first member of a set that is known to be large
        for batch in batches:
            own = batch.filter(batch.column("sketch").is_valid())
            if own.num_rows:
                yield rows(own.column("node"), large=own.column("crowded"), n=own.column("n"), sketches=own.column("sketch"))
                batch = batch.filter(batch.column("sketch").is_null())
            if not batch.num_rows:
                continue
            part = [np.concatenate([h, batch.column(c).to_numpy()]) for h, c in zip(held, names, strict=True)]
            part = [c[np.concatenate([[True], (part[0][1:] != part[0][:-1]) | (part[1][1:] != part[1][:-1])])] for c in part]
            if hub is not None:
                mine = part[0] == hub[0]
                if mine.any():
                    yield rows(np.full(mine.sum(), hub[1]), part[1][mine], np.full(mine.sum(), True))
                part = [c[~mine] for c in part]
            if not len(part[0]):
                held = part
                continue
            cut = int(np.searchsorted(part[0], part[0][-1], side="left"))
            if len(part[0]) - cut > most:
                hub, cut = (int(part[0][-1]), int(part[1][cut])), len(part[0])
            if cut:
                yield solve(*[c[:cut] for c in part])
            held = [c[cut:] for c in part]
        if len(held[0]):
            yield solve(*held)

    return run


def met(keys: DataFrame, similarity: float, most: int) -> DataFrame:
    """The rows of ``_met`` (a pair may come several times)."""
    n = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = keys.repartition(n, "key").sortWithinPartitions("key", "node")
    return stage(rows.mapInArrow(tidy(_met(similarity, most)), MET))


def _possible(similarity: float):
    """``a, b, n, m, left, right`` -> the pairs that can be similar by their sketches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = (batch.column(c).to_numpy().astype(np.int64) for c in ("n", "m"))
            able = most_common(n, m, batch.column("left").to_pylist(), batch.column("right").to_pylist()) >= similarity / (1 + similarity) * (n + m) - SLACK
            yield batch.select(["a", "b"]).filter(pa.array(able))

    return run


def rare_first(sets: DataFrame, similarity: float) -> DataFrame:
    """``sets(node, shingles)`` -> keys by the order (texts that hold the shingle, hash); those of one text meet
    nobody and are only counted."""
    single = sets.select("node", F.size("shingles").alias("n"), F.explode("shingles").alias("key"))
    shared = single.groupBy("key").agg(F.count("*").alias("texts")).where("texts > 1")
    listed = single.join(shared, "key").groupBy("node", "n").agg(F.array_sort(F.collect_list(F.struct("texts", "key"))).alias("s"))
    alone = F.col("n") - F.size("s")
    length = F.col("n") - F.ceil(F.lit(similarity) * F.col("n") - F.lit(SLACK)) + 1 - alone
    prefix = listed.where(length > 0).select("node", "n", alone.alias("alone"), F.posexplode(F.slice("s", F.lit(1), length.cast("int"))).alias("i", "k"))
    return prefix.select("k.key", "node", "n", (F.col("alone") + F.col("i")).alias("at"), F.lit(None).cast("binary").alias("sketch"), F.lit(None).cast("boolean").alias("crowded"))


def family_links(sets: list[np.ndarray], similarity: float, probes: int = 16) -> list[tuple[int, int]]:
    """Similar pairs (positions) whose components are those of all similar pairs of ``sets``.

    A comparison is of one set with all others, those outside the component of ``seed`` each get one; what is
    in that component is connected already.  Time: the sets outside of it, times all shingles.
    """
    sizes = np.array([len(s) for s in sets])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    names, ids = np.unique(np.concatenate(sets), return_inverse=True)
    mark = np.zeros(len(names), np.int64)

    def similar(x: int) -> np.ndarray:
        own = ids[starts[x] : starts[x] + sizes[x]]
        mark[own] = 1
        common = np.add.reduceat(mark[ids], starts)
        mark[own] = 0
        return common >= similarity * (sizes + sizes[x] - common)

    label, links = np.arange(len(sets)), []
    probed = {int(x): similar(int(x)) for x in np.unique(np.linspace(0, len(sets) - 1, probes).astype(np.int64))}
    seed = max(probed, key=lambda x: (int(probed[x].sum()), -x))
    for x in [seed, *range(len(sets))]:
        if x != seed and label[x] == label[seed]:
            continue
        found = np.flatnonzero(probed[x] if x in probed else similar(x))
        labels, first = np.unique(label[found], return_index=True)
        links += [(x, int(y)) for y in found[first[labels != label[x]]]]
        label[np.isin(label, labels)] = label[x]
    return links


def _families(width: int, similarity: float):
    """Rows sorted by family -> the links of each; memory follows the shingles of the largest family."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family, held = None, {}

        def solve() -> pa.RecordBatch:
            nodes = np.array(list(held), np.int64)
            a, b = np.array(family_links(list(held.values()), similarity), np.int64).reshape(-1, 2).T
            return pa.RecordBatch.from_arrays([pa.array(nodes[a]), pa.array(nodes[b])], ["a", "b"])

        for batch in text_slices(batches, 1 << 20):
            for label, node, text in zip(batch.column("label").to_pylist(), batch.column("node").to_pylist(), raw_texts(batch.column("text")), strict=True):
                if label != family and held:
                    yield solve()
                    held = {}
                family = label
                held[node] = shingle_set(text, width)
        if held:
            yield solve()

    return run


def _shingles(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, 1 << 20):
            sets = [shingle_set(t, width).view(np.int64) for t in raw_texts(batch.column("text"))]
            offsets = np.cumsum([0, *map(len, sets)], dtype=np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.ListArray.from_arrays(offsets, np.concatenate(sets))], ["node", "shingles"])

    return run


def similar_links(docs: DataFrame, similarity: float = 0.8, width: int = 5, most: int = 32, broadcast_nodes: int = 1 << 20) -> DataFrame:
    """``docs(doc_id, text)``, no null text -> ``a, b``: text keys of similar texts, with the components of all such pairs."""
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tables: list[DataFrame] = []
    first = stage(docs.groupBy(F.xxhash64("text").alias("node")).agg(F.min("doc_id").alias("first_id")))

    def texts(nodes: DataFrame) -> DataFrame:
        """One row for each node; the nodes go to the texts while they are few, else both are shuffled."""
        wanted = stage(nodes.join(first, "node"))
        tables.append(wanted)
        one = docs.withColumn("node", F.xxhash64("text")).join(F.broadcast(wanted) if wanted.count() <= broadcast_nodes else wanted, "node")
        return one.where(F.col("doc_id").eqNullSafe(F.col("first_id"))).drop("doc_id", "first_id")

    def sets(nodes: DataFrame) -> DataFrame:
        return texts(nodes).mapInArrow(tidy(_shingles(width)), "node long, shingles array<long>").groupBy("node").agg(F.first("shingles").alias("shingles"))

    def ends(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()

    sent = spark.sparkContext.broadcast(common_shingles(docs, width))
    found = met(docs.select("text").mapInArrow(tidy(_keys(width, similarity, sent)), KEYS), similarity, most)
    met_pairs = found.where("sketch IS NULL")
    pairs, links = met_pairs.where("NOT large").select("a", "b"), None
    crowded = ends(met_pairs.where("large")).union(found.where("sketch IS NOT NULL AND large").select(F.col("a").alias("node"))).distinct()
    if not crowded.isEmpty():
        few = stage(sets(crowded))
        keys = stage(rare_first(few, similarity))
        sizes = keys.groupBy("key").count()
        sized = stage(keys.join(sizes, "key"))
        again = met(sized.where(F.col("count") <= most).drop("count"), similarity, most)
        tables += [few, keys, sized, again]
        pairs = pairs.union(again.select("a", "b"))
        # a large set is joined through its key, which stands for it like one more text
        families = sized.where(F.col("count") > most).select(F.col("key").alias("a"), F.col("node").alias("b")).distinct()
        if not families.isEmpty():
            members = texts(components(families)).repartition(n, "label").sortWithinPartitions("label")
            links = members.select("label", "node", "text").mapInArrow(tidy(_families(width, similarity)), "a long, b long")
    known = found.where("sketch IS NOT NULL").select(F.col("a").alias("node"), "n", "sketch").dropDuplicates(["node"])
    left, right = known.toDF("a", "n", "left"), known.toDF("b", "m", "right")
    able = stage(pairs.distinct().join(left, "a").join(right, "b").select("a", "b", "n", "m", "left", "right").mapInArrow(tidy(_possible(similarity)), "a long, b long"))
    links = None if links is None else stage(links)
    known = stage(sets(ends(able)))
    both = able.join(known.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a").join(known.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    verified = stage(both.where(common >= F.lit(similarity) * (F.size("sa") + F.size("sb") - common)).select("a", "b"))
    discard(first, found, known, able, *tables)
    return verified if links is None else verified.union(links)


def groups(docs: DataFrame, similarity: float = 0.8, width: int = 5, linked: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``doc_id, text_key, label``: rows with the same label are near duplicates of each other, by similarity or by the links
    between text keys that ``linked`` gives."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    links = similar_links(slim, similarity, width)
    labels = components(links if linked is None else linked(slim).union(links)).withColumnRenamed("node", "text_key")
    return slim.select("doc_id", F.xxhash64("text").alias("text_key")).join(labels, "text_key", "left").select("doc_id", "text_key", F.coalesce("label", "text_key").alias("label"))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_key")
    winners = groups(docs, **options).groupBy("label").agg(F.min(order).alias("w")).select(F.struct(F.col("w.doc_id").alias("id"), F.col("w.text_key").alias("key")).alias("k"))
    key = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    # one key column, whose nulls are equal: the rows are shuffled once for the join and for repeated rows
    keyed = docs.select(F.struct("*").alias("row"), F.struct(F.col("doc_id").cast("long").alias("id"), key.alias("key")).alias("k"))
    return keyed.join(winners, "k", "left_semi").dropDuplicates(["k"]).select("row.*")

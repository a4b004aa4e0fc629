"""Hard-negative mining by branch and bound over ball trees.

Vectors become integers (``floor(256 x)``), so products are exact.  The index is a table of blocks of at most
``BLOCK`` rows, each with a ball tree over its rows: nodes are halves of their parent along its widest component, and
know a centre, a radius, their smallest id and which labels they may hold.  Rows are dealt to blocks in the order of
(label, first component), so most blocks hold one label.

For a query q and a node with centre c and radius r all products lie in ``q.c -+ |q| r``.  A search asks for the ``k``
first rows (higher products first, ties by smaller id) whose product lies in a window and whose label is the query's,
or is not; a node is passed over if

* its upper bound is below the window, or its lower bound above it;
* the best it may hold is strictly beneath the query's k-th row so far, or equal to it with no smaller id;
* no row of it has a fitting label.

Anchors come in blocks of a bounded size, broadcast one after the other; every task searches its trees for all of
them and hands on ``k`` rows a query.  One search finds the positives, a second one, whose windows follow from their
products, the negatives.  Positives of an anchor with equal products share one search.

Defined results: rows with a null id, label or vector, or any null or non-finite component take no part; a shorter
vector counts as filled up with zeros; rows with the anchor's id are none of its positives; repeated rows are rows of
their own, as anchors too; products beyond 64 bits stand as the nearest number that fits; positives with a product
below zero have an empty window; an empty table gives an empty result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cuespark.llm.common import discard, parts_for, shared_dir, small_batches, stage, tidy

BLOCK, LEAF = 8192, 64
NONE = -(2**63 - 1)  # below any product
MOST = 2**63 - 2
NO_ID = 2**63 - 1
OUT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def usable(rows: DataFrame) -> DataFrame:
    """``vec_id, label, v`` (integers) of the rows that take part."""
    small_batches(rows.sparkSession)
    vec_id, label = F.col("vec_id").cast("long"), F.col("label").cast("long")
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    found = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~bad)
    moved = F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label)
    return found.select(vec_id.alias("vec_id"), moved.alias("label"), F.transform("embedding", lambda x: F.floor(x.cast("double") * 256)).alias("v"))


def matrix_of(column: pa.Array) -> np.ndarray:
    """Lists of integers as rows, filled up with zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), max(1, sizes.max(initial=0))), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def products(q: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact products (queries, rows), held within 64 bits."""
    d = min(q.shape[1], rows.shape[1])
    q, rows = q[:, :d], rows[:, :d]
    high = float(np.abs(q.astype(np.float64)).max(initial=0)) * float(np.abs(rows.astype(np.float64)).max(initial=0)) * d
    if high < 2**53:
        return (q.astype(np.float64) @ rows.astype(np.float64).T).astype(np.int64)
    if high < 2**62:
        return q @ rows.T
    exact = q.astype(object) @ rows.astype(object).T
    return np.clip(exact, NONE + 1, MOST).astype(np.int64)


class BallTree:
    """Rows in the order of a complete binary tree's leaves; node ``i`` has the children ``2 i + 1`` and ``2 i + 2``."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray, leaf: int = LEAF):
        n, points = len(ids), rows.astype(np.float64)
        depth = 0
        while n > leaf << depth:
            depth += 1
        order, self.begin, self.end = np.arange(n), [0], [n]
        for node in range((1 << depth) - 1):
            begin, end = self.begin[node], self.end[node]
            own, half = order[begin:end], (end - begin) // 2
            part = points[own]
            widest = int((part.max(axis=0) - part.min(axis=0)).argmax())
            order[begin:end] = own[np.argpartition(part[:, widest], half)]
            self.begin += [begin, begin + half]
            self.end += [begin + half, end]
        self.ids, self.labels, self.rows = ids[order], labels[order], rows[order]
        points = points[order]
        spans = list(zip(self.begin, self.end, strict=True))
        self.centre = np.stack([points[x:y].mean(axis=0) for x, y in spans])
        self.radius = np.array([np.sqrt(((points[x:y] - c) ** 2).sum(axis=1).max()) for (x, y), c in zip(spans, self.centre, strict=True)])
        self.least_id = np.array([self.ids[x:y].min() for x, y in spans])
        bits = np.uint64(1) << (self.labels % 64).astype(np.uint64)
        self.may_hold = np.array([np.bitwise_or.reduce(bits[x:y]) for x, y in spans])
        low, high = (np.array([f(self.labels[x:y]) for x, y in spans]) for f in (np.min, np.max))
        self.sole, self.label = low == high, low
        self.size = np.sqrt((self.centre**2).sum(axis=1)) + self.radius

    def bounds(self, node: int, q: np.ndarray, norm: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Between which doubles all products with the node's rows lie, rounding included."""
        d = min(q.shape[1], self.centre.shape[1])
        mid = q[:, :d] @ self.centre[node, :d]
        reach = norm * self.radius[node] + 1e-9 * norm * self.size[node] + 1e-6
        return mid - reach, mid + reach


class Search:
    """Queries with the best rows found so far.  ``low`` and ``high`` are the window, ``same`` asks for the query's label
    and for other ids than its own, else for other labels."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, q: np.ndarray, low: np.ndarray, high: np.ndarray, same: bool, k: int):
        self.ids, self.labels, self.q, self.low, self.high, self.same, self.k = ids, labels, q, low, high, same, k
        self.real = q.astype(np.float64)
        self.norm = np.sqrt((self.real**2).sum(axis=1))
        self.scores, self.found = np.full((len(ids), k), NONE, np.int64), np.full((len(ids), k), NO_ID, np.int64)
        self.scored = 0  # products of rows taken

    def fitting(self, tree: BallTree, node: int, at: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Which queries ``at`` a node with these bounds may matter to."""
        labels = self.labels[at]
        if self.same:
            label = (tree.may_hold[node] >> (labels % 64).astype(np.uint64)) & np.uint64(1) == 1
        else:
            label = (labels != tree.label[node]) if tree.sole[node] else np.ones(len(at), bool)
        kth, kth_id = self.scores[at, -1], self.found[at, -1]
        most = np.minimum(np.floor(high), self.high[at].astype(np.float64))
        beaten = (most < kth) | ((most == kth) & (tree.least_id[node] > kth_id))
        return label & (high >= self.low[at]) & (low <= self.high[at]) & ~beaten

    def visit(self, tree: BallTree) -> None:
        every = np.arange(len(self.ids))
        todo = [(0, every, *tree.bounds(0, self.real, self.norm))]
        while todo:
            node, at, low, high = todo.pop()
            fits = self.fitting(tree, node, at, low, high)  # again: others may have raised the k-th since
            at = at[fits]
            if not len(at):
                continue
            if 2 * node + 1 >= len(tree.begin):
                self.take(tree, tree.begin[node], tree.end[node], at)
                continue
            children = [(c, at, *tree.bounds(c, self.real[at], self.norm[at])) for c in (2 * node + 1, 2 * node + 2)]
            todo += sorted(children, key=lambda x: x[3].mean())  # the more promising child is next

    def take(self, tree: BallTree, begin: int, end: int, at: np.ndarray) -> None:
        ids, labels = tree.ids[begin:end], tree.labels[begin:end]
        scores = products(self.q[at], tree.rows[begin:end])
        self.scored += scores.size
        ok = labels == self.labels[at, None]
        ok = ok & (ids != self.ids[at, None]) if self.same else ~ok
        ok &= (scores >= self.low[at, None]) & (scores <= self.high[at, None])
        kth, kth_id = self.scores[at, -1:], self.found[at, -1:]
        ok &= (scores > kth) | ((scores == kth) & (ids < kth_id))
        better = ok.any(axis=1)
        if not better.any():
            return
        at, scores, ok = at[better], scores[better], ok[better]
        scores = np.concatenate([self.scores[at], np.where(ok, scores, NONE)], axis=1)
        names = np.concatenate([self.found[at], np.where(ok, ids, NO_ID)], axis=1)
        order = np.lexsort((names, -scores), axis=1)[:, : self.k]
        self.scores[at] = np.take_along_axis(scores, order, axis=1)
        self.found[at] = np.take_along_axis(names, order, axis=1)


def build_index(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """Blocks of rows with their trees, as pickled arrays, in the shared folder."""
    import pickle

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def built(n: int) -> pa.RecordBatch:
            nonlocal held
            table = pa.Table.from_batches(held).combine_chunks()
            part, rest = table.slice(0, n), table.slice(n)
            held = rest.to_batches()
            vectors = part.column("v").combine_chunks()
            tree = BallTree(part.column("vec_id").to_numpy(), part.column("label").to_numpy(), matrix_of(vectors.chunk(0) if isinstance(vectors, pa.ChunkedArray) else vectors))
            least = next(t for t in (np.int16, np.int32, np.int64) if np.iinfo(t).min <= tree.rows.min() and tree.rows.max() <= np.iinfo(t).max)
            tree.rows = tree.rows.astype(least)
            return pa.RecordBatch.from_arrays([pa.array([n], pa.int32()), pa.array([pickle.dumps(tree, protocol=5)], pa.binary())], ["n", "tree"])

        for batch in batches:
            for at in range(0, batch.num_rows, block):
                held.append(batch.slice(at, block))
                while sum(b.num_rows for b in held) >= block:
                    yield built(block)
        if sum(b.num_rows for b in held):
            yield built(sum(b.num_rows for b in held))

    n = parts_for(rows.count(), block, 1)
    spread = rows.withColumn("near", F.get("v", F.lit(0))).withColumn("any", F.monotonically_increasing_id())
    spread = spread.repartitionByRange(n, "label", "near", "any").select("vec_id", "label", "v")
    return stage(spread.mapInArrow(tidy(run), "n int, tree binary"))


def best_rows(index: DataFrame, ids: np.ndarray, labels: np.ndarray, q: np.ndarray, of: np.ndarray, low: np.ndarray, high: np.ndarray, same: bool, k: int) -> DataFrame:
    """``query, rank, vec_id, score``: the ``k`` best rows of the whole index for each query; query ``i`` is row
    ``of[i]`` of the anchors and has the window ``low[i]`` to ``high[i]``."""
    sent = index.sparkSession.sparkContext.broadcast((ids, labels, q, of, low, high))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pickle

        ids, labels, q, of, low, high = sent.value
        search = Search(ids[of], labels[of], q[of], low, high, same, k)
        for batch in batches:
            for raw in batch.column("tree"):
                search.visit(pickle.loads(raw.as_buffer()))
        query, nth = np.nonzero(search.found != NO_ID)
        yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(search.found[query, nth]), pa.array(search.scores[query, nth])], ["query", "vec_id", "score"])

    found = index.select("tree").mapInArrow(tidy(run), "query long, vec_id long, score long")
    nearest = W.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k).select("query", "rank", "vec_id", "score")


def hard_negatives(rows: DataFrame, every: int = 100, positives: int = 5, negatives: int = 10, low: int = 3, high: int = 9, block: int = 4096) -> DataFrame:
    """Anchors are the rows whose ``vec_id`` is divisible by ``every``.  For each anchor and each of its first
    ``positives`` rows of its label, the first ``negatives`` rows of other labels whose product lies between ``low`` and
    ``high`` tenths of the positive's, as ``OUT``."""
    spark = rows.sparkSession
    rows = usable(rows)
    anchors = stage(rows.where(F.col("vec_id") % every == 0).withColumn("number", F.monotonically_increasing_id()))
    n = anchors.count()
    if not n:
        discard(anchors)
        return spark.createDataFrame([], OUT)
    index, path = build_index(rows), shared_dir(spark)
    blocks = -(-n // block)
    for b in range(blocks):
        own = anchors.where(F.pmod(F.xxhash64("number"), F.lit(blocks)) == b).toArrow().combine_chunks()
        if not own.num_rows:
            continue
        ids, labels = own.column("vec_id").to_numpy(), own.column("label").to_numpy()
        q, count = matrix_of(own.column("v").chunk(0)), own.num_rows
        free = np.full(count, NONE, np.int64), np.full(count, MOST, np.int64)
        near = stage(best_rows(index, ids, labels, q, np.arange(count), *free, True, positives).select(F.col("query").alias("anchor"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))
        found = near.select("anchor", "positive_score").distinct().where("positive_score >= 0").toArrow()
        of, score = found.column("anchor").to_numpy(), found.column("positive_score").to_numpy()
        tens, ones = np.divmod(score, 10)
        window = low * tens - (-low * ones) // 10, high * tens + high * ones // 10  # ceiling and floor, within 64 bits
        queries = spark.createDataFrame(pa.table({"query": np.arange(len(of)), "anchor": of, "anchor_id": ids[of], "positive_score": score}))
        best = best_rows(index, ids, labels, q, of, *window, False, negatives)
        pairs = F.broadcast(near.join(F.broadcast(queries), ["anchor", "positive_score"]))  # ``positives`` rows an anchor of the block
        best.join(pairs, "query").select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")).write.mode("append").parquet(path)
        discard(near)
    discard(anchors, index)
    return spark.read.schema(OUT).parquet(path)

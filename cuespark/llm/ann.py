"""Approximate maximum-inner-product search with score-aware (anisotropic) quantisation.

Codes: the vector is cut into pairs of components; each pair takes one of 16 codewords, so a code is
four bits a pair.  The loss of a residual r of a vector x weighs its part along x ``eta`` times as much
as the rest, since only that part moves large inner products.  Codewords and codes are fitted by turns:
codes by coordinate descent (the parallel part couples the pairs), codewords by one least-squares solve.

Search: the index (row, id, vector, code) of *all* rows is written once.  Queries come in blocks of a bounded
size, broadcast one after the other; every task scans its codes with four-bit tables (for each query and
pair sixteen entries, rounded to eight bits and summed as integers), reranks the best ``rerank`` of each
chunk by the exact product in double precision, and hands on ``k`` rows a query.  In a chunk, rows with
equal sums come in the order of their ids, so that equal vectors are reranked from the smallest id on.
Blocks are separate jobs appended to one table.

Defined results: rows with a null id, a null, zero or non-finite vector, null components, or another
length than the most common one of the fitted sample take no part, whatever stands in the rows around
them; rows with the query's id are its own and no candidates; a repeated query row gets its own answer
(under the same query_id); ties go to the smaller id; an empty table gives an empty result; other columns,
whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cuespark.llm.common import shared_dir, stage, tidy

CODEWORDS, WIDTH = 16, 2
OUT = "query_id long, rank int, vec_id long, score double"


def vectors(column: pa.Array, dim: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Usable rows (positions) and their vectors as a matrix of doubles; of length ``dim``, or of the most common one."""
    sizes = np.array([-1 if s is None else s for s in pc.list_value_length(column).to_pylist()])
    usual = dim or (np.bincount(sizes[sizes > 0]).argmax() if (sizes > 0).any() else 0)
    at = np.flatnonzero((sizes == usual) & (sizes > 0))
    flat = column.take(pa.array(at)).flatten()
    matrix = np.where(flat.is_null(), np.nan, flat.fill_null(0).to_numpy(zero_copy_only=False).astype(np.float64)).reshape(len(at), -1 if usual else 0)
    fine = np.isfinite(matrix).all(axis=1) & (matrix != 0).any(axis=1)
    return at[fine], matrix[fine]


def eta_for(dim: int, threshold: float = 0.2) -> float:
    """Weight of the parallel residual for inner products above ``threshold`` of the norms' product."""
    return max(1.0, (dim - 1) * threshold**2 / (1 - threshold**2))


class Quantiser:
    """Codewords (pairs, 16, 2) with score-aware encoding."""

    def __init__(self, dim: int, eta: float | None = None):
        self.dim, self.pairs = dim, -(-dim // WIDTH)
        self.eta = eta_for(dim) if eta is None else eta
        self.words = np.zeros((self.pairs, CODEWORDS, WIDTH))

    def split(self, x: np.ndarray) -> np.ndarray:
        return np.pad(x, ((0, 0), (0, self.pairs * WIDTH - self.dim))).reshape(len(x), self.pairs, WIDTH)

    def encode(self, x: np.ndarray, sweeps: int = 2) -> np.ndarray:
        """Codes (rows, pairs): nearest codewords, then coordinate descent on the score-aware loss."""
        parts, n = self.split(x), len(x)
        unit = self.split(x / np.linalg.norm(x, axis=1, keepdims=True))
        codes = np.empty((n, self.pairs), np.int64)
        for s in range(self.pairs):
            codes[:, s] = ((parts[:, s, None, :] - self.words[s]) ** 2).sum(axis=2).argmin(axis=1)
        rest = parts - self.words[np.arange(self.pairs), codes]
        along = (rest * unit).sum(axis=2)
        total = along.sum(axis=1)
        rows = np.arange(n)
        for _ in range(sweeps):
            for s in range(self.pairs):
                option = parts[:, s, None, :] - self.words[s]
                own = (option * unit[:, s, None, :]).sum(axis=2)
                others = total - along[:, s]
                loss = (option**2).sum(axis=2) + (self.eta - 1) * (others[:, None] + own) ** 2
                codes[:, s] = loss.argmin(axis=1)
                along[:, s] = own[rows, codes[:, s]]
                total = others + along[:, s]
        return codes

    def fit(self, x: np.ndarray, rounds: int = 6, seed: int = 7) -> Quantiser:
        rng, parts = np.random.default_rng(seed), self.split(x)
        for s in range(self.pairs):
            self.words[s] = parts[rng.choice(len(x), CODEWORDS, replace=len(x) < CODEWORDS), s]
        unit = self.split(x / np.linalg.norm(x, axis=1, keepdims=True))
        size, norm = self.pairs * CODEWORDS, np.linalg.norm(x, axis=1)
        for _ in range(rounds):
            codes = self.encode(x, sweeps=1)
            slot = codes + np.arange(self.pairs) * CODEWORDS
            # least squares: (D + (eta - 1) V'V) w = S'x + (eta - 1) V'|x|, V the selected unit parts
            v = np.zeros((len(x), size, WIDTH))
            v[np.arange(len(x))[:, None], slot] = unit
            v = v.reshape(len(x), -1)
            counts = np.bincount(slot.ravel(), minlength=size)
            left = (self.eta - 1) * v.T @ v + np.diag(np.repeat(counts, WIDTH) + 1e-3)
            sums = np.stack([np.bincount(slot.ravel(), parts[:, :, j].ravel(), size) for j in range(WIDTH)], axis=1)
            right = sums.ravel() + (self.eta - 1) * v.T @ norm + 1e-3 * self.words.ravel()
            self.words = np.linalg.solve(left, right).reshape(self.words.shape)
        return self

    def pack(self, codes: np.ndarray) -> np.ndarray:
        """Two codes a byte."""
        even = np.pad(codes, ((0, 0), (0, self.pairs % 2)))
        return (even[:, 0::2] | (even[:, 1::2] << 4)).astype(np.uint8)

    def tables(self, queries: np.ndarray) -> Tables:
        """What each codeword adds to each query's product, in 256 steps a query."""
        per_pair = np.einsum("qsw,scw->scq", self.split(queries), self.words)
        low = per_pair.min(axis=1, keepdims=True)
        step = np.maximum((per_pair - low).max(axis=(0, 1)), 1e-300) / 255
        return Tables(np.rint((per_pair - low) / step).astype(np.uint8), step, low.sum(axis=(0, 1)))


@dataclass
class Tables:
    """``entries`` (pairs, 16, queries); a sum of entries times ``step`` plus ``base`` is an approximate product."""

    entries: np.ndarray
    step: np.ndarray
    base: np.ndarray


def sums(tables: Tables, codes: np.ndarray) -> np.ndarray:
    """Integers (rows, queries) that order each query's rows by approximate product."""
    out = np.zeros((len(codes), tables.entries.shape[2]), np.uint16 if len(tables.entries) <= 257 else np.uint32)
    for s, table in enumerate(tables.entries):
        out += table[codes[:, s // 2] >> 4 if s % 2 else codes[:, s // 2] & 15]
    return out


def scan(tables: Tables, codes: np.ndarray) -> np.ndarray:
    """Approximate products (queries, rows) of packed codes."""
    return (sums(tables, codes) * tables.step + tables.base).T


def train(rows: DataFrame, max_train: int = 8192) -> Quantiser | None:
    """Fit on at most ``max_train`` rows, those with the smallest hash of their id."""
    sample = rows.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).orderBy(F.xxhash64("vec_id"), "vec_id").limit(max_train).toArrow()
    column = sample.column("embedding").combine_chunks()
    _, matrix = vectors(column if isinstance(column, pa.Array) else column.chunk(0)) if sample.num_rows else (None, np.zeros((0, 0)))
    return Quantiser(matrix.shape[1]).fit(matrix) if len(matrix) else None


def build_index(rows: DataFrame, quantiser: Quantiser) -> DataFrame:
    """``row, vec_id, vector, code`` of every usable row, written to the shared folder; ``row`` is unique."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                good, matrix = vectors(part.column("embedding"), quantiser.dim)
                if not len(good):
                    continue
                packed = quantiser.pack(quantiser.encode(matrix))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row + np.arange(len(good))), part.column("vec_id").take(pa.array(good)), pa.array([v.tobytes() for v in matrix.astype("<f8")], pa.binary()), pa.array([c.tobytes() for c in packed], pa.binary())],
                    ["row", "vec_id", "vector", "code"],
                )
                row += len(good)

    return stage(rows.where("vec_id IS NOT NULL").mapInArrow(tidy(run), "row long, vec_id long, vector binary, code binary"))


def _search(sent, k: int, rerank: int, chunk: int = 8192, at_once: int = 64):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, ids, queries, quantiser = sent.value
        dim = quantiser.dim
        best_score, best_id = np.full((len(ids), k), -np.inf), np.full((len(ids), k), np.iinfo(np.int64).max)

        def take(own: np.ndarray, matrix: np.ndarray, codes: np.ndarray) -> None:
            for at in range(0, len(ids), at_once):
                q = queries[at : at + at_once]
                rough = sums(quantiser.tables(q), codes).T.astype(np.int64)
                total = rough.shape[1]
                n = min(rerank, total)
                # rows are in the order of ids: of equal sums the first come first
                near = np.argpartition(np.arange(total) - rough * total, n - 1, axis=1)[:, :n] if n < total else np.broadcast_to(np.arange(n), (len(q), n))
                exact = np.einsum("qnd,qd->qn", matrix[near], q)
                found = own[near]
                exact[found == ids[at : at + at_once, None]] = -np.inf  # the query's own rows
                scores = np.concatenate([best_score[at : at + at_once], exact], axis=1)
                names = np.concatenate([best_id[at : at + at_once], found], axis=1)
                order = np.lexsort((names, -scores), axis=1)[:, :k]
                best_score[at : at + at_once] = np.take_along_axis(scores, order, axis=1)
                best_id[at : at + at_once] = np.take_along_axis(names, order, axis=1)

        for batch in batches:
            for at in range(0, batch.num_rows, chunk):
                part = batch.slice(at, chunk)
                matrix = np.frombuffer(b"".join(part.column("vector").to_pylist()), "<f8").reshape(-1, dim)
                codes = np.frombuffer(b"".join(part.column("code").to_pylist()), np.uint8).reshape(len(matrix), -1)
                own = part.column("vec_id").to_numpy()
                by_id = np.argsort(own, kind="stable")
                take(own[by_id], matrix[by_id], codes[by_id])
        real = np.isfinite(best_score)
        row = np.nonzero(real)[0]
        yield pa.RecordBatch.from_arrays([pa.array(numbers[row]), pa.array(ids[row]), pa.array(best_id[real]), pa.array(best_score[real])], ["number", "query_id", "vec_id", "score"])

    return run


def search(spark: SparkSession, index: DataFrame, quantiser: Quantiser, queries: DataFrame, k: int = 20, rerank: int = 200, block: int = 8192, task_rows: int = 8192) -> DataFrame:
    """The ``k`` nearest of each row of ``queries`` (rows of the index), as ``OUT``."""
    n_queries, n_rows = queries.count(), index.count()
    blocks, path = max(1, -(-n_queries // block)), shared_dir(spark)
    tasks = max(1, -(-n_rows // task_rows))
    nearest = W.partitionBy("block", "number").orderBy(F.desc("score"), "vec_id")
    for b in range(blocks):
        rows = queries.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == b).select("vec_id", "vector").toArrow()
        ids = rows.column("vec_id").to_numpy()
        matrix = np.frombuffer(b"".join(rows.column("vector").to_pylist()), "<f8").reshape(-1, quantiser.dim)
        sent = spark.sparkContext.broadcast((np.arange(len(ids)), ids, matrix, quantiser))
        found = index.coalesce(tasks).mapInArrow(tidy(_search(sent, k, rerank)), "number long, query_id long, vec_id long, score double").withColumn("block", F.lit(b))
        found = found.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k)
        found.select("query_id", "rank", "vec_id", "score").write.mode("append").parquet(path)
    return spark.read.schema(OUT).parquet(path)


def nearest_rows(rows: DataFrame, every: int = 20, k: int = 20, **options) -> DataFrame:
    """Queries: the rows whose ``vec_id`` is divisible by ``every``; candidates: all other rows."""
    spark = rows.sparkSession
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    quantiser = train(rows)
    if quantiser is None:
        return spark.createDataFrame([], OUT)
    index = build_index(rows, quantiser)
    return search(spark, index, quantiser, index.where(F.col("vec_id") % every == 0), k, **options)

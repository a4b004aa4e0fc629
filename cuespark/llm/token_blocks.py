"""Token-ID output in patched frame-of-reference blocks.

A block holds ``BLOCK`` ids: the block's minimum is subtracted, the width is the bit length that covers
``PERCENTILE`` percent of the block, values are packed at that width (32 values in ``width`` 32-bit
words) and the higher bits of the outliers stand in an exception list of (position, high bits).  A shard
file is::

    b"PFOR0001" | blocks | doc ids, their null flags, doc starts, block starts | 6 x int64 footer

    block: minimum u32, width u8, pad u8, exceptions u16, packed words, positions u16[], high bits u32[]

Documents are put in ascending order of id by a range shuffle into at most ``most_parts`` partitions; each
writes shards of about ``shard_bytes`` of text, one after the other, under temporary names and renames
them, so a task that runs twice leaves the same files.  The manifest is a table: a shard's first id is
summed from the totals of the partitions before it and of the shards before it in its own.  Block starts
give random access: ``Shard.ids(a, b)`` unpacks only the blocks that hold ids a..b-1.

Defined results: null text is an empty document (the end id alone); null ids come first; rows with equal
ids (a third of all rows may have one) are spread and ordered by a hash of the text; an empty table writes
no ids and gives no rows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cuespark.llm.common import docs_of, input_bytes, parts_for, raw_texts, shared_dir, stage, text_slices, tidy
from cuespark.llm.words import Known, joined_ids, latin, latin_pieces, parts, simple

BLOCK, PERCENTILE = 1024, 95
MAGIC = b"PFOR0001"
_HEAD = np.dtype([("low", "<u4"), ("width", "u1"), ("pad", "u1"), ("n", "<u2")])


def _words(values: np.ndarray, width: int) -> np.ndarray:
    """``values`` (k, BLOCK) below 2**width -> (k, BLOCK // 32 * width) 32-bit words."""
    lanes = values.reshape(len(values), BLOCK // 32, 32)
    out = np.zeros((len(values), BLOCK // 32, width), np.uint32)
    for i in range(32 if width else 0):
        word, shift = divmod(i * width, 32)
        out[:, :, word] |= lanes[:, :, i] << np.uint32(shift)
        if shift + width > 32:
            out[:, :, word + 1] |= lanes[:, :, i] >> np.uint32(32 - shift)
    return out.reshape(len(values), -1)


def _values(words: np.ndarray, width: int) -> np.ndarray:
    groups = words.reshape(len(words), BLOCK // 32, max(width, 0)) if width else None
    out = np.zeros((len(words), BLOCK // 32, 32), np.uint32)
    mask = np.uint32((1 << width) - 1)
    for i in range(32 if width else 0):
        word, shift = divmod(i * width, 32)
        lane = groups[:, :, word] >> np.uint32(shift)
        if shift + width > 32:
            lane = lane | (groups[:, :, word + 1] << np.uint32(32 - shift))
        out[:, :, i] = lane & mask
    return out.reshape(len(words), BLOCK)


def pack(ids: np.ndarray) -> list[bytes]:
    """Whole blocks of ids (a multiple of BLOCK of them) as bytes, one string a block."""
    blocks = ids.astype(np.uint32).reshape(-1, BLOCK)
    low = blocks.min(axis=1)
    rest = blocks - low[:, None]
    bits = np.frexp(rest.astype(np.float64))[1]  # bit length; exact, as the values are below 2**53
    width = np.percentile(bits, PERCENTILE, axis=1, method="higher").astype(np.int64)
    out: list[bytes] = [b""] * len(blocks)
    for w in np.unique(width):
        at = np.flatnonzero(width == w)
        packed = _words(rest[at] & np.uint32((1 << int(w)) - 1), int(w)).astype("<u4")
        for i, words in zip(at, packed, strict=True):
            over = np.flatnonzero(bits[i] > w)
            head = np.array([(low[i], w, 0, len(over))], _HEAD)
            high = (rest[i, over] >> np.uint32(w)).astype("<u4") if w < 32 else over.astype("<u4")
            out[i] = head.tobytes() + words.tobytes() + over.astype("<u2").tobytes() + high.tobytes()
    return out


def unpack(data: bytes | memoryview, starts: np.ndarray) -> np.ndarray:
    """The ids of the blocks that begin at ``starts`` of ``data``."""
    raw = np.frombuffer(data, np.uint8)
    heads = np.frombuffer(raw[(starts[:, None] + np.arange(_HEAD.itemsize)).ravel()].tobytes(), _HEAD)
    out = np.empty((len(starts), BLOCK), np.uint32)
    for w in np.unique(heads["width"]):
        at, size = np.flatnonzero(heads["width"] == w), BLOCK // 8 * int(w)
        body = raw[(starts[at, None] + _HEAD.itemsize + np.arange(size)).ravel()].tobytes()
        out[at] = _values(np.frombuffer(body, "<u4").reshape(len(at), -1), int(w))
        for i in at[heads["n"][at] > 0]:
            n, begin = int(heads["n"][i]), int(starts[i]) + _HEAD.itemsize + size
            where = np.frombuffer(data, "<u2", n, begin)
            out[i, where] |= np.frombuffer(raw[begin + 2 * n : begin + 6 * n].tobytes(), "<u4") << np.uint32(w)
    return (out + heads["low"][:, None]).ravel()


class ShardWriter:
    """Appends documents to a shard; holds one group of unfinished blocks and the index."""

    def __init__(self, sink):
        self.sink, self.at, self.total = sink, len(MAGIC), 0
        self.pending: list[np.ndarray] = []
        self.held = 0
        self.docs: list[int | None] = []
        self.doc_starts, self.block_starts = [0], []
        sink.write(MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc_id)
        self.pending.append(ids)
        self.held += len(ids)
        self.total += len(ids)
        self.doc_starts.append(self.total)
        if self.held >= 256 * BLOCK:
            self._flush(self.held // BLOCK * BLOCK)

    def _flush(self, n: int) -> None:
        ids = np.concatenate([*self.pending, np.zeros(0, np.uint32)])
        for block in pack(ids[:n]) if n else []:
            self.block_starts.append(self.at)
            self.at += len(block)
            self.sink.write(block)
        self.pending, self.held = [ids[n:]], len(ids) - n

    def close(self) -> None:
        if self.held % BLOCK:
            self.pending.append(np.full(BLOCK - self.held % BLOCK, self.pending[-1][-1] if len(self.pending[-1]) else 0, np.uint32))
            self.held += len(self.pending[-1])
        self._flush(self.held)
        parts = [np.array([x or 0 for x in self.docs], "<i8"), np.array([x is None for x in self.docs], "u1"), np.array(self.doc_starts, "<i8"), np.array(self.block_starts, "<i8")]
        for p in parts:
            self.sink.write(p.tobytes())
        self.sink.write(np.array([self.at, len(self.docs), len(self.block_starts), self.total, BLOCK, 1], "<i8").tobytes())


class Shard:
    """A shard file's bytes: its documents and any range of its ids."""

    def __init__(self, data: bytes):
        index, n_docs, n_blocks, self.total, block, _ = np.frombuffer(data, "<i8", 6, len(data) - 48).tolist()
        if data[: len(MAGIC)] != MAGIC or block != BLOCK:
            raise ValueError("not a shard of this format")
        self.data = data
        nulls_at = index + 8 * n_docs
        starts_at = nulls_at + n_docs
        ids = np.frombuffer(data, "<i8", n_docs, index)
        nulls = np.frombuffer(data, "u1", n_docs, nulls_at)
        self.docs = [None if z else int(i) for i, z in zip(ids, nulls, strict=True)]
        self.doc_starts = np.frombuffer(data, "<i8", n_docs + 1, starts_at)
        self.block_starts = np.frombuffer(data, "<i8", n_blocks, starts_at + 8 * (n_docs + 1))

    def ids(self, a: int, b: int) -> np.ndarray:
        first, last = a // BLOCK, -(-b // BLOCK)
        if a >= b:
            return np.zeros(0, np.uint32)
        return unpack(self.data, self.block_starts[first:last])[a - first * BLOCK : b - first * BLOCK]


_encoders: dict[str, Callable[[list[str]], list[bytes]]] = {}


def library_encoder(vocabulary: str) -> Callable[[list[str]], list[bytes]]:
    """Texts to packed ids with the tokenizers library, one for each vocabulary and Python worker.

    Texts of characters below U+0100 are cut in their pre-tokens, others in the parts of ``words.parts``; at both places
    the library's pre-tokenizer cuts in any case.  What a worker has not met lately goes to the library, many pieces at
    a time.  What else is a letter, a number or a pre-token, the library decides alone.  Texts that hold an added token
    go to it whole.
    """
    if vocabulary in _encoders:
        return _encoders[vocabulary]
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]

    lengths = np.zeros(max(tokenizer.get_vocab().values()) + 1, np.int64)
    for token, i in tokenizer.get_vocab().items():
        lengths[i] = len(token)  # a character of the byte alphabet stands for a byte

    def ids_of(texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def after_space(texts: list[str]) -> list[list[int]]:
        return [e.ids for e in tokenizer.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]

    def learn(found: list[str]) -> list[bytes]:
        plain = [p for p in found if simple(p)]
        ids, counts = joined_ids([p[1:] for p in plain], after_space, lengths)
        raw, stops = ids.astype("<u4").tobytes(), (4 * np.cumsum(counts)).tolist()
        known = dict(zip(plain, (raw[a:b] for a, b in zip([0, *stops], stops, strict=False)), strict=True))
        rest = [p for p in found if p not in known]
        known.update(zip(rest, ids_of(rest), strict=True))
        return [*map(known.__getitem__, found)]

    known = Known(learn)

    def cut(text: str) -> list[str]:
        if latin(text):
            return latin_pieces(text)
        first, *others = parts(text)
        return [first, *(" " + p for p in others)]

    def encode(texts: list[str]) -> list[bytes]:
        whole = [i for i, t in enumerate(texts) if any(a in t for a in added)]
        pieces = [cut(t) for t in texts]
        for i in whole:
            pieces[i] = []
        out = known.results(pieces)
        for i, ids in zip(whole, ids_of([texts[i] for i in whole]), strict=True):
            out[i] = ids
        return out

    _encoders[vocabulary] = encode
    return encode


def store_of(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a folder or file; Hadoop's names of object stores are known too."""
    scheme, colon, rest = uri.partition("://")
    scheme = {"s3a": "s3", "s3n": "s3"}.get(scheme, scheme)
    return fs.FileSystem.from_uri(f"{scheme}{colon}{rest}" if colon else uri)


MANIFEST = "part int, shard int, path string, n_docs long, n_ids long, n_bytes long"


def write_shards(docs: DataFrame, vocabulary: str, folder: str, end_id: int = 0, shard_bytes: int = 32 << 20, most_parts: int = 8192) -> DataFrame:
    """Encode ``docs`` in ascending order of id into shard files; the manifest, one row a shard, with ``start``."""
    spark = docs.sparkSession
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = min(most_parts, parts_for(input_bytes(docs), shard_bytes, least))
    docs = docs_of(docs)
    order = ["doc_id", "h", "text"]
    # equal rows go anywhere between their neighbours: the last key only spreads them
    spread = docs.withColumn("h", F.xxhash64("text")).withColumn("any", F.monotonically_increasing_id())
    ordered = spread.repartitionByRange(n, "doc_id", "h", "any").drop("any").sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        context = TaskContext.get()
        part, (store, path) = context.partitionId(), store_of(folder)
        store.create_dir(path)
        encode, end = library_encoder(vocabulary), np.array([end_id], np.uint32)

        shard, k, own, size = None, 0, "", 0

        def closed() -> pa.RecordBatch:
            shard.close()
            shard.sink.close()
            name = f"shard-{part:06d}-{k:06d}.pfor"
            if store.get_file_info(f"{path}/{name}").type == fs.FileType.NotFound:
                store.move(own, f"{path}/{name}")
            else:  # an earlier run of this task, whose executor was lost later, has left the same file
                store.delete_file(own)
            row = {"part": [part], "shard": [k], "path": [f"{folder}/{name}"], "n_docs": [len(shard.docs)], "n_ids": [shard.total], "n_bytes": [shard.at]}
            return pa.RecordBatch.from_pydict(row, pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("n_bytes", pa.int64())]))

        for batch in text_slices(batches, min(2 << 20, shard_bytes)):
            if shard is not None and size >= shard_bytes:
                yield closed()
                shard, k = None, k + 1
            if shard is None:
                own, size = f"{path}/_shard-{part:06d}-{k:06d}-{context.taskAttemptId()}", 0
                shard = ShardWriter(store.open_output_stream(own))
            size += batch.column("text").nbytes
            packed = encode([t.decode() for t in raw_texts(batch.column("text"))])
            for doc, p in zip(batch.column("doc_id").to_pylist(), packed, strict=True):
                shard.add(doc, np.concatenate([np.frombuffer(p, "<u4"), end]))
        if shard is not None:
            yield closed()

    written = stage(ordered.select("doc_id", "text").mapInArrow(tidy(run), MANIFEST))
    totals = sorted((r["part"], r["n"]) for r in written.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())  # ``most_parts`` rows at most
    before, starts = 0, []
    for part, size in totals:
        starts.append((part, before))
        before += size
    earlier = W.partitionBy("part").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    own = written.withColumn("start", F.coalesce(F.sum("n_ids").over(earlier), F.lit(0)))
    bases = F.broadcast(spark.createDataFrame(starts, "part int, base long"))
    return own.join(bases, "part").select(*written.columns, (F.col("start") + F.col("base")).alias("start"))


def read_shards(manifest: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, unpacked from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for uri, base in (x for batch in batches for x in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True)):
            store, path = store_of(uri)
            with store.open_input_stream(path) as f:
                shard = Shard(f.read())
            ends = shard.doc_starts
            at = 0
            while at < len(shard.docs):  # a group of documents of about 1M ids at a time
                stop = max(at + 1, int(np.searchsorted(ends, ends[at] + (1 << 20), side="right")) - 1)
                ids = shard.ids(int(ends[at]), int(ends[stop])).astype("<u4")
                cuts = ends[at : stop + 1] - ends[at]
                crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard.docs[at:stop], pa.int64()), pa.array(base + ends[at:stop]), pa.array(np.diff(cuts)), pa.array(crc, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )
                at = stop

    n = max(1, manifest.count())
    spread = manifest.select("path", "start").repartitionByRange(min(n, 8192), "path")
    return spread.mapInArrow(tidy(run), "doc_id long, start long, n_tokens long, ids_crc32 long")


def encode_to_blocks(docs: DataFrame, vocabulary: str, folder: str | None = None, **options) -> DataFrame:
    """Write the shards of ``docs`` (to the shared folder unless one is named) and describe them."""
    folder = folder or shared_dir(docs.sparkSession)
    folder = folder if "://" in folder or folder.startswith("/") else folder.replace("file:", "", 1)
    return read_shards(write_shards(docs, vocabulary, folder, **options))

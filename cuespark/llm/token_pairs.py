"""Cross-tokenizer alignment with corpus-wide counts of token pairs.

Two tokenizers cut the same bytes (a space and the text).  Where tokens of both end, the text falls into groups; a
link is an occurrence of a token of A and one of B whose byte ranges overlap.  A pair of ids is one int64 key
(``b << 32 | a``):

1. every task aligns its documents, counts their keys with ``np.unique`` and writes the sorted partial counts; beside
   them it writes, compressed, which links each document has, so that texts are tokenized once;
2. the partial counts are range-partitioned and sorted by key over the whole cluster; each range adds up its runs of
   equal keys and writes one sorted shard: a file of keys and a file of counts in the shared folder;
3. every task reads its documents' links again and looks their keys up by binary search in the shards, which it maps
   into memory (only the pages that are touched are read; a store that cannot be mapped is read shard by shard).

Texts are cut into parts at spaces (``words.parts``) whose tokens and links do not depend on what stands around them,
so a worker aligns each distinct part once; its tables are bounded by bytes.  What goes to the driver is one row a shard
and the highest count of each id of B, which the vocabulary bounds.

Defined results: texts that are null or empty, or whose tokens' bytes differ from the space and the text (A or B
normalised something away), have no tokens and take no part in the counts; strings of special tokens are ordinary text;
null and repeated ids and repeated rows each get a row; columns other than the id and the text, whatever their names,
are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuespark.llm.bpe import byte_alphabet
from cuespark.llm.common import docs_of, parts_for, raw_texts, shared_dir, stage, text_slices, tidy
from cuespark.llm.token_blocks import store_of
from cuespark.llm.words import LONGEST, joined_ids, parts

OUT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
SPACE = "▁"


def table_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts in a row, and where each begins and ends."""
    return np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)], dtype=np.int64)


def gather(blob: np.ndarray, offsets: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The bytes of the ids in a row."""
    starts = offsets[ids]
    sizes = offsets[ids + 1] - starts
    ends = np.cumsum(sizes)
    return blob[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)]


class Pair:
    """Both tokenizers, and what is known of the parts of texts: a number for each part, and by number its tokens,
    groups and links."""

    def __init__(self, a: str, b: str, max_bytes: int):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = Tokenizer.from_file(a)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        alphabet, names = byte_alphabet(), self.a.get_vocab()
        tokens = [b""] * (max(names.values()) + 1)
        for t, i in names.items():
            tokens[i] = bytes(alphabet[c] for c in t) if all(c in alphabet for c in t) else t.encode()
        self.bytes_a = table_of(tokens)
        self.bytes_b = table_of([bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)])
        #: No token of B goes on from something else to a space, so texts may be cut there.
        self.cuts = not any(x != SPACE and y == SPACE for p in pieces for x, y in zip(p, p[1:], strict=False))
        end = self.b.encode("a ")  # a last space stands alone
        self.space = end[-1:] if self.cuts else []
        self.n_names, self.max_bytes = max(len(tokens), len(pieces)), max_bytes
        self.names = [f"{i}{mark}" for mark in ",|;" for i in range(self.n_names)]
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.rows: list[np.ndarray] = []  # n_a, n_b, n_groups, n_links, whole of each part
        self.links: list[np.ndarray] = []
        self.texts: list[bytes] = []
        self.held = 0

    def encoded(self, found: list[str]) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
        """Ids of both for a space and each part, in a row, and how many each part has."""

        def by_a(texts: list[str]) -> list[list[int]]:
            return [e.ids for e in self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]

        def by_b(texts: list[str]) -> list[list[int]]:
            return [ids if t else self.space for t, ids in zip(texts, self.b.encode(texts, num_threads=1), strict=True)]

        together = 256 if self.cuts else 1
        return joined_ids(found, by_a, np.diff(self.bytes_a[1]), together), joined_ids(found, by_b, np.diff(self.bytes_b[1]), together)

    def learn(self, found: list[str]) -> None:
        """Align new parts; they get the next numbers."""
        (all_a, n_a), (all_b, n_b) = self.encoded(found)
        raw = [b" " + p.encode() for p in found]
        size = np.array([*map(len, raw)])
        whole = np.ones(len(found), bool)
        for ids, n, (blob, offsets) in ((all_a, n_a, self.bytes_a), (all_b, n_b, self.bytes_b)):
            lengths = np.diff(offsets)[ids]
            whole &= np.diff(np.concatenate([[0], np.cumsum(lengths)])[np.concatenate([[0], np.cumsum(n)])]) == size
        for ids, n, (blob, offsets) in ((all_a, n_a, self.bytes_a), (all_b, n_b, self.bytes_b)):
            at = np.flatnonzero(whole)
            same = np.frombuffer(b"".join([raw[i] for i in at]), np.uint8) == gather(blob, offsets, ids[np.repeat(whole, n)])
            ends = np.cumsum(size[at])
            wrong = np.concatenate([[0], np.cumsum(~same)])
            whole[at] = wrong[ends] == wrong[ends - size[at]]
        a, b = all_a[np.repeat(whole, n_a)], all_b[np.repeat(whole, n_b)]
        n_a, n_b, size = np.where(whole, n_a, 0), np.where(whole, n_b, 0), np.where(whole, size, 0)
        ends_a, ends_b = np.cumsum(np.diff(self.bytes_a[1])[a]), np.cumsum(np.diff(self.bytes_b[1])[b])
        both, every = np.intersect1d(ends_a, ends_b, assume_unique=True), np.union1d(ends_a, ends_b)
        # between two neighbouring ends of either kind lies one overlap of one token of A with one of B
        of_a, of_b = np.searchsorted(ends_a, every), np.searchsorted(ends_b, every)
        links = b[of_b] << 32 | a[of_a]
        stops = np.cumsum(size)
        n_groups = np.diff(np.searchsorted(both, stops, side="right"), prepend=0)
        n_links = np.diff(np.searchsorted(every, stops, side="right"), prepend=0)
        self.rows.append(np.stack([n_a, n_b, n_groups, n_links, whole]).astype(np.int64))
        self.links.append(links)
        self.texts += self.groups(a, b, ends_a, ends_b, both, n_a + n_b)
        self.number.update(zip(found, range(len(self.texts) - len(found), len(self.texts)), strict=True))
        self.held += 400 * len(found) + 2 * sum(map(len, found)) + 8 * len(links) + sum(map(len, self.texts[-len(found) :]))

    def groups(self, a, b, ends_a, ends_b, both, n) -> list[bytes]:
        """``a1,a2|b1;a3|b2`` of each part, ``n`` tokens each."""
        group_a, group_b = np.searchsorted(both, ends_a), np.searchsorted(both, ends_b)
        last_a, last_b = (np.append(g[1:] != g[:-1], True)[: len(g)] for g in (group_a, group_b))
        codes = np.empty(len(a) + len(b), np.int64)
        codes[np.arange(len(a)) + np.searchsorted(group_b, group_a, side="left")] = a + self.n_names * last_a
        codes[np.arange(len(b)) + np.searchsorted(group_a, group_b, side="right")] = b + 2 * self.n_names * last_b
        named = [*map(self.names.__getitem__, codes.tolist())]
        stops = np.cumsum(n).tolist()
        return ["".join(named[x:y])[:-1].encode() for x, y in zip([0, *stops], stops, strict=False)]

    def numbers(self, texts: list[str]) -> list[list[int]]:
        """The numbers of the parts of each text.  Begins anew if the tables have grown too large, so numbers hold
        until the next call."""
        if self.held > self.max_bytes:
            self.clear()
        cut = [(parts(t) if self.cuts else [t]) if t else [] for t in texts]
        new = list(set().union(*cut).difference(self.number))
        for at in range(0, len(new), 8192):
            self.learn(new[at : at + 8192])
        out = [[*map(self.number.__getitem__, c)] for c in cut]
        for p in new:
            if len(p) > LONGEST:
                del self.number[p]  # its number stays taken
        return out

    def table(self) -> np.ndarray:
        """By number: n_a, n_b, n_groups, n_links, 1 if the tokens' bytes are the text's."""
        if len(self.rows) > 1:
            self.rows, self.links = [np.concatenate(self.rows, axis=1)], [np.concatenate(self.links)]
        return self.rows[0] if self.rows else np.zeros((5, 0), np.int64)


class Counts:
    """Counts of pairs in sorted shards, and the highest count of each id of B."""

    def __init__(self, shards: list[tuple[int, int, str]], best: np.ndarray, open_at_once: int = 64):
        self.first = np.array([s[0] for s in shards], np.int64)
        self.shards, self.best, self.open_at_once = shards, best, open_at_once
        self.opened: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def shard(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        if i not in self.opened:
            if len(self.opened) >= self.open_at_once:
                self.opened.pop(next(iter(self.opened)))
            store, path = store_of(self.shards[i][2])
            if isinstance(store, fs.LocalFileSystem):
                self.opened[i] = tuple(np.memmap(path + kind, "<i8", "r") for kind in (".keys", ".counts"))
            else:
                self.opened.clear()  # one at a time
                found = []
                for kind in (".keys", ".counts"):
                    with store.open_input_stream(path + kind) as f:
                        found.append(np.frombuffer(f.read(), "<i8"))
                self.opened[i] = tuple(found)
        return self.opened[i]

    def of(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each key whether its count is the highest of its id of B, and the count; none for what was not counted."""
        distinct, back = np.unique(keys, return_inverse=True)
        found = np.zeros(len(distinct), np.int64)
        edges = [*np.searchsorted(distinct, self.first).tolist(), len(distinct)]
        for i, (begin, end) in enumerate(zip(edges, edges[1:], strict=False)):
            if end > begin:
                there, n = self.shard(i)
                at = np.minimum(np.searchsorted(there, distinct[begin:end]), len(there) - 1)
                found[begin:end] = np.where(there[at] == distinct[begin:end], n[at], 0)
        return ((found == self.best[distinct >> 32]) & (found > 0))[back], found[back]


_pairs: dict[tuple, Pair] = {}


def pair(*key) -> Pair:
    """One for each two vocabularies, bound and Python worker."""
    if key not in _pairs:
        _pairs[key] = Pair(*key)
    return _pairs[key]


#: A row is a slice of documents (``rows``; which parts each has, ``n_parts`` of them, as numbers in ``parts``; the keys of
#: each distinct part, ``n_links`` of them, in ``links``) or a partial count (``key, n``).
ALIGNED = "rows array<struct<doc_id:bigint,n_a:bigint,n_b:bigint,n_groups:bigint,n_links:bigint,groups_sha256:string>>, n_parts binary, parts binary, n_links binary, links binary, key bigint, n bigint"
_ROW = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
_PACKED = (("n_parts", "<u4"), ("parts", "<u4"), ("n_links", "<u4"), ("links", "<i8"))


def _pack(values: np.ndarray, kind: str) -> bytes:
    raw = values.astype(kind).tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpack(raw: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(pa.decompress(raw[8:], int.from_bytes(raw[:8], "little"), codec="zstd"), kind).astype(np.int64)


def aligned(docs: DataFrame, a: str, b: str, max_bytes: int = 384 << 20, slice_bytes: int = 4 << 20) -> DataFrame:
    """``ALIGNED`` rows of all documents.  A key has one partial count a task, or more if a task meets so many distinct
    parts that its tables begin anew."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pair(a, b, max_bytes)
        seen = np.zeros(0, np.int64)
        packed = [pa.field(name, pa.binary()) for name, _ in _PACKED]

        def summed() -> pa.RecordBatch:
            table, links = p.table(), p.links[0]
            times = np.repeat(seen, table[3][: len(seen)])
            keys, back = np.unique(links[: len(times)][times > 0], return_inverse=True)
            n = np.bincount(back, times[times > 0], len(keys)).astype(np.int64)  # exact: doubles below 2**53
            none = [pa.nulls(len(keys), kind) for kind in (rows_kind, *(f.type for f in packed))]
            return pa.RecordBatch.from_arrays([*none, pa.array(keys), pa.array(n)], names)

        rows_kind = pa.list_(pa.struct([(c, pa.string() if c == "groups_sha256" else pa.int64()) for c in _ROW]))
        names = ["rows", *(f.name for f in packed), "key", "n"]
        for batch in text_slices(batches, slice_bytes):
            if p.held > p.max_bytes and len(seen):
                yield summed()
                seen = np.zeros(0, np.int64)
            numbers = p.numbers([t.decode() for t in raw_texts(batch.column("text"))])
            flat, of = _flat(numbers)
            table, texts = p.table(), p.texts
            fine = _over(table[4][flat] == 0, of) == 0
            sums = [pa.array(np.where(fine, _over(table[i][flat], of), 0)) for i in range(4)]
            digests = [hashlib.sha256(b";".join(map(texts.__getitem__, x))).hexdigest() if x and ok else "" for x, ok in zip(numbers, fine.tolist(), strict=True)]
            rows = pa.StructArray.from_arrays([batch.column("doc_id"), *sums, pa.array(digests, pa.string())], _ROW)
            # what the documents with tokens have: each distinct part's links once
            flat = flat[np.repeat(fine, np.diff(of))]
            own, back = np.unique(flat, return_inverse=True)
            n_links, first = table[3][own], (np.cumsum(table[3]) - table[3])[own]
            links = p.links[0][spans(first, n_links)] if len(own) else own
            values = (np.where(fine, np.diff(of), 0), back, n_links, links)
            cells = [pa.array([_pack(v, kind)], pa.binary()) for v, (_, kind) in zip(values, _PACKED, strict=True)]
            whole = pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows)
            yield pa.RecordBatch.from_arrays([whole, *cells, pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64())], names)
            used = np.bincount(flat, minlength=len(texts))
            used[: len(seen)] += seen
            seen = used
        if seen.any():
            yield summed()

    return docs.mapInArrow(tidy(run), ALIGNED)


def spans(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``starts[i], starts[i] + 1, ...`` (``counts[i]`` of them) for each i in a row."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + counts, counts)


def _flat(numbers: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    return np.array([i for x in numbers for i in x], np.int64), np.cumsum([0, *map(len, numbers)])


def _over(values: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Sums from ``of[i]`` to ``of[i + 1]``."""
    return np.diff(np.concatenate([[0], np.cumsum(values)])[of])


MANIFEST = "first long, last long, path string, n long, ids binary, best binary"


def write_counts(partial: DataFrame, folder: str, shard_rows: int = 1 << 20, most_shards: int = 8192) -> list:
    """Sort partial counts over the cluster, add up runs, write the shards; a row for each."""
    n = min(most_shards, parts_for(partial.count(), shard_rows, 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        (store, path), name = store_of(folder), f"counts-{context.partitionId():06d}"
        store.create_dir(path)
        own = f"{path}/_{name}-{context.taskAttemptId()}"
        first = last = None
        total, best = 0, {}
        sinks = [store.open_output_stream(own + kind) for kind in (".keys", ".counts")]

        def put(keys: np.ndarray, counts: np.ndarray) -> None:
            nonlocal first, last, total
            if not len(keys):
                return
            first, last, total = int(keys[0]) if first is None else first, int(keys[-1]), total + len(keys)
            for sink, x in zip(sinks, (keys, counts), strict=True):
                sink.write(x.astype("<i8").tobytes())
            ids, at = np.unique(keys >> 32, return_index=True)
            for i, most in zip(ids.tolist(), np.maximum.reduceat(counts, at).tolist(), strict=True):
                best[i] = max(best.get(i, 0), most)

        held_key, held_n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            keys, counts = (np.concatenate([h, batch.column(c).to_numpy()]) for h, c in ((held_key, "key"), (held_n, "n")))
            if len(keys):
                runs = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
                keys, counts = keys[runs], np.add.reduceat(counts, runs)
                put(keys[:-1], counts[:-1])
                held_key, held_n = keys[-1:], counts[-1:]  # its run may go on
        put(held_key, held_n)
        for sink, kind in zip(sinks, (".keys", ".counts"), strict=True):
            sink.close()
            if not total or store.get_file_info(f"{path}/{name}{kind}").type != fs.FileType.NotFound:
                store.delete_file(own + kind)  # empty, or the same file is there from an earlier run of this task
            else:
                store.move(own + kind, f"{path}/{name}{kind}")
        if total:
            ids = np.array(sorted(best), "<i8")
            row = [[first], [last], [f"{folder}/{name}"], [total], [ids.tobytes()], [np.array([best[i] for i in ids.tolist()], "<i8").tobytes()]]
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, kinds, strict=True)], ["first", "last", "path", "n", "ids", "best"])

    spread = partial.repartitionByRange(n, "key").sortWithinPartitions("key")
    return sorted(spread.mapInArrow(tidy(run), MANIFEST).collect(), key=lambda r: r["first"])  # ``most_shards`` rows at most


def count_pairs(partial: DataFrame, n_ids: int, folder: str | None = None, **options) -> tuple[list[tuple[int, int, str]], np.ndarray]:
    """Shards of corpus-wide counts (first key, rows, path) and the highest count of each of the ``n_ids`` ids of B."""
    folder = folder or shared_dir(partial.sparkSession)
    folder = folder if "://" in folder or folder.startswith("/") else folder.replace("file:", "", 1)
    rows = write_counts(partial, folder, **options)
    best = np.zeros(n_ids, np.int64)
    for r in rows:
        ids = np.frombuffer(r["ids"], "<i8")
        best[ids] = np.maximum(best[ids], np.frombuffer(r["best"], "<i8"))
    return [(r["first"], r["n"], r["path"]) for r in rows], best


def align(docs: DataFrame, a: str, b: str, folder: str | None = None, **options) -> DataFrame:
    """Align the tokens of every document (``a``: a tokenizers file of byte-level BPE, ``b``: a SentencePiece model) and
    weigh its links by the counts of all documents, as ``OUT``."""
    import sentencepiece

    found = stage(aligned(docs_of(docs), a, b))
    n_ids = sentencepiece.SentencePieceProcessor(model_file=b).get_piece_size()
    sent = docs.sparkSession.sparkContext.broadcast(count_pairs(found.where("key IS NOT NULL").select("key", "n"), n_ids, folder, **options))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts(*sent.value)
        for batch in batches:
            for k in range(batch.num_rows):
                rows = batch.column("rows").slice(k, 1).flatten()
                n_parts, parts_, n_links, links = (_unpack(batch.column(c)[k].as_py(), kind) for c, kind in _PACKED)
                each = np.cumsum(np.concatenate([[0], n_links]))
                of = np.cumsum(np.concatenate([[0], n_parts]))
                n_best, total = (pa.array(_over(_over(x, each)[parts_], of)) for x in counts.of(links))
                column = dict(zip(_ROW, rows.flatten(), strict=True))
                yield pa.RecordBatch.from_arrays([*(column[c] for c in _ROW[:-1]), n_best, total, column["groups_sha256"]], [*_ROW[:-1], "n_best", "count_sum", "groups_sha256"])

    return found.where("rows IS NOT NULL").select("rows", *(c for c, _ in _PACKED)).mapInArrow(tidy(run), OUT)

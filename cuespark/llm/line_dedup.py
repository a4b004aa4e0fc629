"""Line dedup: explode normalised lines, hash, count distinct documents per hash, drop, reassemble.

Pass 1 reads the texts, reduces each batch to ``(hash, documents)`` rows and sums them: a line that
occurs everywhere is one row per batch, so a hot line never gathers in a task.  Pass 2 reads the texts
again and drops lines.  While the table of frequent hashes is small (``broadcast_keys`` is checked
against its counted size) it is sent to the executors and no text is shuffled; beyond that, line
hashes, each once a slice of the input with its places, are joined with it, and the positions to drop
are joined back to their documents by id and 128-bit text hash.

Defined results: null or empty text is one empty line; empty keys (fewer than ``min_chars`` code
points) are never dropped; each input row is a document of its own, so repeated rows count repeatedly;
``n_chars`` is replaced if there is one, as its own type; an empty table gives an empty result; other
columns, whatever their names, are not read, or kept as they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuespark.llm.common import docs_of, raw_texts, stage, text_key, text_slices, tidy, with_key

OUT = "doc_id long, n_lines long, n_dropped long, kept_text string, kept_sha256 string"
_DIGEST = np.dtype([("hi", "<i8"), ("lo", "<i8")])


def line_key(line: bytes) -> bytes:
    """ASCII white space stripped at both ends, A-Z lower-cased."""
    return line.strip().lower()


def _hashes(lines: list[bytes], min_chars: int) -> tuple[np.ndarray, np.ndarray]:
    """128-bit hashes of the keys, and which keys are long enough to be dropped."""
    digest = xxhash.xxh128_digest
    keys = [line_key(x) for x in lines]
    able = np.array([len(k) >= min_chars and (min_chars <= 1 or len(k.decode()) >= min_chars) for k in keys], dtype=bool)
    return np.frombuffer(b"".join([digest(k) for k in keys]), dtype=_DIGEST), able


def _counts(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            seen = []
            for text in raw_texts(batch.column("text")):
                hashes, able = _hashes(text.split(b"\n"), min_chars)
                seen.append(np.unique(hashes[able]))
            keys, n = np.unique(np.concatenate(seen), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys["hi"]), pa.array(keys["lo"]), pa.array(n.astype(np.int64))], ["hi", "lo", "n"])

    return run


def _rebuild(batch: pa.RecordBatch, masks: list[np.ndarray], texts: list[bytes], whole: bool) -> pa.RecordBatch:
    """``OUT`` rows; or, for ``whole``, the batch with its texts (and ``n_chars``) replaced."""
    n_lines, n_dropped, kept_texts = [], [], []
    for text, drop in zip(texts, masks, strict=True):
        kept = text
        gone = int(drop.sum())
        if gone:
            lines = text.split(b"\n")
            kept = b"\n".join([lines[i] for i in np.flatnonzero(~drop)])
        n_lines.append(len(drop))
        n_dropped.append(gone)
        kept_texts.append(kept)
    decoded = [k.decode() for k in kept_texts]
    if whole:
        swapped = {"text": pa.array(decoded, pa.string()).cast(batch.column("text").type)}
        if "n_chars" in batch.schema.names:
            swapped["n_chars"] = pa.array([len(k) for k in decoded], pa.int64()).cast(batch.column("n_chars").type)
        return pa.RecordBatch.from_arrays([swapped.get(c, batch.column(c)) for c in batch.schema.names], batch.schema.names)
    digests = [hashlib.sha256(k).hexdigest() for k in kept_texts]
    columns = [pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(decoded, pa.string()), pa.array(digests, pa.string())]
    return pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "n_lines", "n_dropped", "kept_text", "kept_sha256"])


def _drop_known(frequent, min_chars: int, whole: bool):
    """Pass 2 while the frequent hashes fit a broadcast: they are sorted, membership is a binary search."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.frombuffer(frequent.value, dtype=_DIGEST)
        for batch in text_slices(batches):
            texts, masks = raw_texts(batch.column("text")), []
            for text in texts:
                hashes, drop = _hashes(text.split(b"\n"), min_chars)
                if len(known):
                    at = np.minimum(np.searchsorted(known["hi"], hashes["hi"]), len(known) - 1)
                    # 64-bit halves tie rarely: step over equal first halves until the second decides
                    hit = known[at] == hashes
                    tied = ~hit & (known["hi"][at] == hashes["hi"])
                    for i in np.flatnonzero(tied):
                        j = at[i]
                        while j < len(known) and known["hi"][j] == hashes["hi"][i]:
                            hit[i] |= known[j] == hashes[i]
                            j += 1
                    drop = drop & hit
                else:
                    drop = np.zeros(len(hashes), bool)
                masks.append(drop)
            yield _rebuild(batch, masks, texts, whole)

    return run


def _positions(min_chars: int):
    """A row for each distinct line of a slice, with all its places: a line that stands everywhere is one row a slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            doc, pos, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, _DIGEST)]
            for i, text in enumerate(raw_texts(batch.column("text"))):
                own, able = _hashes(text.split(b"\n"), min_chars)
                at = np.flatnonzero(able)
                doc.append(np.full(len(at), i))
                pos.append(at)
                hashes.append(own[at])
            line = np.concatenate(hashes)
            order = np.argsort(line, order=("hi", "lo"), kind="stable")
            keys, first = np.unique(line[order], return_index=True)
            doc, pos, offsets = np.concatenate(doc)[order], np.concatenate(pos)[order], pa.array(np.append(first, len(order)).astype(np.int32))
            ids, texts = (batch.column(c).take(pa.array(doc)) for c in ("doc_id", "text_key"))
            lists = [pa.ListArray.from_arrays(offsets, x) for x in (ids, texts, pa.array(pos))]
            yield pa.RecordBatch.from_arrays([pa.array(keys["hi"]), pa.array(keys["lo"]), *lists], ["hi", "lo", "doc", "key", "pos"])

    return run


def _drop_listed(whole: bool):
    """Rows ``row, drops``: the input row in one struct, so that its names clash with nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for packed in batches:
            inner, drops = pa.RecordBatch.from_struct_array(packed.column("row")), packed.column("drops").to_pylist()
            at = 0
            for batch in text_slices([inner]):
                texts, masks = raw_texts(batch.column("text")), []
                for text, places in zip(texts, drops[at : at + batch.num_rows], strict=True):
                    mask = np.zeros(text.count(b"\n") + 1, bool)
                    mask[np.array(places or [], dtype=np.int64)] = True
                    masks.append(mask)
                at += batch.num_rows
                yield _rebuild(batch, masks, texts, whole)

    return run


def drop_frequent_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, broadcast_keys: int = 1 << 21, whole: bool = False) -> DataFrame:
    """``doc_id, n_lines, n_dropped, kept_text, kept_sha256`` for each input row; or, for ``whole``, the
    input rows with all their columns, ``text`` (and ``n_chars``, if there is one) replaced."""
    rows = docs if whole else docs_of(docs)
    out = docs.schema if whole else OUT
    slim = docs_of(docs)
    frequent = (
        slim.select("text").mapInArrow(tidy(_counts(min_chars)), "hi long, lo long, n long")
        .groupBy("hi", "lo").agg(F.sum("n").alias("n")).where(F.col("n") >= min_docs).select("hi", "lo")
    )
    frequent = stage(frequent)
    if frequent.count() <= broadcast_keys:
        table = frequent.toArrow()
        known = np.empty(table.num_rows, dtype=_DIGEST)
        known["hi"], known["lo"] = table.column("hi").to_numpy(), table.column("lo").to_numpy()
        sent = docs.sparkSession.sparkContext.broadcast(np.sort(known).tobytes())
        return rows.mapInArrow(tidy(_drop_known(sent, min_chars, whole)), out)
    met = with_key(slim).mapInArrow(tidy(_positions(min_chars)), "hi long, lo long, doc array<long>, key array<string>, pos array<long>").join(frequent, ["hi", "lo"], "left_semi")
    places = met.select(F.explode(F.arrays_zip("doc", "key", "pos")).alias("p"))
    drops = places.groupBy(F.struct("p.doc", "p.key").alias("at")).agg(F.collect_set("p.pos").alias("drops"))
    at = F.struct(F.col("doc_id").cast("long").alias("doc"), text_key(F.col("text").cast("string")).alias("key"))  # nulls in structs are equal
    packed = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"), at.alias("at"))
    return packed.join(drops, "at", "left").select("row", "drops").mapInArrow(tidy(_drop_listed(whole)), out)

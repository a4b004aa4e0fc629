"""BPE encoding by backtracking over longest matches, and decoding by an offset table.

Encoding one piece (a pre-token) in time linear in its length:

1. an Aho-Corasick automaton over the vocabulary reports every token occurrence; the longest token
   starting at each byte is kept;
2. tokens are taken greedily; a token is accepted if it is *compatible* with the one before it, i.e. if
   the merge rules, applied to the two side by side, would leave exactly this boundary in place;
3. if not, the next shorter token that is a prefix of it is tried; when none is left the previous token
   is shortened in turn.  A bit per position remembers starts already known to fail.

A sequence whose neighbouring pairs are all compatible is the one that the merges produce, so the
result equals the merge loop's.  Compatibility is decided by undoing merges from the boundary outwards
and memoised.  Pieces repeat, so their ids are kept in a table that is bounded by bytes.  Which characters are
letters, numbers or white space is fixed below U+0100; above, it is asked of the vocabulary's own pre-tokenizer, one
probe for each character that occurs: pattern libraries know other versions of Unicode than it does.

Defined results: null text encodes as empty; the added tokens of the vocabulary file are matched in the
text first, as the tokenizers library does by default; repeated rows and null ids each get a row; columns
other than the id and the text, whatever their names, are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from string import ascii_letters

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cuespark.llm.common import docs_of, raw_texts, text_slices, tidy
from cuespark.llm.words import Known, latin, latin_pieces

#: The byte-level alphabet's printable bytes stand for themselves, the others follow from 256 on.
PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
#: The pre-token rule of byte-level BPE over characters of classes: ``a`` a letter, ``1`` a number, tab white space, ``!``
#: anything else; ASCII letters, the space and the apostrophe stand for themselves.
PIECE = re.compile(r"'(?:[stmd]|re|ve|ll)| ?[a-zA-Z]+| ?1+| ?[!']+|[\t ]+(?![^\t ])|[\t ]+")


class Classes(dict):
    """The class of each code point, as ``str.translate`` asks for it, found out by what the pre-tokenizer joins it to."""

    def __init__(self, pieces: Callable[[str], list]):
        super().__init__({ord(c): c for c in "' " + ascii_letters})
        self.pieces = pieces

    def __missing__(self, code: int) -> str:
        found = next((kind for kind in "a1!" if len(self.pieces(kind + chr(code))) == 1), "\t")
        self[code] = found
        return found


def piece_finder(vocabulary: str) -> Callable[[str], list[str]]:
    """Splits texts in the pre-tokens of the vocabulary's pre-tokenizer."""
    from tokenizers import Tokenizer

    classes = Classes(Tokenizer.from_file(vocabulary).pre_tokenizer.pre_tokenize_str)
    return lambda text: latin_pieces(text) if latin(text) else [text[slice(*m.span())] for m in PIECE.finditer(text.translate(classes))]


def byte_alphabet() -> dict[str, int]:
    others = [b for b in range(256) if b not in set(PRINTABLE)]
    return {chr(b): b for b in PRINTABLE} | {chr(256 + i): b for i, b in enumerate(others)}


class Codec:
    """A byte-level BPE vocabulary with its encoder and decoder."""

    def __init__(self, path: str):
        import ahocorasick
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in merges]
        self.token_bytes = {i: bytes(alphabet[c] for c in t) for t, i in vocab.items()}
        merged = {vocab[a + b]: (vocab[a], vocab[b]) for a, b in merges}
        # rank: bytes first, then tokens in the order of their merges; all tables below are by rank
        order = [i for i in self.token_bytes if i not in merged] + [vocab[a + b] for a, b in merges]
        rank = {i: r for r, i in enumerate(order)}
        self.id_of = order
        self.halves = [(rank[merged[i][0]], rank[merged[i][1]]) if i in merged else (r, r) for r, i in enumerate(order)]
        self.pair = {(rank[a], rank[b]): rank[i] for i, (a, b) in merged.items()}
        self.bytes_of = [self.token_bytes[i] for i in order]
        self.length = [len(b) for b in self.bytes_of]
        by_bytes = {b: r for r, b in enumerate(self.bytes_of)}
        self.shorter = [next((by_bytes[b[:n]] for n in range(len(b) - 1, 0, -1) if b[:n] in by_bytes), -1) for b in self.bytes_of]
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_STRING)
        for r, b in enumerate(self.bytes_of):
            self.automaton.add_word(b.decode("latin-1"), r)
        self.automaton.make_automaton()
        self.packed = [int(i).to_bytes(4, "little") for i in order]
        self.pieces = piece_finder(path)
        self.specials = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self.fits: dict[tuple[int, int], bool] = {}
        self.known = Known(lambda found: map(self._encode_piece, found), 24 << 20)
        # decoding: one blob of all token bytes and the offsets of each id in it
        size = max([*self.token_bytes, *self.added.values()]) + 1
        texts = [b""] * size
        for i, b in self.token_bytes.items():
            texts[i] = b
        for t, i in self.added.items():
            texts[i] = t.encode()
        self.offsets = np.zeros(size + 1, np.int64)
        np.cumsum([len(b) for b in texts], out=self.offsets[1:])
        self.blob = np.frombuffer(b"".join(texts), np.uint8)

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the bytes of ``left + right`` keeps a boundary between exactly these two tokens."""
        key = (left, right)
        known = self.fits.get(key)
        if known is None:
            if len(self.fits) > 500_000:
                self.fits.clear()
            known = self.fits[key] = self._boundary_holds(left, right)
        return known

    def _boundary_holds(self, left: int, right: int) -> bool:
        # undo the later-made of the two border tokens step by step; a merge across the border that
        # ranks before the token just undone would have been applied first and broken the boundary
        pair, halves = self.pair.get, self.halves
        limit = len(halves)
        while True:
            across = pair((left, right))
            if across is not None and across < limit:
                return False
            if left > right:
                limit = left
                left = halves[left][1]
                if left != limit:
                    continue
                limit = right + 1
                right = halves[right][0]
                if right + 1 == limit:
                    return True
            else:
                limit = right + 1
                right = halves[right][0]
                if right + 1 != limit:
                    continue
                limit = left
                left = halves[left][1]
                if left == limit:
                    return True

    def longest(self, text: bytes) -> list[int]:
        """The longest token starting at each byte (its rank)."""
        out, length = [-1] * len(text), self.length
        for end, r in self.automaton.iter(text.decode("latin-1")):
            out[end - length[r] + 1] = r  # ends ascend, so the last match from a start is its longest
        return out

    def ranks(self, text: bytes) -> list[int]:
        """The tokens of one piece."""
        n, first, length, shorter, compatible = len(text), self.longest(text), self.length, self.shorter, self.compatible
        dead = bytearray(n + 1)
        tokens: list[int] = []
        at, token = 0, first[0] if n else -1
        while at < n:
            end = at + length[token]
            if not dead[end] and (not tokens or compatible(tokens[-1], token)):
                tokens.append(token)
                at = end
                token = first[at] if at < n else -1
                continue
            token = shorter[token]
            while token < 0:
                dead[at] = 1
                token = tokens.pop()
                at -= length[token]
                token = shorter[token]
        return tokens

    def _encode_piece(self, piece: str) -> bytes:
        packed = self.packed
        return b"".join([packed[r] for r in self.ranks(piece.encode())])

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        return [b"".join(x) for x in self._by_added(texts)] if any(t in text for text in texts for t in self.added) else self._plain(texts)

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def _by_added(self, texts: list[str]) -> Iterator[list[bytes]]:
        for text in texts:
            found = [p for p in self.specials.split(text) if p]
            plain = iter(self._plain([p for p in found if p not in self.added]))
            yield [self.added[p].to_bytes(4, "little") if p in self.added else next(plain) for p in found]

    def _plain(self, texts: list[str]) -> list[bytes]:
        return self.known.results([self.pieces(t) for t in texts])

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the ids; the library's text is these bytes with faults replaced (``errors='replace'``)."""
        ids = ids.astype(np.int64)
        starts = self.offsets[ids]
        sizes = self.offsets[ids + 1] - starts
        ends = np.cumsum(sizes)
        if not len(ids) or not ends[-1]:
            return b""
        where = np.arange(ends[-1]) + np.repeat(starts - ends + sizes, sizes)
        return self.blob[where].tobytes()


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One codec for each vocabulary and Python worker."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encode_column(docs: DataFrame, vocabulary: str) -> DataFrame:
    """``doc_id, ids`` (array of int) for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary)
        for batch in text_slices(batches):
            ids = [np.frombuffer(p, "<u4").astype(np.int32) for p in c.encode_all([t.decode() for t in raw_texts(batch.column("text"))])]
            offsets = np.cumsum([0, *map(len, ids)], dtype=np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(offsets, np.concatenate(ids))], ["doc_id", "ids"])

    return docs_of(docs).mapInArrow(tidy(run), "doc_id long, ids array<int>")


def round_trip(docs: DataFrame, vocabulary: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: every text encoded, then decoded from its ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary)
        for batch in text_slices(batches):
            packed = c.encode_all([t.decode() for t in raw_texts(batch.column("text"))])
            decoded = [c.decode(np.frombuffer(p, "<u4")).decode("utf-8", "replace").encode() for p in packed]
            columns = [[len(p) // 4 for p in packed], [hashlib.sha256(p).hexdigest() for p in packed], [hashlib.sha256(d).hexdigest() for d in decoded]]
            arrays = [pa.array(x, kind) for x, kind in zip(columns, (pa.int64(), pa.string(), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs_of(docs).mapInArrow(tidy(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")

"""Word-level VTT as whole Arrow batches: the rows of ``cues.word_vtt``, whose SQL visits every word several times."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType

from cuespark.operators import sentences as S
from cuespark.sources.cues import LONE_CR, STAMP

# The patterns of ``cues``, as Python has them.
_SPACE = f"[{re.escape(S.SPACES)}]"
_TIME = re.compile(rf"({STAMP}){_SPACE}*-->{_SPACE}*({STAMP})")
_LINE = re.compile(r"\n([^\n]*?<c>[^\n]*?</c>[^\n]*)")
_WORD = re.compile(rf"<({STAMP})>([^<]*)")
_BLOCK_END, _CR = re.compile(r"\n\n+"), re.compile(LONE_CR)


def _words(content: str, texts: list[str], starts: list[str], ends: list[str]) -> None:
    """Append the words of a text and the times around them, blank words too."""
    if "\r" in content:
        content = _CR.sub("\n", content)
    for block in _BLOCK_END.split(content.strip(S.SPACES)):
        block = block.strip(S.SPACES)
        edges = _TIME.match(block)
        line = edges and _LINE.search(block)
        if line:
            found = _WORD.findall(f"<{edges[1]}>{line[1].replace('<c>', '').replace('</c>', '')}<{edges[2]}>")
            times = [at for at, _ in found]
            starts += times[:-1]
            ends += times[1:]
            texts += [word.strip(S.SPACES) for _, word in found[:-1]]


def milliseconds(stamps: list[str]) -> np.ndarray:
    """``HH:MM:SS.mmm`` by floating point, truncated, as ``cues`` does it."""
    digit = np.frombuffer("".join(stamps).encode(), np.uint8).reshape(-1, 12).astype(np.int64) - ord("0")
    number = lambda *at: sum(digit[:, a] * 10**k for k, a in enumerate(reversed(at)))
    seconds = number(6, 7, 9, 10, 11) / 1000.0
    return (number(0, 1) * 3_600_000.0 + number(3, 4) * 60_000.0 + seconds * 1000.0).astype(np.int64)


def parsed(content: pa.Array) -> pa.Array:
    texts: list[str] = []
    starts: list[str] = []
    ends: list[str] = []
    bounds = [0]
    for text in content.to_pylist():
        if text is not None:
            _words(text, texts, starts, ends)
        bounds.append(len(texts))
    start, end = milliseconds(starts), milliseconds(ends)
    row = np.repeat(np.arange(len(content)), np.diff(bounds))
    kept = np.flatnonzero(np.fromiter(map(bool, texts), bool, len(texts)))
    order = kept[np.lexsort((end[kept], start[kept], row[kept]))]
    sizes = np.bincount(row[order], minlength=len(content))
    first = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    place = np.arange(len(order)) - np.repeat(first[:-1], sizes)
    return S.lists(first, ord=pa.array(place, pa.int32()), text=pa.array(texts, pa.string()).take(pa.array(order)), start_ms=pa.array(start[order]), end_ms=pa.array(end[order]))


words_udf = F.arrow_udf(parsed, ArrayType(S.struct_type(ord=IntegerType(), text=StringType(), start_ms=LongType(), end_ms=LongType())))

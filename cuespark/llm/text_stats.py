"""Statistics of whole texts, computed a slice of documents at a time."""

from __future__ import annotations

from collections import defaultdict
from itertools import count

import numpy as np

SPACES = [0x20, *range(0x09, 0x0E)]
SYMBOLS = b"#*$%&|<>"
#: A text's repeated words are those in windows of this many words that occur twice or more in it.
WINDOW = 5
FIELDS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_chars", "n_lines", "n_upper", "n_digits", "n_punct", "n_bytes", "n_ended", "n_distinct"]
_CONTINUED = np.arange(0x80, 0xC0)
_PUNCT = [*b".,;:!?'\"()-"]
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)


def repeated_words(ids: np.ndarray, doc: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Which words lie in a window whose words occur twice or more in the same document.

    ``ids``: a number for each word, ``doc``: the document of each word, ascending.  Windows are sorted
    by a 64-bit hash and neighbours compared word by word; should different windows share a hash, the
    whole slice is compared by its words instead.
    """
    n = len(ids) - window + 1
    hit = np.zeros(len(ids), bool)
    if n < 1:
        return hit
    inside = doc[:n] == doc[window - 1 :]
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * _ODD[0]
    mixed ^= mixed >> np.uint64(29)
    hashed = (doc[:n].astype(np.uint64) + np.uint64(7)) * _ODD[1]
    for k in range(window):
        hashed = hashed * _ODD[2] + (mixed[k : n + k] ^ (mixed[k : n + k] << np.uint64(k + 1)))
    hashed ^= hashed >> np.uint64(31)
    starts = np.flatnonzero(inside)
    order = starts[np.argsort(hashed[starts], kind="stable")]
    same = hashed[order[1:]] == hashed[order[:-1]]
    a, b = order[:-1][same], order[1:][same]
    equal = doc[a] == doc[b]
    for k in range(window):
        equal &= ids[a + k] == ids[b + k]
    if not equal.all():
        rows = np.column_stack([doc[starts], *[ids[starts + k] for k in range(window)]])
        _, inverse, n_same = np.unique(rows, axis=0, return_inverse=True, return_counts=True)
        found = starts[n_same[inverse.ravel()] > 1]
    else:
        found = np.concatenate([a, b])
    marks = np.zeros(len(ids) + 1, np.int64)
    np.add.at(marks, np.unique(found), 1)
    cover = np.cumsum(marks[:-1])
    cover[window:] -= cover[:-window].copy()
    return cover > 0


def statistics(texts: list[bytes]) -> np.ndarray:
    """One row of ``FIELDS`` for each text."""
    out = np.zeros((len(texts), len(FIELDS)), np.int64)
    vocabulary: dict[bytes, int] = defaultdict(count().__next__)
    word_ids, sizes = [], []
    for i, text in enumerate(texts):
        words = text.split()
        ids = np.fromiter(map(vocabulary.__getitem__, words), np.int64, len(words))
        word_ids.append(ids)
        sizes.append(len(words))
        freq = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
        chars = len(text) - int(freq[_CONTINUED].sum())
        lines = text.split(b"\n")
        worded = [x for x in lines if x.strip()]
        ended = sum(x.rstrip()[-1:] in (b".", b"!", b"?", b'"') for x in worded)
        out[i] = (
            len(words), chars - int(freq[SPACES].sum()), int(freq[[*SYMBOLS]].sum()), len(worded) - len({*worded}), 0,
            chars, len(worded), int(freq[65:91].sum()), int(freq[48:58].sum()), int(freq[_PUNCT].sum()), len(text), ended, len(np.unique(ids)),
        )
    if sum(sizes):
        ids, doc = np.concatenate(word_ids), np.repeat(np.arange(len(texts)), sizes)
        out[:, 4] = np.bincount(doc[repeated_words(ids, doc)], minlength=len(texts))
    return out

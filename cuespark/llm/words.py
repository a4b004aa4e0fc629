"""Cutting texts where byte-pair encoders cut them anyway, so that repeated pieces are encoded once.

Byte-level BPE splits a text in pre-tokens, and no pre-token goes on from a character that is not white space to a
space; a SentencePiece vocabulary without such a token (``PieceCodec`` looks) never merges across that border either.
So a text is cut before every space that follows anything but white space, each part is encoded by itself, and the ids
of the parts in a row are those of the whole text.  Only white space matters here, whose set no longer changes; which
characters are letters or numbers is left to the tokenizer, but for those below U+0100 (``latin_pieces``), whose classes
are fixed.

``Known`` keeps results of parts in a worker, bounded by bytes.
"""

from __future__ import annotations

import re

from collections.abc import Callable, Iterable

import numpy as np

#: White space of any table, old ones and format characters included, and the sign that SentencePiece takes for a space:
#: no cut follows any of it.
_LAST = frozenset(c for c in map(chr, range(0x3001)) if c.isspace()) | {"\u180e", "\u200b", "\ufeff", "\u2581"}
#: Longer parts are encoded each time and not kept.
LONGEST = 64


_UNEVEN = re.compile("[" + re.escape("".join(sorted(_LAST))) + r"](?: |\Z)|^(?: |\Z)").search
#: Letters, numbers and white space below U+0100.
_L, _N, _S = "a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
#: The pre-tokens of byte-level BPE in a text of characters below U+0100.
latin_pieces = re.compile(f"'(?:[stmd]|re|ve|ll)| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+").findall
_SIMPLE = re.compile(f" [{_L}]+").fullmatch


def latin(text: str) -> bool:
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def simple(piece: str) -> bool:
    """A space and letters below U+0100: such pieces may stand side by side."""
    return _SIMPLE(piece) is not None


_ASCII_LAST = [c + " " for c in sorted(_LAST) if c.isascii()]


def _uneven(text: str) -> bool:
    """Whether some space follows white space or nothing, or white space ends the text."""
    if text.isascii():
        return not text or text[0] == " " or text[-1] in _LAST or any(two in text for two in _ASCII_LAST)
    return _UNEVEN(text) is not None


def parts(text: str) -> list[str]:
    """``text`` cut at the spaces that follow anything but white space; these spaces are left out:
    ``" ".join(parts(text)) == text``."""
    words = text.split(" ")
    if not _uneven(text):
        return words
    out: list[str] = []
    held: list[str] = []
    for w in words:
        held.append(w)
        if w and w[-1] not in _LAST:
            out.append(" ".join(held))
            held = []
    if held:
        out.append(" ".join(held))
    return out


def alone(part: str) -> bool:
    """Whether a part's ids depend on its being the last one (its end is no place for a cut)."""
    return not part or part[-1] in _LAST


def joined_ids(found: list[str], encode: Callable[[list[str]], list[list[int]]], lengths: np.ndarray, together: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Ids of a space and each part in a row, and how many of them each part has.

    ``encode`` gives the ids of a space and each text.  Parts go to it joined by spaces and are told apart again by the
    bytes of their tokens (``lengths`` by id); where these are not the text's, and for parts that stand ``alone``, one
    by one."""
    single = [i for i, p in enumerate(found) if alone(p)]
    edges = sorted({0, len(found), *range(0, len(found), together), *single, *(i + 1 for i in single)})
    groups = [found[a:b] for a, b in zip(edges, edges[1:], strict=False)]
    ids, counts = [], []
    for group, flat in zip(groups, encode([" ".join(g) for g in groups]), strict=True):
        flat = np.array(flat, np.int64)
        if len(group) > 1:
            ends, stops = np.cumsum(lengths[flat]), np.cumsum([1 + len(p.encode()) for p in group])
            last = np.searchsorted(ends, stops)
            if not len(flat) or last[-1] != len(flat) - 1 or (ends[last] != stops).any():
                single = encode(group)
                flat, last = np.array([i for x in single for i in x], np.int64), np.cumsum([*map(len, single)]) - 1
            counts.append(np.diff(last, prepend=-1))
        else:
            counts.append(np.array([len(flat)]))
        ids.append(flat)
    return np.concatenate([np.zeros(0, np.int64), *ids]), np.concatenate([np.zeros(0, np.int64), *counts])


class Known:
    """Results by part, in two tables: beyond ``max_bytes`` (parts, results and their overhead) the younger one becomes the
    older one, whose parts come back when they are met again."""

    def __init__(self, solve: Callable[[list[str]], Iterable[bytes]], max_bytes: int = 128 << 20):
        self.solve, self.max_bytes, self.held = solve, max_bytes, 0
        self.table: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def results(self, texts: list[list[str]]) -> list[bytes]:
        """The joined results of the parts of each text."""
        table, old = self.table, self.old
        missing = set().union(*texts).difference(table)
        back = {p: old[p] for p in missing if p in old}
        new = [p for p in missing if p not in back] if back else [*missing]
        for at in range(0, len(new), 8192):
            group = new[at : at + 8192]
            back.update(zip(group, self.solve(group), strict=True))
        once = {p: back.pop(p) for p in [p for p in back if len(p) > LONGEST]}
        table.update(back)
        self.held += 160 * len(back) + 2 * sum(map(len, back)) + sum(map(len, back.values()))
        find = {**table, **once}.__getitem__ if once else table.__getitem__
        out = [b"".join(map(find, t)) for t in texts]
        if self.held > self.max_bytes:
            self.old, self.table, self.held = table, {}, 0
        return out

"""Suffix arrays in numpy: Larsson-Sadakane refinement, Kasai common prefixes, search in another shard.

A shard's text is a sequence of byte fragments; symbol 0 ends each, bytes count from 1.  Each of these
ends counts as a symbol of its own, smaller in earlier fragments, so all suffixes differ by the end of
their fragment and the order is complete - which Kasai's argument (one position on, the common prefix
shortens by one at most) needs even though common prefixes are only counted up to ``depth``.
"""

from __future__ import annotations

import numpy as np

#: Symbols packed in one 63-bit number, nine bits each.
PACK = 7


def packed(symbols: np.ndarray) -> np.ndarray:
    """At each position its next ``PACK`` symbols as one number (zeros beyond the end)."""
    padded = np.concatenate([symbols.astype(np.int64), np.zeros(PACK, np.int64)])
    out = np.zeros(len(symbols), np.int64)
    for k in range(PACK):
        out = (out << 9) | padded[k : k + len(symbols)]
    return out


class SuffixArray:
    def __init__(self, fragments: list[bytes], depth: int):
        self.depth = depth
        self.sizes = np.array([len(f) for f in fragments], np.int64)
        self.starts = np.cumsum(self.sizes + 1) - self.sizes - 1
        symbols = np.zeros(int((self.sizes + 1).sum()), np.int16)
        inside = np.ones(len(symbols), bool)
        inside[self.starts + self.sizes] = False
        symbols[inside] = np.frombuffer(b"".join(fragments), np.uint8).astype(np.int16) + 1
        self.left = np.repeat(self.starts + self.sizes, self.sizes + 1) - np.arange(len(symbols))  # bytes to the fragment's end
        cut = 9 * np.maximum(PACK - self.left, 0)
        self.head = packed(symbols) >> cut << cut  # nothing beyond the end
        self.order, self.rank = self._refine()
        self.common = self._kasai()
        del self.left, self.rank  # what searching needs is kept: 20 bytes a symbol

    def _refine(self) -> tuple[np.ndarray, np.ndarray]:
        """Larsson-Sadakane: groups of equal prefixes are numbered by their last place; groups that hold
        more than one suffix are sorted by the group of the suffix h places on, and h doubles."""
        n = len(self.head)
        order = np.argsort(self.head)
        short = np.flatnonzero(self.left[order] < PACK)  # suffixes that end within the head: in the order of their fragments
        order[short] = order[short][np.lexsort((order[short], self.head[order[short]]))]
        rank = np.empty(n, np.int64)

        def number(at: np.ndarray, change: np.ndarray) -> np.ndarray:
            """Number the groups of the places ``at`` (ascending), which end where ``change`` is true;
            the places in groups of more than one."""
            last = np.flatnonzero(change)
            size = np.diff(last, prepend=-1)
            rank[order[at]] = np.repeat(at[last], size)
            return at[np.repeat(size, size) > 1]

        keys, ends = self.head[order], self.left[order] < PACK
        h, places = PACK, number(np.arange(n), np.append((keys[1:] != keys[:-1]) | ends[1:], True))
        while len(places):
            suffix = order[places]
            key = rank[suffix] * (n + 1) + rank[suffix + h] + 1  # h symbols on is within the fragment or its end
            by = np.argsort(key)
            order[places], key = suffix[by], key[by]
            places = number(places, np.append(key[1:] != key[:-1], True))
            h *= 2
        final = np.empty(n, np.int64)
        final[order] = np.arange(n)
        return order, final

    def _kasai(self) -> np.ndarray:
        """Common prefix, up to ``depth``, of each suffix of ``depth`` bytes or more with the one before it;
        0 for shorter ones, which share less with anything.  Fragments go in lock step: one position on in a
        fragment shortens the common prefix by one at most."""
        order, rank, depth = self.order, self.rank, self.depth
        common = np.zeros(len(order), np.int32)
        lanes = np.argsort(-self.sizes, kind="stable")
        held, long = np.zeros(len(lanes), np.int64), np.maximum(self.sizes[lanes] - depth + 1, 0)
        for t in range(int(long.max()) if len(lanes) else 0):
            active = int(np.searchsorted(-long, -t, side="left"))
            here = self.starts[lanes[:active]] + t
            place = rank[here]
            other = order[np.maximum(place - 1, 0)]
            size = np.where(place > 0, np.maximum(held[:active] - 1, 0), 0)
            size += extend(self.head, here + size, self.head, other + size, np.where(place > 0, depth - size, 0))
            held[:active] = size
            common[place] = size
        return common

    def windows(self, length: int) -> np.ndarray:
        """Positions where ``length`` bytes of one fragment begin, as a mask."""
        flags = np.zeros(len(self.head) + 1, np.int32)
        able = self.sizes >= length
        np.add.at(flags, self.starts[able], 1)
        np.add.at(flags, self.starts[able] + self.sizes[able] - length + 1, -1)
        return np.cumsum(flags[:-1]) > 0

    def classes(self, length: int) -> np.ndarray:
        """A number for each place of the order: suffixes with ``length`` symbols in common share it."""
        return np.cumsum(self.common < length) - (0 if self.common[0] < length else 1)

    def find(self, other: SuffixArray, positions: np.ndarray, length: int) -> np.ndarray:
        """Places in this order of suffixes that begin with the ``length`` symbols at ``positions`` of
        ``other``; -1 where there is none.  Binary search, all positions at once."""
        low, high = np.zeros(len(positions), np.int64), np.full(len(positions), len(self.order))
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                break
            middle = (low[open_] + high[open_]) >> 1
            less = self._less(self.order[middle], other, positions[open_], length)
            low[open_[less]] = middle[less] + 1
            high[open_[~less]] = middle[~less]
        at = np.minimum(low, len(self.order) - 1)
        same = extend(self.head, self.order[at], other.head, positions, np.full(len(positions), length)) >= length
        return np.where(same, at, -1)

    def _less(self, mine: np.ndarray, other: SuffixArray, theirs: np.ndarray, length: int) -> np.ndarray:
        """Whether suffixes of this shard are smaller than those of the other within ``length`` symbols."""
        same = extend(self.head, mine, other.head, theirs, np.full(len(mine), length))
        a, b = np.minimum(mine + same, len(self.head) - 1), np.minimum(theirs + same, len(other.head) - 1)
        x = np.where(mine + same < len(self.head), self.head[a] >> 54, 0)
        y = np.where(theirs + same < len(other.head), other.head[b] >> 54, 0)
        return (same < length) & (x < y)


def extend(head_a: np.ndarray, a: np.ndarray, head_b: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Length of the equal run from ``a`` in one text and ``b`` in another, at most ``most`` symbols."""
    size, live = np.zeros(len(a), np.int64), np.flatnonzero(most > 0)
    a, b, last_a, last_b = a[live], b[live], len(head_a) - 1, len(head_b) - 1
    while len(live):
        inside = (a <= last_a) & (b <= last_b)
        if not inside.all():
            live, a, b = live[inside], a[inside], b[inside]
        differ = head_a[a] ^ head_b[b]
        # equal leading nine-bit symbols: all seven, or as many as the highest differing bit leaves
        size[live] += np.where(differ == 0, PACK, PACK - 1 - np.searchsorted(_SYMBOL_BITS, differ, side="right"))
        more = (differ == 0) & (size[live] < most[live])
        live, a, b = live[more], a[more] + PACK, b[more] + PACK
    return np.minimum(size, most)


#: The lowest number with a bit in the second, third, ... symbol from below.
_SYMBOL_BITS = np.array([1 << (9 * k) for k in range(1, PACK)], np.int64)

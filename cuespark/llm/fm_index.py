"""A compressed FM-index over word numbers: entropy-shaped wavelet tree, bounded-context order, backward search.

Suffixes are ordered by their first ``context`` words (prefix doubling), which is all that patterns of up
to that length can tell apart: the interval of such a pattern is contiguous, and one backward step maps
it to the interval of the pattern with one more word in front.  The transformed text is kept as a wavelet
tree in which a word that makes up a share p of it takes about -log2(p) bits, with running counts for
every 64 of them.  The order itself and the ranks it came from are not kept: an interval is known by
searching for it.
"""

from __future__ import annotations

import numpy as np

ONE = np.uint64(1)


class Bits:
    """A bit vector with rank: ones before a position."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little").tobytes()
        self.words = np.frombuffer(packed + bytes(16 - len(packed) % 8), "<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)[:-1]]).astype(np.uint32)

    def ones(self, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        low = self.words[word] & ((ONE << (at & 63).astype(np.uint64)) - ONE)
        return self.before[word].astype(np.int64) + np.bitwise_count(low)


def codes_for(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix-free codes of -log2(share) bits, rounded up: lengths and codes, both 0 where nothing occurs,
    and the symbols that occur in the order of their codes."""
    lengths, codes = np.zeros(len(counts), np.int64), np.zeros(len(counts), np.int64)
    present, total = np.flatnonzero(counts), int(counts.sum())
    bits = np.maximum(1, np.ceil(np.log2(total / counts[present])).astype(np.int64))
    bits += counts[present] << bits < total  # rounding: a code never takes more than its share
    order = np.argsort(bits, kind="stable")
    symbols, bits = present[order], bits[order]
    ends = np.cumsum(np.int64(1) << (bits[-1] - bits)) if len(bits) else bits
    codes[symbols] = (ends - (np.int64(1) << (bits[-1:] - bits))) >> (bits[-1:] - bits)
    lengths[symbols] = bits
    return lengths, codes, symbols


class Wavelet:
    """Rank of any symbol over a sequence.

    Level k has the k-th code bit of all elements whose code is longer than k; elements with the same k bits
    before it stand together (a node).  ``start[k]`` is where a symbol's node begins, ``ones[k]`` the ones before.
    """

    def __init__(self, symbols: np.ndarray, size: int):
        counts = np.bincount(symbols, minlength=size)
        self.length, codes, names = codes_for(counts)
        deepest = int(self.length.max(initial=0))
        aligned = codes << (deepest - self.length)
        self.code = aligned
        self.deepest, self.bits, self.start, self.ones = deepest, [], [], []
        for level in range(deepest):
            shift = deepest - 1 - level
            bit = ((aligned[symbols] >> shift) & 1).astype(bool)
            bits = Bits(bit)
            start = np.zeros(size, np.int32)
            prefix = aligned[names] >> (shift + 1)
            node = np.flatnonzero(np.diff(prefix, prepend=-1))
            total = np.cumsum(counts[names]) - counts[names]
            start[names] = np.repeat(total[node], np.diff(np.append(node, len(names))))
            self.bits.append(bits)
            self.start.append(start)
            self.ones.append(bits.ones(start.astype(np.int64)).astype(np.int32))
            # zeros first, then ones; codes that end here are not needed below
            deeper = self.length > level + 1
            go = deeper[symbols]
            symbols = np.concatenate([symbols[~bit & go], symbols[bit & go]])
            side, on = ((aligned[names] >> shift) & 1).astype(bool), deeper[names]
            names = np.concatenate([names[~side & on], names[side & on]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of ``symbol`` before ``at``, elementwise."""
        out = np.where(self.length[symbol] > 0, at, 0)
        live, length, code = np.arange(len(symbol)), self.length[symbol], self.code[symbol]
        for level in range(self.deepest):
            on = length > level
            if not on.all():
                live, length, code, symbol = live[on], length[on], code[on], symbol[on]
            if not len(live):
                break
            inside = out[live]
            ones = self.bits[level].ones(self.start[level][symbol] + inside) - self.ones[level][symbol]
            out[live] = np.where((code >> (self.deepest - 1 - level)) & 1, ones, inside - ones)
        return out


def dense(keys: np.ndarray) -> np.ndarray:
    """Order-preserving numbers from 0 of the distinct keys."""
    order = np.argsort(keys)
    ordered = keys[order]
    out = np.empty(len(keys), np.int64)
    out[order] = np.cumsum(np.concatenate([[0], ordered[1:] != ordered[:-1]]))
    return out


class FmIndex:
    """Index of ``text`` (numbers from 1; 0 separates) for patterns of up to ``context`` words.

    ``values`` has a number for each position of the text; ``least`` gives the smallest in an interval.
    """

    def __init__(self, text: np.ndarray, context: int, values: np.ndarray, size: int | None = None):
        n, self.context, self.n = len(text), context, len(text)

        def shifted(rank: np.ndarray, by: int) -> np.ndarray:
            return np.concatenate([rank[by:], np.zeros(min(by, n), np.int64)])[:n]

        def joined(a: np.ndarray, b: np.ndarray, by: int) -> np.ndarray:
            """Ranks by the words of a and then by b's, which begin ``by`` words on."""
            return dense(a * (int(b.max()) + 2) + shifted(b + 1, by))

        by_size = {1: text.astype(np.int64)}

        def ranks(size: int) -> np.ndarray:
            if size not in by_size:
                half = 1 << ((size - 1).bit_length() - 1)
                by_size[size] = joined(ranks(half), ranks(size - half), half)
            return by_size[size]

        order = np.argsort(ranks(context))
        size = max(int(text.max()) + 1, size or 0)
        self.wavelet = Wavelet(text[order - 1].astype(np.int64), size)  # the word in front; position 0 has the last separator
        self.smaller = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=size))])
        self.values = values[order]
        self.common = self._common(text, order)
        self.groups: dict[int, tuple[Bits, np.ndarray]] = {}

    def _common(self, text: np.ndarray, order: np.ndarray) -> np.ndarray:
        """Words (fewer than the context) that each suffix shares with the one before it in the order."""
        common, live = np.zeros(self.n, np.uint8), np.arange(1, self.n)
        for k in range(self.context - 1):
            a, b = order[live] + k, order[live - 1] + k
            inside = np.maximum(a, b) < self.n
            live, a, b = live[inside], a[inside], b[inside]
            live = live[text[a] == text[b]]
            common[live] += 1
        return common

    def widen(self, low: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
        """Interval of all suffixes that share their first ``words`` words, fewer than the context, with those at ``low``."""
        if words not in self.groups:
            change = self.common < words
            change[0] = True
            self.groups[words] = Bits(change), np.append(np.flatnonzero(change), self.n).astype(np.int32)
        bits, starts = self.groups[words]
        g = bits.ones(low + 1)
        return starts[g - 1].astype(np.int64), starts[g].astype(np.int64)

    def step(self, word: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the patterns with ``word`` in front; empty where low = high."""
        both = np.concatenate([word, word])
        found = self.wavelet.rank(both, np.concatenate([low, high])) + self.smaller[both]
        return found[: len(word)], found[len(word) :]

    def least(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The smallest value in each interval; intervals of one pattern length are equal or disjoint."""
        if not len(low):
            return self.values[:0]
        starts, back = np.unique(low, return_inverse=True)
        ends = np.empty(len(starts), np.int64)
        ends[back] = high
        bounds = np.column_stack([starts, np.minimum(ends, self.n - 1)]).ravel()
        out = np.minimum.reduceat(self.values, bounds)[::2]
        last = ends == self.n  # reduceat has no index n: this interval goes to the end
        out[last] = [self.values[s:].min() for s in starts[last].tolist()]
        return out[back]


def matching(index: FmIndex, flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stream sequences through the index, right to left and in lock step.

    ``flat[starts[i] : starts[i] + sizes[i]]`` are the sequences.  At each word the match is extended to
    the left; where that fails, or has reached the context, it first gives up words at its right end.  The
    matching statistic of a position is the length of that match, at most the context.  Returned are the
    positions where it reaches the context, and their intervals.
    """
    where, lows, highs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    lanes = np.argsort(-sizes, kind="stable")
    n = index.n
    low, high, length = np.zeros(len(lanes), np.int64), np.full(len(lanes), n), np.zeros(len(lanes), np.int64)
    longest_first = sizes[lanes]
    for t in range(int(sizes.max()) if len(sizes) else 0):
        active = int(np.searchsorted(-longest_first, -t, side="left"))  # lanes longer than t
        at = starts[lanes[:active]] + longest_first[:active] - 1 - t
        word, lo, hi, size = flat[at], low[:active].copy(), high[:active].copy(), length[:active]
        present = index.smaller[word + 1] > index.smaller[word]
        size = np.where(present, np.minimum(size, index.context), 0)
        full = np.flatnonzero(size == index.context)
        if len(full):
            lo[full], hi[full] = index.widen(lo[full], index.context - 1)
            size[full] -= 1
        lo[size == 0], hi[size == 0] = 0, n
        next_lo, next_hi = index.step(word, lo, hi)
        failed = np.flatnonzero((next_lo >= next_hi) & present)
        while len(failed):  # the empty match succeeds, as the word is present
            size[failed] -= 1
            for words in np.unique(size[failed]).tolist():
                some = failed[size[failed] == words]
                lo[some], hi[some] = index.widen(lo[some], words)
            next_lo[failed], next_hi[failed] = index.step(word[failed], lo[failed], hi[failed])
            failed = failed[next_lo[failed] >= next_hi[failed]]
        lo, hi, size = np.where(present, next_lo, 0), np.where(present, next_hi, n), np.where(present, size + 1, 0)
        done = size == index.context
        where.append(at[done])
        lows.append(lo[done])
        highs.append(hi[done])
        low[:active], high[:active], length[:active] = lo, hi, size
    return np.concatenate(where), np.concatenate(lows), np.concatenate(highs)

"""Compressed FM-index of a text of symbols: wavelet matrix, backward search, matching
statistics up to a fixed length.

The suffixes are sorted by their first 2 ** k >= length + 1 symbols, which is all that
patterns of at most ``length`` symbols need.
"""

from __future__ import annotations

import numpy as np


class BitRanks:
    """Bits in words of 64 with the ones before each word."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        packed = np.concatenate([packed, np.zeros(16 - len(packed) % 8, np.uint8)])
        self.words = packed.view("<u8")
        ones = np.bitwise_count(self.words).astype(np.int64)
        self.before = (np.cumsum(ones) - ones).astype(np.int32)
        self.zeros = len(bits) - int(ones.sum())

    def ones(self, at: np.ndarray) -> np.ndarray:
        """Ones among the first ``at`` bits."""
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)


class FMIndex:
    """Index of ``text``: non-negative symbols, of which 0 separates passages."""

    def __init__(self, text: np.ndarray, length: int):
        self.length, n = length, len(text)
        self.size = n
        # Ranks by the first 1, 2, 4, ... symbols.
        rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
        depth, by_depth = 1, {1: rank}
        while depth < length + 1:
            after = np.zeros(n, dtype=np.int64)
            after[: n - depth] = rank[depth:] + 1
            rank = np.unique(rank * (n + 1) + after, return_inverse=True)[1]
            depth *= 2
            by_depth[depth] = rank
        self.suffixes = np.argsort(rank, kind="stable")
        half = depth // 2

        def starts(deep: int) -> np.ndarray:
            """Whether each row differs from the one before in the first ``deep`` symbols."""
            out = np.ones(n, dtype=bool)
            known = max(d for d in by_depth if d <= deep)
            for shift in {0, deep - known}:
                moved = np.full(n, -1, dtype=np.int64)
                moved[: n - shift] = by_depth[known][shift:]
                row = moved[self.suffixes]
                same = row[1:] == row[:-1]
                out[1:] = ~same if shift == 0 else out[1:] | ~same
            return out

        assert half <= length
        # Intervals of the rows that agree in length - 1 symbols: the parents to which a
        # match of full length is widened before it is extended to the left.
        edge = np.flatnonzero(starts(length - 1))
        group = np.cumsum(starts(length - 1)) - 1
        self.low, self.high = edge[group], np.append(edge[1:], n)[group]
        # Rows that agree in ``length`` symbols, by number.
        whole = starts(length)
        self.group = np.cumsum(whole) - 1
        self.group_start = np.flatnonzero(whole)
        # Burrows-Wheeler transform in a wavelet matrix.
        last = text[self.suffixes - 1].astype(np.int64)
        self.levels: list[tuple[int, BitRanks]] = []
        most = int(text.max(initial=0))
        for level in range(max(1, most.bit_length()) - 1, -1, -1):
            bits = (last >> level) & 1
            self.levels.append((level, BitRanks(bits.astype(np.uint8))))
            last = last[np.argsort(bits, kind="stable")]
        counts = np.bincount(text, minlength=most + 1)
        self.first = np.cumsum(counts) - counts
        symbols = np.arange(most + 1)
        self.base = self._down(symbols, np.zeros(most + 1, dtype=np.int64))

    def _down(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level, ranks in self.levels:
            ones = ranks.ones(at)
            at = np.where((symbols >> level) & 1, ranks.zeros + ones, at - ones)
        return at

    def step(self, symbols: np.ndarray, low: np.ndarray, high: np.ndarray):
        """Rows of the patterns with one symbol more on the left."""
        offset = self.first[symbols] - self.base[symbols]
        both = self._down(np.concatenate([symbols, symbols]), np.concatenate([low, high]))
        n = len(symbols)
        return both[:n] + offset, both[n:] + offset

    def statistics(self, symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        """Matching statistics of passages ``symbols[starts[k]:ends[k]]``, read from right
        to left side by side: (length of the longest match from each place, at most
        ``length``; first row of that match)."""
        matched = np.zeros(len(symbols), dtype=np.int32)
        row = np.zeros(len(symbols), dtype=np.int64)
        order = np.argsort(starts - ends, kind="stable")
        starts, ends = starts[order], ends[order]
        size = ends - starts
        low = np.zeros(len(order), dtype=np.int64)
        high = np.full(len(order), self.size, dtype=np.int64)
        have = np.zeros(len(order), dtype=np.int32)
        for t in range(int(size.max(initial=0))):
            live = int(np.searchsorted(-size, -t, side="left"))  # passages longer than t
            at = ends[:live] - 1 - t
            a, b, m = low[:live], high[:live], have[:live]
            full = m == self.length
            a = np.where(full, self.low[np.minimum(a, self.size - 1)], a)
            b = np.where(full, self.high[b - 1], b)
            m = np.where(full, self.length - 1, m)
            symbol = symbols[at]
            x, y = self.step(symbol, a, b)
            # A symbol that can't be put before a shorter match starts anew: the
            # searched passages are windows of indexed text, so this is rare.
            lost = np.flatnonzero(y <= x)
            if len(lost):
                m[lost] = 0
                x[lost] = self.first[symbol[lost]]
                y[lost] = x[lost] + np.diff(np.append(self.first, self.size))[symbol[lost]]
                gone = lost[y[lost] <= x[lost]]
                m[gone], x[gone], y[gone] = -1, 0, self.size
            low[:live], high[:live], have[:live] = x, y, m + 1
            matched[at], row[at] = m + 1, x
        return matched, row

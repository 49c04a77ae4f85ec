"""FM-index over a sequence of integers: wavelet matrix, backward search, matching statistics."""

from __future__ import annotations

import numpy as np

_ONE = np.uint64(1)


def suffix_order(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions sorted by their first ``depth`` or more symbols, by doubling; and the rank of each position.

    Equal ranks mean equal symbols for at least ``depth`` places. Backward search for patterns of
    at most ``depth`` symbols needs no finer order.
    """
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    k = 1
    while k < depth:
        later = np.zeros(n, np.int64)
        if k < n:
            later[: n - k] = rank[k:] + 1
        rank = np.unique(rank * (n + 2) + later, return_inverse=True)[1].astype(np.int64)
        k *= 2
    return np.argsort(rank, kind="stable"), rank


class WaveletMatrix:
    """Ranks of symbols in a sequence, as one bit vector a level with counts every 64 bits."""

    def __init__(self, sequence: np.ndarray, bits: int) -> None:
        self.bits = bits
        self.words: list[np.ndarray] = []
        self.before: list[np.ndarray] = []
        self.zeros: list[int] = []
        n = len(sequence)
        now = sequence.astype(np.int64)
        for level in range(bits - 1, -1, -1):
            bit = (now >> level & 1).astype(bool)
            packed = np.packbits(np.concatenate([bit, np.zeros(-n % 64 + 64, bool)]), bitorder="little").view(np.uint64)
            self.words.append(packed)
            self.before.append(np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)]))
            self.zeros.append(int(n - bit.sum()))
            now = np.concatenate([now[~bit], now[bit]])

    def placed(self, symbols: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Where each place ends up in the lowest level, going the way of its symbol."""
        x = places.copy()
        for k, level in enumerate(range(self.bits - 1, -1, -1)):
            at = x >> 6
            ones = self.before[k][at] + np.bitwise_count(self.words[k][at] & ((_ONE << (x & 63).astype(np.uint64)) - _ONE))
            x = np.where((symbols >> level & 1).astype(bool), self.zeros[k] + ones, x - ones)
        return x


class FMIndex:
    """Index of a sequence of symbols from 1 on, parted by zeros, for patterns of at most ``depth`` symbols."""

    def __init__(self, text: np.ndarray, depth: int) -> None:
        self.depth = depth
        text = np.append(text, 0)
        self.order, rank = suffix_order(text, depth + 1)
        self.symbols = int(text.max()) + 1
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=self.symbols))])
        # Before the first symbol comes the last one, a zero, as if the sequence were a ring.
        self.last = WaveletMatrix(text[self.order - 1], max(1, (self.symbols - 1).bit_length()))
        # Before place p stand placed(p) - placed(0) of a symbol: what follows from the symbol alone is kept.
        every = np.arange(self.symbols)
        self.shift = self.first[:-1] - self.last.placed(every, np.zeros(self.symbols, np.int64))
        # Where runs of suffixes that agree in ``depth`` symbols begin and end.
        self.common = self._common(text, rank)
        self.run_of = np.cumsum(self.common < depth) - 1
        self.runs = np.flatnonzero(self.common < depth)
        self.run_ends = np.append(self.runs[1:], len(text))
        self._starts: dict[int, np.ndarray] = {}

    def _common(self, text: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Per place in suffix order how many symbols the suffix shares with the one before, up to ``depth``; -1 at first."""
        n, order = len(text), self.order
        common = np.full(n, self.depth, np.int64)
        common[0] = -1
        # Neighbours whose rank is equal agree anyhow; only the others are compared symbol by symbol.
        left = np.flatnonzero(rank[order[1:]] != rank[order[:-1]]) if n > 1 else np.zeros(0, np.int64)
        for j in range(self.depth):
            if not len(left):
                break
            a, b = order[left] + j, order[left + 1] + j
            fit = (a < n) & (b < n)
            equal = np.zeros(len(left), bool)
            equal[fit] = text[a[fit]] == text[b[fit]]
            common[left[~equal] + 1] = j
            left = left[equal]
        return common

    def widened(self, places: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of suffixes that agree with those at ``places`` in ``length`` symbols."""
        if length not in self._starts:
            self._starts[length] = np.append(np.flatnonzero(self.common < length), len(self.common))
        starts = self._starts[length]
        run = np.searchsorted(starts, places, side="right") - 1
        return starts[run], starts[run + 1]

    def extend(self, symbols: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One backward step: the interval of symbol + pattern from that of the pattern."""
        found = self.last.placed(np.concatenate([symbols, symbols]), np.concatenate([low, high])) + np.tile(self.shift[symbols], 2)
        return found[: len(symbols)], found[len(symbols) :]

    def matching_statistics(self, streams: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each place of each stream the longest match that starts there, up to ``depth``, and its interval.

        Streams are slices of ``streams``; symbols the index doesn't have are -1. All streams go
        from right to left together. A match that would grow beyond ``depth``, or that can't grow,
        is cut on the right: the interval widens to the suffixes that agree in fewer symbols.
        """
        n = len(streams)
        match, low, high = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
        size = int(self.first[-1])
        length = np.zeros(len(starts), np.int64)
        lo, hi = np.zeros(len(starts), np.int64), np.full(len(starts), size, np.int64)
        order = np.argsort(-lengths, kind="stable")
        for step in range(int(lengths.max()) if len(lengths) else 0):
            own = order[: np.searchsorted(-lengths[order], -step, side="left")]
            at = starts[own] + lengths[own] - 1 - step
            symbol = streams[at]
            known = symbol >= 0
            a, b = self.extend(np.maximum(symbol, 0), lo[own], hi[own])
            grown = known & (b > a)
            s = np.maximum(symbol, 0)
            # If no shorter match can grow either, the symbol alone begins a new one; it may not be there at all.
            new_lo, new_hi = np.where(grown, a, np.where(known, self.first[s], 0)), np.where(grown, b, np.where(known, self.first[s + 1], size))
            new_length = np.where(grown, length[own] + 1, (known & (new_hi > new_lo)).astype(np.int64))
            stuck = np.flatnonzero(known & ~grown & (length[own] > 1))
            shorter = int(length[own[stuck]].max(initial=1)) - 1
            while len(stuck) and shorter:
                now = stuck[length[own[stuck]] > shorter]
                a, b = self.extend(symbol[now], *self.widened(lo[own[now]], shorter))
                fits = b > a
                new_lo[now[fits]], new_hi[now[fits]], new_length[now[fits]] = a[fits], b[fits], shorter + 1
                stuck = np.setdiff1d(stuck, now[fits], assume_unique=True)
                shorter -= 1
            none = new_length == 0
            new_lo[none], new_hi[none] = 0, size
            over = new_length > self.depth
            run = self.run_of[np.minimum(new_lo, max(0, size - 1))] if size else np.zeros(len(own), np.int64)
            if over.any():
                new_lo = np.where(over, self.runs[run], new_lo)
                new_hi = np.where(over, self.run_ends[run], new_hi)
                new_length = np.where(over, self.depth, new_length)
            lo[own], hi[own], length[own] = new_lo, new_hi, new_length
            match[at], low[at], high[at] = new_length, new_lo, new_hi
        return match, low, high

"""A compressed FM-index over word numbers: packed wavelet matrix of the Burrows-Wheeler transform, in numpy vectors.

Suffixes are sorted by their first 64 words, which is enough for backward search of patterns of up to 64 words. Truncated
matching statistics slide a window of fixed length leftwards: widen the interval to its class of length - 1, then one step.
Beside the matrix a place has one bit, for where classes begin, and three 32-bit numbers, for the least weight of intervals.
"""

from __future__ import annotations

import numpy as np


class WaveletMatrix:
    """Rank of a symbol among the first i places; 64 bits a word, one running count a word."""

    def __init__(self, values: np.ndarray, symbols: int):
        self.levels = max(1, int(symbols - 1).bit_length())
        self.words, self.counts, self.zeros = [], [], []
        n = len(values)
        for level in range(self.levels - 1, -1, -1):
            bit = (values >> level & 1).astype(bool)
            padded = np.zeros(-(-(n + 1) // 64) * 64, np.uint8)
            padded[:n] = bit
            words = np.packbits(padded, bitorder="little").view(np.uint64)
            self.words.append(words)
            self.counts.append(np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)[:-1]]).astype(np.int32))
            self.zeros.append(int(n - bit.sum()))
            values = np.concatenate([values[~bit], values[bit]])

    def descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k in range(self.levels):
            word = at >> 6
            below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
            ones = self.counts[k][word] + np.bitwise_count(self.words[k][word] & below)
            up = symbol >> (self.levels - 1 - k) & 1
            at = np.where(up == 1, self.zeros[k] + ones, at - ones)
        return at


class Marks:
    """A packed set of places: the last one up to a place, and the first one after it. Place 0 and the last are in it."""

    def __init__(self, marks: np.ndarray):
        padded = np.zeros(-(-len(marks) // 64) * 64, np.uint8)
        padded[: len(marks)] = marks
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)

    def upto(self, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        x = self.words[word] & (~np.uint64(0) >> (63 - (at & 63)).astype(np.uint64))
        while len(none := np.flatnonzero(x == 0)):
            word[none] -= 1
            x[none] = self.words[word[none]]
        for k in (1, 2, 4, 8, 16, 32):
            x |= x >> np.uint64(k)
        return (word << 6) + np.bitwise_count(x) - 1

    def after(self, at: np.ndarray) -> np.ndarray:
        at = at + 1
        word = at >> 6
        x = self.words[word] & (~np.uint64(0) << (at & 63).astype(np.uint64))
        while len(none := np.flatnonzero(x == 0)):
            word[none] += 1
            x[none] = self.words[word[none]]
        return (word << 6) + np.bitwise_count(x ^ x - np.uint64(1)) - 1


class Minima:
    """Least values of intervals: running minima from both ends of blocks of 64, and a table over the blocks."""

    def __init__(self, values: np.ndarray):
        self.known, ranks = np.unique(values, return_inverse=True)
        blocks = np.full((-(-max(1, len(ranks)) // 64), 64), len(self.known), np.int32)
        blocks.ravel()[: len(ranks)] = ranks
        self.flat = blocks.ravel()
        self.head = np.minimum.accumulate(blocks, axis=1).ravel()
        self.tail = np.ascontiguousarray(np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1]).ravel()
        self.spans = [blocks.min(axis=1)]
        while 2 << len(self.spans) - 1 <= len(blocks):
            h = 1 << len(self.spans) - 1
            self.spans.append(np.minimum(self.spans[-1][:-h], self.spans[-1][h:]))

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Of intervals that are not empty."""
        out = np.empty(len(start), np.int32)
        first, last = start >> 6, stop - 1 >> 6
        wide = np.flatnonzero(first < last)
        out[wide] = np.minimum(self.tail[start[wide]], self.head[stop[wide] - 1])
        inner = wide[last[wide] - first[wide] > 1]
        size = np.frexp((last[inner] - first[inner] - 1).astype(float))[1] - 1
        for k in np.unique(size):
            mine = inner[size == k]
            out[mine] = np.minimum(out[mine], np.minimum(self.spans[k][first[mine] + 1], self.spans[k][last[mine] - (1 << int(k))]))
        live = np.flatnonzero(first == last)
        at = start[live]
        out[live] = self.flat[at]
        while len(live):
            at += 1
            more = at < stop[live]
            live, at = live[more], at[more]
            out[live] = np.minimum(out[live], self.flat[at])
        return self.known[out]


class FmIndex:
    """`text`: numbers from 1, and 0 between the parts; `weight`: of each place, a number whose minimum is asked for."""

    def __init__(self, text: np.ndarray, weight: np.ndarray, length: int):
        if not 2 <= length <= 63:
            raise ValueError("patterns have 2 to 63 words")
        n = len(text)
        ranks = {1: text.astype(np.int64)}
        for h in (1, 2, 4, 8, 16, 32):
            later = np.zeros(n, np.int64)
            later[: n - h] = ranks[h][h:] + 1
            ranks[2 * h] = np.unique(ranks[h] * (n + 2) + later, return_inverse=True)[1].astype(np.int64)
        order = np.argsort(ranks[64], kind="stable")
        self.length, symbols = length, int(text.max(initial=0)) + 1
        bwt = text[order - 1]
        self.matrix = WaveletMatrix(bwt.astype(np.int64), symbols)
        self.base = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols))])[:-1]
        self.zero = self.matrix.descend(np.arange(symbols), np.zeros(symbols, np.int64))
        # Where neighbours in suffix order part within the first length - 1 words.
        same, at = np.ones(max(0, n - 1), bool), 0
        for h in (32, 16, 8, 4, 2, 1):
            if length - 1 & h:
                place = np.minimum(order + at, n - 1)
                value = np.where(order + at < n, ranks[h][place], -1)
                same &= value[1:] == value[:-1]
                at += h
        self.size, self.classes = n, Marks(np.concatenate([[True], ~same, [True]]))
        self.weights = Minima(weight[order])

    def step(self, symbol: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The interval of the pattern with one more word in front."""
        shift = self.base[symbol] - self.zero[symbol]
        return self.matrix.descend(symbol, start) + shift, self.matrix.descend(symbol, stop) + shift

    def window_minima(self, text: np.ndarray, first: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Streams parts of a text, whose words all occur in the index: part k has `windows[k]` windows from place first[k].

        Returns the least weight at which each window starts in the index, parts one after another, and the parts' offsets."""
        offset = np.concatenate([[0], np.cumsum(windows)])
        out = np.empty(int(offset[-1]), self.weights.known.dtype)
        order = np.argsort(-windows, kind="stable")
        at = first[order] + windows[order] + self.length - 2
        start, stop = np.zeros(len(order), np.int64), np.full(len(order), self.size, np.int64)
        for _ in range(self.length):
            start, stop = self.step(text[at], start, stop)
            at = at - 1
        left = windows[order]
        live = np.arange(len(order))
        while True:
            out[offset[order[live]] + left[live] - 1] = self.weights.of(start, stop)
            more = left[live] > 1
            live, start, at = live[more], start[more], at[more]
            if not len(live):
                return out, offset
            left[live] -= 1
            start, stop = self.step(text[at], self.classes.upto(start), self.classes.after(start))
            at = at - 1

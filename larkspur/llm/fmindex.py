"""An FM-index over words: wavelet matrix with packed bits, backward search of many patterns at once."""

from __future__ import annotations

import numpy as np


class Bits:
    """A bit vector as 64-bit words with the number of ones before each: rank in constant time."""

    def __init__(self, bits: np.ndarray):
        words = np.packbits(np.concatenate([bits, np.zeros(-len(bits) % 64 + 64, dtype=bool)]), bitorder="little").view(np.uint64)
        self.words = words
        self.before = np.concatenate([[0], np.bitwise_count(words).cumsum()]).astype(np.int32)

    def ones(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)


class Wavelet:
    """Occurrences of a symbol before a position, in one step for each bit of the alphabet."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.levels: list[Bits] = []
        self.zeros: list[int] = []
        for b in range(bits - 1, -1, -1):
            bit = (symbols >> b & 1).astype(bool)
            self.levels.append(Bits(bit))
            self.zeros.append(int(len(bit) - bit.sum()))
            symbols = np.concatenate([symbols[~bit], symbols[bit]])
        self.bits = bits

        # where a symbol's own block begins in the last level
        self.starts = self.down(np.arange(1 << bits), np.zeros(1 << bits, dtype=np.int64))

    def down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Positions followed through all levels along the bits of their symbols."""
        for level, (bits, zeros) in enumerate(zip(self.levels, self.zeros, strict=True)):
            one = (symbol >> (self.bits - 1 - level) & 1).astype(bool)
            ones = bits.ones(at)
            at = np.where(one, zeros + ones, at - ones)
        return at

    def ranks(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How often each symbol occurs before lo and before hi."""
        start = self.starts[symbol]
        return self.down(symbol, lo) - start, self.down(symbol, hi) - start


class FMIndex:
    """Index of segments of symbols (1 and up). The suffixes are sorted by their first `depth`
    symbols, which keeps the intervals of all patterns up to that length exact."""

    def __init__(self, text: np.ndarray, depth: int):
        """text: symbols, each segment ended by a 0."""
        n, rank, width = len(text), text.astype(np.int64), 1
        order = np.argsort(rank) if depth == 1 else None
        while width < depth:
            # the rank of more symbols from those of as many pieces as a key has room for; suffixes alike up to `depth` may take any order
            bits = int(rank.max() + 1).bit_length() if n else 1
            pieces = min(max(2, 63 // bits), -(-depth // width))
            key = rank
            for j in range(1, pieces):
                after = np.zeros(n, dtype=np.int64)
                after[: max(n - j * width, 0)] = rank[j * width :] + 1
                key = (key << bits) + after
            order = np.argsort(key)
            new = np.empty(n, dtype=np.int64)
            new[order] = np.concatenate([[0], (np.diff(key[order]) != 0).cumsum()])
            rank, width = new, pieces * width
        self.order = order.astype(np.int32)
        size = int(text.max()) + 1 if n else 1
        self.before = np.concatenate([[0], np.bincount(text, minlength=size).cumsum()])
        self.wavelet = Wavelet(text[order - 1].astype(np.int32), max(1, int(size - 1).bit_length()))
        self.n = n

    def statistics(self, text: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Matching statistics of the `length` symbols of text before each end, by backward search.

        Returns (matched, lo, hi): a search goes on while its interval holds more than one suffix,
        so matched < length means that the symbols stand at one place at most.
        """
        lo, hi = np.zeros(len(ends), dtype=np.int64), np.full(len(ends), self.n, dtype=np.int64)
        matched = np.zeros(len(ends), dtype=np.int64)
        live = np.arange(len(ends))
        for step in range(1, length + 1):
            symbol = text[ends[live] - step].astype(np.int64)
            # equal searches go on as one, in order of their places; intervals of one step that begin alike are alike
            each, back = np.unique(symbol << 32 | lo[live], return_inverse=True)
            symbol, low, high = each >> 32, each & 0xFFFFFFFF, np.empty_like(each)
            high[back] = hi[live]
            a, b = self.wavelet.ranks(symbol, low, high)
            lo[live], hi[live] = (self.before[symbol] + a)[back], (self.before[symbol] + b)[back]
            matched[live] = step
            live = live[hi[live] - lo[live] > 1]
            if not len(live):
                break
        return matched, lo, hi

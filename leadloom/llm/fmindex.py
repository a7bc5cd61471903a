"""A compressed full-text index: Burrows-Wheeler transform in a wavelet matrix of packed bits, searched backwards."""

from __future__ import annotations

import numpy as np


class Bits:
    """Bit vector in 64-bit words with the number of ones before each word."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros(-(-(len(bits) + 1) // 64) * 64, np.uint8)
        padded[:len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])[:-1].astype(np.int32)

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        return self.before[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << bit) - np.uint64(1)))


class FMIndex:
    """Index over integer symbols whose suffixes are told apart by their first ``depth`` symbols.

    ``text`` holds symbols from 1 on and 0 after each sequence; patterns of up to ``depth`` symbols are found.
    """

    def __init__(self, text: np.ndarray, depth: int):
        self.n = len(text)
        self.levels = max(1, int(text.max(initial=0)).bit_length())
        rank, padded = text.astype(np.int64), np.concatenate([text, np.zeros(depth, text.dtype)]).astype(np.int64)
        for i in range(1, depth):
            rank = np.unique(rank * (int(padded.max(initial=0)) + 1) + padded[i:i + self.n], return_inverse=True)[1]
        self.suffixes = np.argsort(rank, kind="stable")
        self.smaller = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=1 << self.levels))])
        bwt = text[self.suffixes - 1]
        self.rows, self.zeros = [], []
        for level in reversed(range(self.levels)):
            bit = (bwt >> level & 1).astype(bool)
            self.rows.append(Bits(bit))
            self.zeros.append(int(len(bit) - bit.sum()))
            bwt = np.concatenate([bwt[~bit], bwt[bit]])

    def _rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before a position of the transform."""
        start = np.zeros_like(at)
        for level, bits, zeros in zip(reversed(range(self.levels)), self.rows, self.zeros):
            one = (symbols >> level & 1).astype(bool)
            a, b = bits.rank(start), bits.rank(at)
            start, at = np.where(one, zeros + a, start - a), np.where(one, zeros + b, at - b)
        return at - start

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Interval of suffixes that start with each pattern (one per row), by backward steps for all at once."""
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        for symbols in patterns.T[::-1]:
            lo = self.smaller[symbols] + self._rank(symbols, lo)
            hi = self.smaller[symbols] + self._rank(symbols, hi)
        return lo, hi

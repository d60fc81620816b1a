"""A compressed FM-index over words, with backward search in many lanes at once.

The text is a sequence of symbols 0 .. sigma-1 (0 ends each piece). Its Burrows-Wheeler transform is
kept as a wavelet matrix: a bitmap for each bit of a symbol, the most significant first, each in the
order that the bits before have sorted the sequence by. A bitmap has a count for each 512 bits (32
bits wide) and one for each 64 bits within them (16 bits), so a bit of a symbol takes 1.32 bits: 21
to 24 bits a word of text, against 64 of its hash. A rank is two look-ups and one popcount a level.
"""

from __future__ import annotations

import numpy as np


class BitVector:
    """A bitmap with ranks."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        blocks = n // 512 + 1
        padded = np.zeros(blocks * 512, np.uint8)
        padded[:n] = bits
        self.bits = np.packbits(padded, bitorder="little").view(np.uint64)
        ones = np.bitwise_count(self.bits).reshape(blocks, 8).astype(np.uint32)
        inner = np.cumsum(ones, axis=1, dtype=np.uint32)
        self.block = np.concatenate([[0], np.cumsum(inner[:-1, -1], dtype=np.uint32)]).astype(np.uint32)
        self.word = np.concatenate([np.zeros((blocks, 1), np.uint32), inner[:, :-1]], axis=1).astype(np.uint16).ravel()

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        word = i >> 6
        below = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.block[i >> 9].astype(np.int64) + self.word[word] + np.bitwise_count(self.bits[word] & below)

    @property
    def nbytes(self) -> int:
        return self.bits.nbytes + self.block.nbytes + self.word.nbytes


class WaveletMatrix:
    """Ranks of symbols in a sequence: a bitmap a bit, each sorted stably by the bit before it."""

    def __init__(self, seq: np.ndarray, sigma: int):
        self.sigma, self.n_levels = sigma, max(1, int(sigma - 1).bit_length())
        self.levels: list[tuple[int, BitVector, int]] = []
        for k in reversed(range(self.n_levels)):
            bit = ((seq >> k) & 1).astype(bool)
            self.levels.append((k, BitVector(bit), len(seq) - int(bit.sum())))
            seq = np.concatenate([seq[~bit], seq[bit]])

    @property
    def nbytes(self) -> int:
        return sum(v.nbytes for _, v, _ in self.levels)

    def rank2(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Occurrences of each symbol before lo and before hi, but for an offset that is the same for both."""
        n = len(symbol)
        both = np.concatenate([lo, hi])
        for k, vector, zeros in self.levels:
            ones = vector.rank(both)
            bit = ((symbol >> k) & 1).astype(bool)
            both = np.where(np.concatenate([bit, bit]), zeros + ones, both - ones)
        return both[:n], both[n:]

    def offsets(self) -> np.ndarray:
        """Each symbol's offset in ``rank2``: what it gives at position 0."""
        symbols = np.arange(self.sigma)
        return self.rank2(symbols, np.zeros(self.sigma, np.int64), np.zeros(self.sigma, np.int64))[0]


def suffix_array(text: np.ndarray, length: int) -> np.ndarray:
    """Suffixes in the order of their first ``length`` symbols or more, by prefix doubling."""
    n = len(text)
    rank = text.astype(np.int64)
    step, order = 1, np.argsort(rank)
    while step < length:
        key = rank * (n + 1)
        key[: n - step] += rank[step:] + 1
        order = np.argsort(key)
        k = key[order]
        rank[order] = np.concatenate([[0], np.cumsum(k[1:] != k[:-1])])
        step *= 2
        if rank[order[-1]] == n - 1:
            break
    return order


class FMIndex:
    """Index of pieces of text; ``weight`` counts a piece that stands for several equal ones."""

    def __init__(self, pieces: np.ndarray, bounds: np.ndarray, weight: np.ndarray, depth: int):
        """``pieces``: 64-bit word hashes, one piece after another; searches are of ``depth`` words at most."""
        self.words, codes = np.unique(pieces, return_inverse=True)
        sizes = np.diff(bounds)
        n = len(pieces) + len(sizes)
        text = np.zeros(n, np.int64)
        ends = bounds[1:] + np.arange(len(sizes))
        body = np.ones(n, bool)
        body[ends] = False
        text[body] = codes + 1
        self.codes = codes + 1
        sa = suffix_array(text, depth)
        bwt = text[sa - 1]
        self.sigma = len(self.words) + 1
        self.tree = WaveletMatrix(bwt, self.sigma)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=self.sigma))])
        self.shift = self.first[:-1] - self.tree.offsets()
        owner = np.repeat(np.arange(len(sizes)), sizes + 1)
        self.mass = np.concatenate([[0], np.cumsum(weight[owner[sa]])])

    def backward(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the suffixes that begin with the symbol and go on as the given intervals do."""
        lo, hi = self.tree.rank2(symbol, lo, hi)
        return lo + self.shift[symbol], hi + self.shift[symbol]

    def repeated_from(self, ends: np.ndarray, at_most: np.ndarray, least: int = 2) -> np.ndarray:
        """For text positions in ``codes``: how many words up to each end (exclusive) occur at least ``least``
        times (by weight) in the index, ``at_most`` at most: the matching statistics of the streamed text."""
        found = np.zeros(len(ends), np.int64)
        lane = np.flatnonzero(at_most > 0)
        if not len(lane):
            return found
        symbol = self.codes[ends[lane] - 1]
        lo, hi = self.first[symbol], self.first[symbol + 1]
        depth = 1
        while True:
            ok = self.mass[hi] - self.mass[lo] >= least
            found[lane[ok]] = depth
            ok &= at_most[lane] > depth
            lane, lo, hi = lane[ok], lo[ok], hi[ok]
            if not len(lane):
                return found
            lo, hi = self.backward(self.codes[ends[lane] - 1 - depth], lo, hi)
            depth += 1

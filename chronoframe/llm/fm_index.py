"""FM-index over integer symbols: backward search through wavelet-matrix ranks, positions from a sampled suffix array.
All queries run over many phrases at once."""

from __future__ import annotations

import numpy as np


class Bits:
    """Bit vector with constant-time rank."""

    def __init__(self, bits: np.ndarray) -> None:
        n = len(bits)
        padded = np.zeros((n // 64 + 1) * 64, np.uint8)
        padded[:n] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        counts = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.cumsum(counts) - counts

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        word, bit = i >> 6, (i & 63).astype(np.uint64)
        mask = (np.uint64(1) << bit) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask).astype(np.int64)

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)


class Wavelet:
    """Wavelet matrix: rank of any symbol before any position."""

    def __init__(self, seq: np.ndarray, sigma: int) -> None:
        self.levels: list[tuple[int, Bits, int]] = []
        for shift in range(max(1, int(sigma - 1).bit_length()) - 1, -1, -1):
            bit = ((seq >> shift) & 1).astype(np.uint8)
            zeros = int(len(bit) - bit.sum())
            self.levels.append((shift, Bits(bit), zeros))
            seq = np.concatenate([seq[bit == 0], seq[bit == 1]])

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        at, start = i, np.zeros_like(i)
        for shift, bits, zeros in self.levels:
            one = ((symbol >> shift) & 1).astype(bool)
            r, s = bits.rank(at), bits.rank(start)
            at, start = np.where(one, zeros + r, at - r), np.where(one, zeros + s, start - s)
        return at - start


def suffix_array(text: np.ndarray) -> np.ndarray:
    """By prefix doubling; stops as soon as all prefixes differ."""
    n = len(text)
    _, rank = np.unique(text, return_inverse=True)
    rank = rank.astype(np.int64)
    width = 1
    while True:
        after = np.full(n, -1, np.int64)
        after[: n - width] = rank[width:] if width < n else after[: n - width]
        key = rank * (n + 1) + after + 1
        order = np.argsort(key, kind="stable")
        changed = np.diff(key[order], prepend=key[order[0]] - 1) != 0 if n else np.empty(0, bool)
        new = np.cumsum(changed) - 1
        rank = np.empty(n, np.int64)
        rank[order] = new
        if not n or new[-1] == n - 1:
            return order
        width *= 2


class FMIndex:
    """Index of ``text`` (integers >= 1 and < ``sigma``)."""

    def __init__(self, text: np.ndarray, sigma: int, sample: int = 8) -> None:
        text = np.append(text.astype(np.int64), 0)
        sa = suffix_array(text)
        self.n, self.sample = len(text), sample
        self.bwt = text[sa - 1]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))])
        self.wavelet = Wavelet(self.bwt, sigma)
        kept = sa % sample == 0
        self.marked, self.positions = Bits(kept.astype(np.uint8)), sa[kept]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges [start, end) of each phrase (rows of equal length)."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        alive = np.arange(len(phrases))
        for j in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[alive, j]
            lo[alive] = self.first[c] + self.wavelet.rank(c, lo[alive])
            hi[alive] = self.first[c] + self.wavelet.rank(c, hi[alive])
            alive = alive[lo[alive] < hi[alive]]
            if not len(alive):
                break
        gone = np.ones(len(phrases), bool)
        gone[alive] = False
        hi[gone] = lo[gone]
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: walk back to the next sampled one."""
        at, steps = rows.astype(np.int64).copy(), np.zeros(len(rows), np.int64)
        todo = np.arange(len(rows))
        while len(todo := todo[self.marked.get(at[todo]) == 0]):
            c = self.bwt[at[todo]]
            at[todo] = self.first[c] + self.wavelet.rank(c, at[todo])
            steps[todo] += 1
        return self.positions[self.marked.rank(at)] + steps

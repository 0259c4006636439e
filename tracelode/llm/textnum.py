"""Words and shingles of many texts at once, as numpy arrays.

A word is a longest run of ASCII letters, digits, underscores and non-ASCII characters, after lower-casing.
Hashes have 64 bits; equal words have equal hashes, and two different ones meet with chance 2^-64 or so.
"""

from __future__ import annotations

import numpy as np

SHINGLE = 5
RUN = 1 << 18
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), 95, *range(128, 256)]] = True
_R = np.random.default_rng(20).integers(1, 2**63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_K = np.random.default_rng(21).integers(1, 2**63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def lower(text: str) -> str:
    """Lower case with as many code points as before, so that offsets hold."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def slices(sizes, limit: int):
    """(from, to) runs of rows whose sizes sum to limit at most; a larger row stands alone."""
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if len(sizes) > start:
        yield start, len(sizes)


class Words:
    """Words of texts: hash, first byte and byte length of each, and bounds[d]:bounds[d+1] for those of text d."""

    def __init__(self, texts: list[str]):
        parts = [lower(t).encode("utf-8", "surrogatepass") for t in texts]
        self.buf = np.frombuffer(b"\n".join([*parts, b""]), np.uint8)
        self.offsets = np.zeros(len(parts) + 1, np.int64)
        np.cumsum([len(p) + 1 for p in parts], out=self.offsets[1:])
        is_word = _WORD[self.buf]
        edge = np.flatnonzero(np.diff(is_word, prepend=False, append=False))
        self.start, end = edge[0::2], edge[1::2]
        self.size = end - self.start
        self.hash = mix(self._sums() + self.size.astype(np.uint64))
        self.bounds = np.searchsorted(self.start, self.offsets)

    def _sums(self) -> np.ndarray:
        """Each word's bytes, weighted by their places and summed; a run of words at a time, so that memory follows the words, not the bytes."""
        out, to = np.empty(len(self.size), np.uint64), np.cumsum(self.size)
        a = 0
        while a < len(out):
            b = max(a + 1, int(np.searchsorted(to, to[a] + RUN, "right")))
            size = self.size[a:b]
            first = np.cumsum(size) - size
            place = np.arange(first[-1] + size[-1]) - np.repeat(first, size)
            byte = self.buf[np.repeat(self.start[a:b], size) + place]
            out[a:b] = np.add.reduceat(byte.astype(np.uint64) * _R[place & 4095], first)
            a = b
        return out

    def prefix(self, n: int) -> np.ndarray:
        """A hash of each word's first n bytes (of all, if shorter)."""
        out = np.full(len(self.size), n << 40, np.uint64)
        for k in range(n):
            byte = np.where(self.size > k, self.buf[self.start + np.minimum(self.size - 1, k)], 0)
            out += byte.astype(np.uint64) * _R[k]
        return mix(out)

    def suffix(self, n: int) -> np.ndarray:
        """A hash of each word's last n bytes (with a zero for each that it lacks)."""
        out = np.full(len(self.size), n << 48, np.uint64)
        for k in range(n):
            byte = np.where(self.size > k, self.buf[self.start + np.maximum(self.size - 1 - k, 0)], 0)
            out += byte.astype(np.uint64) * _R[1024 + k]
        return mix(out)

    def shingles(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of five words of a text, in order, and their bounds by text. A text of one to four words has one shingle: all its words."""
        n, counts = len(self.hash), np.diff(self.bounds)
        every = np.zeros(n, np.uint64)
        for j in range(SHINGLE):
            if n > j:
                every[: n - j] += self.hash[j:] * _K[j]
        valid = np.ones(n, bool)
        for j in range(SHINGLE - 1):
            tail = self.bounds[1:][counts > j] - 1 - j
            valid[tail] = False
        short = np.flatnonzero((counts > 0) & (counts < SHINGLE))
        for d in short:
            a, b = self.bounds[d], self.bounds[d + 1]
            valid[a] = True
            every[a] = (self.hash[a:b] * _K[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
        sums = np.zeros(n + 1, np.int64)
        np.cumsum(valid, out=sums[1:])
        return mix(every[valid]), sums[self.bounds]


def short_runs(words: Words, d: int, length: int) -> np.ndarray:
    """Shingles of exactly `length` words, fewer than five, at each place of text d."""
    lo, hi = words.bounds[d], words.bounds[d + 1]
    n = max(0, hi - lo - length + 1)
    if not n:
        return np.zeros(0, np.uint64)
    return mix(sum(words.hash[lo + j : lo + j + n] * _K[j] for j in range(length)) + np.uint64(length))

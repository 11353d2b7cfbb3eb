"""Words, their 64-bit hashes and word shingles of many texts at once, with numpy over the texts' UTF-8 bytes.

Words are `[^\\x20\\x09-\\x0D]+`. A word's hash is a polynomial of random byte values modulo 2**64, mixed; it is the same in
every process. Two different words share one with a probability of about 2**-64.
"""

from __future__ import annotations

import numpy as np

_RANDOM = np.random.default_rng(20240229)
_BYTES = _RANDOM.integers(1, 2**63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_STEPS = _RANDOM.integers(1, 2**63, 64, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


class Words:
    """Words of texts that lie in data one after another: start and end (bytes), text (index), first (index of each text's first word)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False):
        self.data = _LOWER[data] if lower else data
        space = _IS_SPACE[data]
        begins = ~space
        begins[1:] &= space[:-1]
        ends = ~space
        ends[:-1] &= space[1:]
        inner = offsets[1:-1]
        inner = inner[(inner > 0) & (inner < len(data))]
        begins[inner] = ~space[inner]
        ends[inner - 1] = ~space[inner - 1]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.count = np.diff(self.first)
        self.text = np.repeat(np.arange(len(offsets) - 1), self.count)

    def hashes(self) -> np.ndarray:
        n = len(self.data)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTES[self.data] * _powers(_BASE, n), out=sums[1:])
        h = (sums[self.end] - sums[self.start]) * _powers(_INVERSE, n + 1)[self.start]
        return mix(h + (self.end - self.start).astype(np.uint64))


def shingle_sets(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's distinct shingles, ascending, and each text's offset in them.

    A text of fewer words than size has its whole sequence as one shingle; a text without words has none.
    """
    h = words.hashes()
    n, many = len(h), words.count
    lengths = np.where(many >= size, many - size + 1, (many > 0).astype(np.int64))
    at = np.concatenate([[0], np.cumsum(lengths)])
    out = np.empty(at[-1], np.uint64)
    if n >= size:
        whole = np.zeros(n - size + 1, np.uint64)
        for i in range(size):
            whole += h[i : n - size + 1 + i] * _STEPS[i]
        whole = mix(whole)
    for k in range(len(many)):
        a, c = words.first[k], many[k]
        if c >= size:
            out[at[k] : at[k + 1]] = whole[a : a + c - size + 1]
        elif c:
            out[at[k]] = mix((h[a : a + c] * _STEPS[:c]).sum(keepdims=True) + np.uint64(c))[0]
        out[at[k] : at[k + 1]].sort()
    fresh = np.ones(len(out), bool)
    fresh[1:] = out[1:] != out[:-1]
    inner = at[1:-1]
    fresh[inner[inner < len(out)]] = True
    kept = np.concatenate([[0], np.cumsum(fresh)])
    return out[fresh], kept[at]

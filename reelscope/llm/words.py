"""Word hashes of many texts at once, from the bytes of an Arrow column."""

from __future__ import annotations

import numpy as np

_rng = np.random.default_rng(20240229)
#: A random number for each byte and an odd base: a word's hash is the sum of number * base ** position, modulo 2 ** 64.
BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
BYTE_LOWER = BYTE[_LOWER]
IN_WORD = np.ones(256, np.bool_)
IN_WORD[[0x20, *range(0x09, 0x0E)]] = False


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> np.ndarray:
    out = np.full(max(n, 1), BASE, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts in order, and for each text the index of its first word (one more than texts).

    lower: A to Z count as a to z.
    """
    texts = len(offsets) - 1
    inside = IN_WORD[data]
    if not inside.any():
        return np.zeros(0, np.uint64), np.zeros(texts + 1, np.int64)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = offsets[:-1][np.diff(offsets) > 0]
    first[edges] = inside[edges]
    starts = np.flatnonzero(first)
    at = np.flatnonzero(inside)
    begin = np.searchsorted(at, starts)
    lengths = np.diff(np.append(begin, len(at)))
    place = np.arange(len(at)) - np.repeat(begin, lengths)
    values = (BYTE_LOWER if lower else BYTE)[data[at]]
    values *= powers(int(lengths.max()))[place]
    hashes = mixed(np.add.reduceat(values, begin) + lengths.astype(np.uint64))
    return hashes, np.searchsorted(starts, offsets)


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Distinct hashes, ascending, of the runs of `size` words of one text; with fewer words, the whole sequence is one."""
    if not len(words):
        return np.zeros(0, np.uint64)
    width = min(size, len(words))
    count = len(words) - width + 1
    out = np.full(count, np.uint64(width))
    for k in range(width):
        out = mixed(out * BASE + words[k : k + count])
    return np.unique(out)

"""Words, word hashes and shingles over UTF-8 buffers, for many documents at once (numpy inside Spark tasks).

A word is a maximal run of bytes other than space and 0x09-0x0D. Hashes have 64 bits and depend on nothing but the text.
"""

from __future__ import annotations

import numpy as np

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (splitmix64's finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def constants(n: int, seed: int) -> np.ndarray:
    """``n`` odd 64-bit constants by rule."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed) * np.uint64(1_000_003)) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


_BYTE = constants(256, 1)
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[65:91] = _BYTE[97:123]
_BASE = constants(1, 2)[0]
_NEXT = constants(64, 3)


def words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and the number of the first word of each document (and of the end)."""
    if not len(buf):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offs), np.int64)
    solid = ~SPACE[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[offs] = True
    before = np.empty(len(buf), bool)
    before[0] = False
    before[1:] = solid[:-1]
    starts = np.flatnonzero(solid & (~before | edge[:-1]))
    after = np.empty(len(buf), bool)
    after[-1] = False
    after[:-1] = solid[1:]
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offs)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True, step: int = 1 << 20) -> np.ndarray:
    """A hash of each word; ``lower``: A-Z count as a-z. Works on about ``step`` bytes at once."""
    out = np.empty(len(starts), np.uint64)
    if not len(starts):
        return out
    values = _BYTE_LOWER if lower else _BYTE
    lens = ends - starts
    upto = np.concatenate([[0], np.cumsum(lens)])
    power = np.ones(int(lens.max()), np.uint64)
    with np.errstate(over="ignore"):
        power[1:] = _BASE
        np.multiply.accumulate(power, out=power)
        a = 0
        while a < len(starts):
            b = min(len(starts), max(a + 1, int(np.searchsorted(upto, upto[a] + step, "right")) - 1))
            n, first = lens[a:b], upto[a:b] - upto[a]
            place = np.arange(upto[b] - upto[a])
            inside = place - np.repeat(first, n)
            v = values[buf[inside + np.repeat(starts[a:b], n)]]
            v *= power[inside]
            out[a:b] = np.add.reduceat(v, first)
            a = b
        return mix(out + lens.astype(np.uint64) * _NEXT[0])


def shingles(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles in document order, repeats included, and their offsets.
    A document of fewer words, but one at least, has one shingle: the whole sequence."""
    n_words = np.diff(first)
    n = np.where(n_words >= k, n_words - k + 1, (n_words > 0).astype(np.int64))
    offs = np.concatenate([[0], np.cumsum(n)])
    out = np.empty(int(offs[-1]), np.uint64)
    with np.errstate(over="ignore"):
        if len(hashes) >= k:
            every = np.zeros(len(hashes) - k + 1, np.uint64)
            for j in range(k):
                every += hashes[j : len(hashes) - k + 1 + j] * _NEXT[1 + j % 60]
            full = np.flatnonzero(n_words >= k)
            m = n[full]
            if len(full):
                at = np.concatenate([[0], np.cumsum(m)])
                run = np.arange(at[-1]) - np.repeat(at[:-1], m)
                out[run + np.repeat(offs[full], m)] = mix(every[run + np.repeat(first[full], m)])
        for d in np.flatnonzero((n_words > 0) & (n_words < k)):
            h = hashes[first[d] : first[d + 1]]
            out[offs[d]] = mix(np.array([(h * _NEXT[1 : 1 + len(h)]).sum() + np.uint64(len(h))], np.uint64))[0]
    return out, offs

"""Word and shingle hashes of many texts at once, in numpy.

Words are runs of [^\\x20\\x09-\\x0D], A-Z lower-cased.  A word's hash is a
polynomial in its bytes modulo 2**64, mixed; a shingle's hash mixes its
words' hashes in order.  Equal 64-bit hashes count as equal shingles.
"""

from __future__ import annotations

import numpy as np

WORDS = 5

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_FACTORS = np.array([pow(0xD1342543DE82EF95, i + 1, 1 << 64) for i in range(WORDS)], np.uint64)
# Bytes hashed together; a longer word makes a longer block.
_BLOCK = 1 << 18
_powers: list[np.ndarray] = []


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _tables(size: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, for places below ``size`` at least."""
    if not _powers or len(_powers[0]) < size:
        size = max(size, _BLOCK)
        _powers.clear()
        for base in (_BASE, _BASE_INVERSE):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers.append(np.cumprod(steps))
    return _powers


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first and end byte of every word, and the first word of each text (one more than texts)."""
    solid = ~_SPACE[data]
    before, after = np.zeros(len(data) + 1, bool), np.zeros(len(data) + 1, bool)
    before[1:], after[:-1] = solid, solid
    before[offsets] = False  # words end with their text
    after[offsets] = False
    starts = np.flatnonzero(solid & ~before[:-1])
    ends = np.flatnonzero(solid & ~after[1:]) + 1
    hashes = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        base = starts[at]
        upto = max(int(np.searchsorted(ends, base + _BLOCK, "right")), at + 1)
        own = _LOWER[data[base:ends[upto - 1]]].astype(np.uint64) + np.uint64(1)
        powers, inverse = _tables(len(own) + 1)
        sums = np.zeros(len(own) + 1, np.uint64)
        np.cumsum(own * powers[:len(own)], out=sums[1:])
        first, end = starts[at:upto] - base, ends[at:upto] - base
        hashes[at:upto] = (sums[end] - sums[first]) * inverse[first]
        at = upto
    return mixed(hashes), starts, ends, np.searchsorted(starts, offsets)


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Each text's distinct shingles of WORDS words, ascending; with fewer
    words the whole sequence as one; without words none."""
    words, _, _, firsts = word_hashes(data, offsets)
    sums = np.zeros(max(len(words) - WORDS + 1, 0), np.uint64)
    for place in range(WORDS):
        sums += words[place:place + len(sums)] * _FACTORS[place]
    hashed = mixed(sums)
    out = []
    for a, b in zip(firsts[:-1].tolist(), firsts[1:].tolist(), strict=True):
        if b - a >= WORDS:
            out.append(np.unique(hashed[a:b - WORDS + 1]))
        elif b > a:
            out.append(mixed((words[a:b] * _FACTORS[:b - a]).sum(keepdims=True) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out

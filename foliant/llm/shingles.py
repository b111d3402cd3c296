"""Word shingle sets of whole texts as 64-bit hashes, in numpy over Arrow buffers.

A word hash is a polynomial in 64-bit arithmetic over random values of the word's
bytes; all words of a block come from one running sum. Two different shingles of a
pair of texts agree by chance about once in 2**50.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from foliant.llm.common import mix, portions, stream

#: Bytes hashed in one go.
BLOCK = 1 << 20
_BASE = 0x2545F4914F6CDD1D  # odd, so that it can be inverted
_OF_BYTE = stream(11, 256)
_OF_BYTE[65:91] = _OF_BYTE[97:123]  # A-Z as a-z
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


def _powers(base: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, base, np.uint64), dtype=np.uint64)])


_UP = _powers(_BASE, 1 << 16)
_DOWN = _powers(pow(_BASE, -1, 1 << 64), 1 << 16)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _UP, _DOWN
    if len(_UP) <= n:
        size = max(n, min(2 * n, 2 * BLOCK))
        _UP, _DOWN = _powers(_BASE, size), _powers(pow(_BASE, -1, 1 << 64), size)
    return _UP, _DOWN


def _hash_block(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hashes of the words data[first:last]."""
    up, down = _tables(len(data))
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_OF_BYTE[data] * up[: len(data)], dtype=np.uint64)])
        return mix((total[last] - total[first]) * down[first] + (last - first).astype(np.uint64))


def word_hashes(data: np.ndarray, places: np.ndarray, blank: np.ndarray = _BLANK) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the rows that ``places`` bounds, and where each row's words start.

    ``blank``: which byte values stand between words. Words end with their row.
    """
    inside = ~blank[data]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    begin = places[:-1][places[:-1] < len(data)]
    starts[begin] = inside[begin]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    end = places[1:][(places[1:] > 0) & (places[1:] <= len(data))] - 1
    ends[end] = inside[end]
    first, last = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    hashes, k = np.empty(len(first), np.uint64), 0
    while k < len(first):  # blocks end with a word; a longer word is a block of its own
        m = max(k + 1, int(np.searchsorted(last, first[k] + BLOCK, "right")))
        at = first[k]
        hashes[k:m] = _hash_block(data[at:last[m - 1]], first[k:m] - at, last[k:m] - at)
        k = m
    return hashes, np.searchsorted(first, places)


def shingle_sets(data: np.ndarray, places: np.ndarray, words: int) -> Iterator[np.ndarray]:
    """For each row the sorted distinct hashes of its runs of ``words`` words.

    A row with fewer words has one, of all its words; a row without words has none.
    """
    factor = stream(23, words)
    for a, b in portions(places, 4 * BLOCK):
        own = places[a:b + 1] - places[a]
        h, at = word_hashes(data[places[a]:places[b]], own)
        with np.errstate(over="ignore"):
            n = max(0, len(h) - words + 1)
            runs = np.zeros(n, np.uint64)
            for k in range(words):
                runs += h[k:k + n] * factor[k]
            runs = mix(runs)
            for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                if j - i >= words:
                    yield np.unique(runs[i:j - words + 1])
                elif j > i:
                    short = (h[i:j] * factor[: j - i]).sum(dtype=np.uint64) + np.uint64(j - i)
                    yield mix(np.array([short], np.uint64))
                else:
                    yield np.zeros(0, np.uint64)

"""Words of byte texts and CRCs of their runs, for whole Arrow batches at a time."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from foliant.llm.common import portions, utf8

#: Bytes of text that are cut into words at a time; a longer row stands alone.
PORTION = 2 << 20
#: Longer runs of words get their CRC one by one.
_SHORT = 48
#: Word bytes after lower-casing A-Z: 0-9, a-z and all bytes of characters beyond ASCII.
_WORD = np.zeros(256, bool)
_WORD[ord("0"):ord("9") + 1] = _WORD[ord("a"):ord("z") + 1] = _WORD[128:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32
_NEWLINE, _SPACE = 10, 32


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


_CRC = _crc_table()


def crcs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The CRC-32 of every slice of ``data``."""
    out = np.zeros(len(starts), np.uint32)
    sizes = ends - starts
    for k in np.flatnonzero(sizes > _SHORT):
        out[k] = zlib.crc32(data[starts[k]:ends[k]])
    order = np.argsort(-np.where(sizes > _SHORT, 0, sizes), kind="stable")
    order = order[:np.count_nonzero(sizes <= _SHORT)]
    sizes, at = sizes[order], starts[order]
    value = np.full(len(order), 0xFFFFFFFF, np.uint32)
    for k in range(int(sizes[0]) if len(sizes) else 0):
        n = int(np.searchsorted(-sizes, -k, "left"))
        value[:n] = _CRC[(value[:n] ^ data[at[:n] + k]) & 0xFF] ^ (value[:n] >> np.uint32(8))
    out[order] = value ^ np.uint32(0xFFFFFFFF)
    return out


class Words:
    """The words of some rows: bytes in lower case, starts, ends, and the row and line of each."""

    def __init__(self, data: np.ndarray, places: np.ndarray):
        self.data = _LOWER[data]
        inside = np.zeros(len(data) + 2, bool)
        inside[1:-1] = _WORD[self.data]
        edge = np.zeros(len(data) + 1, bool)
        edge[places] = True
        self.starts = np.flatnonzero(inside[1:] & (~inside[:-1] | edge))
        self.ends = np.flatnonzero(inside[:-1] & (~inside[1:] | edge))
        self.rows = np.searchsorted(places, self.starts, "right") - 1
        self.places = places

    def lines(self) -> np.ndarray:
        """For each word the number of newlines before it."""
        return np.searchsorted(np.flatnonzero(self.data == _NEWLINE), self.starts)

    def joined(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All words with one space between them, and where each starts and ends there."""
        sizes = self.ends - self.starts
        starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]]).astype(np.int64) if len(sizes) else np.zeros(0, np.int64)
        at = np.arange(int((sizes + 1).sum())) + np.repeat(self.starts - starts, sizes + 1)
        data = self.data[np.minimum(at, max(len(self.data) - 1, 0))]
        data[starts + sizes] = _SPACE
        return data, starts, starts + sizes


def runs(words: Words, orders: tuple[int, int], across: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """CRC and row of all runs of ``orders[0]`` to ``orders[1]`` words: those within a row, or only those that cross a newline."""
    lines = words.lines() if across else None
    if not across and orders[0] == 1:
        yield crcs(words.data, words.starts, words.ends), words.rows
    if orders[1] == 1:
        return
    data, starts, ends = words.joined()
    for n in range(max(2, orders[0]), orders[1] + 1):
        first = np.arange(max(0, len(starts) - n + 1))
        first = first[words.rows[first] == words.rows[first + n - 1]]
        if across:
            first = first[lines[first] != lines[first + n - 1]]
        yield crcs(data, starts[first], ends[first + n - 1]), words.rows[first]


def cut(texts: pa.Array) -> Iterator[tuple[int, int, Words]]:
    """Rows ``first`` to ``last`` of a column and their words."""
    data, places = utf8(texts)
    for first, last in portions(places, PORTION):
        at = places[first:last + 1]
        yield first, last, Words(data[at[0]:at[-1]], at - at[0])


def distinct_lines(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct lines of a column, the number of each line in order, and where each row's lines start."""
    split = pc.split_pattern(texts.fill_null("").cast(pa.large_string()), "\n")
    coded = split.flatten().dictionary_encode()
    starts = np.concatenate([[0], np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False))]).astype(np.int64)
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), starts

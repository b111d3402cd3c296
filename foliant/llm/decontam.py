"""Benchmark decontamination: passages of documents within a small edit distance of a benchmark item.

Texts are lower-cased and their white space squeezed. A document's windows of an item's
length stand where seeds say so: an item is cut into pieces of SEED characters (shorter ones,
where those would be no more than the edits that it may have), and a
passage within e edits keeps all but e of them, each at most e places off; so every
passage to be found has a window (no passage is lost here). Windows of items that may have no
edit are compared as they are. Other windows and items are embedded
by random walks (CGK): at step j the walk writes the character it is at and moves on or
not by a coin that depends on j and that character, so that edit distance becomes Hamming
distance. Repeated samples of SAMPLED embedded places are the hash keys; a window that
shares a key with its item is a candidate, and its exact edit distance decides.

A passage of 10 % edits differs in less than half of the embedded places on average, so it
nearly always shares one of WALKS * REPEATS keys of SAMPLED places (tests measure it); an
unrelated window seldom does.

Items are taken in blocks of about BLOCK_ITEMS items and BLOCK_CHARS characters, each broadcast and read against all documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import small_batches, stream, text_or_empty

#: Edits that a passage may have, as a share of the item's characters.
EDITS = 0.1
SEED = 8
WALKS, REPEATS, SAMPLED = 5, 12, 3
BLOCK_ITEMS, BLOCK_CHARS = 4096, 4 << 20
_BLOCK = 1 << 21
#: Windows that walk together, and regions that are aligned together, at most; fewer where they are so long that they would have more than _CELLS characters.
_TOGETHER, _ALIGNED = 2048, 256
_CELLS = 2 << 20
_BITS = 20


def normalised(text: str) -> str:
    return " ".join(text.lower().split())


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _seed_hashes(chars: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` characters from each place on."""
    h = np.zeros(max(0, len(chars) - size + 1), np.uint32)
    with np.errstate(over="ignore"):
        for k in range(size):
            h = h * np.uint32(0x9E3779B1) + chars[k:len(h) + k]
        return (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B)


def walk(windows: np.ndarray, steps: int, seed: int) -> np.ndarray:
    """Embedded windows, one row each: the character at each step, 0 behind the end."""
    n, width = windows.shape
    padded = np.concatenate([windows, np.zeros((n, 1), np.uint32)], axis=1)
    coins = stream(seed, 2 * steps).astype(np.uint32) | np.uint32(1)
    at, rows, out = np.zeros(n, np.int64), np.arange(n), np.empty((n, steps), np.uint32)
    with np.errstate(over="ignore"):
        for j in range(steps):
            c = padded[rows, at]
            out[:, j] = c
            at += ((c + coins[2 * j]) * coins[2 * j + 1]) >> np.uint32(31)
            np.minimum(at, width, out=at)
    return out


def least_edits(items: list[np.ndarray], regions: list[np.ndarray], most: np.ndarray) -> np.ndarray:
    """For each pair the edit distance of the item to the nearest stretch of the region, that stretch's start and its end.

    A distance over ``most`` may be given as any number over it. All pairs advance together,
    a character of their items at a time.
    """
    n, sizes, spans = len(items), np.array([len(x) for x in items]), np.array([len(x) for x in regions])
    width = int(spans.max())
    text, wanted = np.full((n, width), 0xFFFFFFFF, np.uint32), np.full((int(sizes.max()), n), 0xFFFFFFFE, np.uint32)
    for k in range(n):
        text[k, :spans[k]], wanted[:sizes[k], k] = regions[k], items[k]
    places = np.arange(width + 1, dtype=np.int32)
    beyond = places > spans[:, None]
    out = np.stack([most + 1, np.zeros(n, np.int64), np.zeros(n, np.int64)], axis=1)
    row, start = np.zeros((n, width + 1), np.int32), np.tile(places, (n, 1))
    left = np.arange(n)
    for k in range(len(wanted)):
        other, down = row[:, :-1] + (text != wanted[k][:, None]), row[:, 1:] + 1
        best = np.concatenate([row[:, :1] + 1, np.minimum(other, down)], axis=1)
        came = np.concatenate([start[:, :1], np.where(other <= down, start[:, :-1], start[:, 1:])], axis=1)
        # characters of the region may be skipped: a running minimum from the place where the run starts
        level = best - places
        low = np.minimum.accumulate(level, axis=1)
        row = low + places
        start = np.take_along_axis(came, np.maximum.accumulate(np.where(level == low, places, 0), axis=1), axis=1)
        if k % 16 == 15 or (sizes[left] == k + 1).any():
            ended = sizes[left] == k + 1
            masked = np.where(beyond, 1 << 30, row)
            end = masked.argmin(axis=1)
            nearest = masked[np.arange(len(left)), end]
            for i in np.flatnonzero(ended).tolist():
                out[left[i]] = nearest[i], start[i, end[i]], end[i]
            go = ~ended & (nearest <= most[left])
            if not go.any():
                break
            if not go.all():
                row, start, text, beyond, left, wanted = row[go], start[go], text[go], beyond[go], left[go], wanted[:, go]
    return out


def _together(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of sizes in ascending order: at most ``most`` of them, and at most _CELLS when all are as long as the last; a longer one stands alone."""
    a = 0
    while a < len(sizes):
        part = sizes[a:a + most]
        b = a + max(1, int((np.arange(1, len(part) + 1) * part <= _CELLS).sum()))
        yield a, b
        a = b


class Items:
    """A block of benchmark items with their seeds and embeddings."""

    def __init__(self, ids: list, texts: list[str], edits: float) -> None:
        self.ids, self.texts = ids, texts
        self.chars = [_codes(t) for t in texts]
        self.length = np.array([len(c) for c in self.chars], np.int64)
        self.most = (self.length * edits).astype(np.int64)
        seed = np.where(self.length // SEED > self.most, SEED, self.length // (self.most + 1))
        pieces = self.length // np.maximum(seed, 1)
        self.least = pieces - self.most
        # by length of the seeds: their hashes in order, the item and the offset of each, and which leading bits they have
        self.seeds: list[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        for size in np.unique(seed[seed > 0]).tolist():
            own = np.flatnonzero(seed == size)
            hashes = np.concatenate([_seed_hashes(self.chars[k], size)[:(pieces[k] - 1) * size + 1:size] for k in own])
            item, offset = np.repeat(own, pieces[own]), np.concatenate([np.arange(pieces[k]) * size for k in own])
            order = np.argsort(hashes, kind="stable")
            seen = np.zeros(1 << _BITS, bool)
            seen[hashes >> np.uint32(32 - _BITS)] = True
            self.seeds.append((size, hashes[order], item[order], offset[order], seen))

    @cached_property
    def places(self) -> np.ndarray:
        """Sampled places as shares of an embedding: WALKS x REPEATS x SAMPLED."""
        return np.random.default_rng(7).random((WALKS, REPEATS, SAMPLED))

    def keys(self, windows: list[np.ndarray], items: np.ndarray) -> np.ndarray:
        """Hash keys of windows, each as of its item's length: windows x (WALKS * REPEATS) x SAMPLED."""
        lengths = self.length[items]
        width = int(lengths.max())
        flat = np.zeros((len(windows), width), np.uint32)
        for k, w in enumerate(windows):
            flat[k, :len(w)] = w
        out = np.empty((len(windows), WALKS, REPEATS, SAMPLED), np.uint32)
        for w in range(WALKS):
            embedded = walk(flat, 2 * width, 1_000 + w)
            at = (self.places[w][None] * (2 * lengths)[:, None, None]).astype(np.int64)
            out[:, w] = embedded[np.arange(len(windows))[:, None, None], at]
        return out.reshape(len(windows), WALKS * REPEATS, SAMPLED)

    @cached_property
    def own_keys(self) -> np.ndarray:
        out = np.empty((len(self.chars), WALKS * REPEATS, SAMPLED), np.uint32)
        order = np.argsort(self.length, kind="stable")
        for a, b in _together(self.length[order], _TOGETHER):
            out[order[a:b]] = self.keys([self.chars[k] for k in order[a:b]], order[a:b])
        return out

    def seeded(self, chars: np.ndarray, row: np.ndarray) -> np.ndarray:
        """(row, item, start) of the windows that hold enough of an item's pieces; ``row``: of each character, < 0 between rows."""
        found = [self._seeded(chars, row, *seeds) for seeds in self.seeds if len(chars) >= seeds[0]]
        return np.concatenate(found) if found else np.zeros((0, 3), np.int64)

    def _seeded(self, chars: np.ndarray, row: np.ndarray, size: int, hashes: np.ndarray, items: np.ndarray, offsets: np.ndarray, seen: np.ndarray) -> np.ndarray:
        h = _seed_hashes(chars, size)
        at = np.flatnonzero(seen[h >> np.uint32(32 - _BITS)])
        low, high = np.searchsorted(hashes, h[at]), np.searchsorted(hashes, h[at], "right")
        n = high - low
        at, low, n = at[n > 0], low[n > 0], n[n > 0]
        which = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        pos, item = np.repeat(at, n), items[which]
        start, own = pos - offsets[which], row[pos]
        ok = own >= 0
        own, item, start = own[ok], item[ok], start[ok]
        width = self.most[item] + 1
        shift = int(self.length.max()) + 1
        bucket = (start + shift) // width
        # passages span two neighbouring buckets at most
        key = (own * len(self.ids) + item) * ((len(chars) + 2 * shift) + 2) + bucket
        order = np.argsort(key, kind="stable")
        key, own, item, start = key[order], own[order], item[order], start[order]
        distinct, first, count = np.unique(key, return_index=True, return_counts=True)
        after = np.zeros(len(distinct), np.int64)
        before = np.zeros(len(distinct), np.int64)
        if len(distinct) > 1:
            near = distinct[1:] == distinct[:-1] + 1
            after[:-1], before[1:] = np.where(near, count[1:], 0), np.where(near, count[:-1], 0)
        good = count + np.maximum(after, before) >= self.least[item[first]]
        keep = np.repeat(good, count)
        return np.unique(np.stack([own[keep], item[keep], start[keep]], axis=1), axis=0)

    def found(self, chars: np.ndarray, begin: np.ndarray, end: np.ndarray, row: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(row, item, start, end, edits) of the best passage of each item in each row."""
        windows = self.seeded(chars, row)
        exact = self.most[windows[:, 1]] == 0
        best = self._equal(windows[exact], chars, begin, end)
        windows = windows[~exact]
        windows = windows[np.argsort(self.length[windows[:, 1]], kind="stable")]
        for a, b in _together(self.length[windows[:, 1]], _TOGETHER):
            group = windows[a:b]
            cut = [chars[max(begin[r], s):min(end[r], s + self.length[k])] for r, k, s in group.tolist()]
            alike = (self.keys(cut, group[:, 1]) == self.own_keys[group[:, 1]]).all(axis=2).any(axis=1)
            inexact = []
            for r, k, s in group[alike].tolist():
                item = self.chars[k]
                if s >= begin[r] and np.array_equal(chars[s:min(end[r], s + len(item))], item):
                    best[r, k] = min(best.get((r, k), (1, 0, 0)), (0, s, s + len(item)))
                else:
                    inexact.append((r, k, s))
            inexact = [x for x in inexact if best.get(x[:2], (1,))[0]]
            for c, d in _together(np.array([len(self.chars[k]) + 2 * int(self.most[k]) for _, k, _ in inexact]), _ALIGNED):
                part = inexact[c:d]
                most = np.array([self.most[k] for _, k, _ in part])
                low = [max(int(begin[r]), s - int(m)) for (r, _, s), m in zip(part, most, strict=True)]
                regions = [chars[x:min(int(end[r]), s + len(self.chars[k]) + int(m))] for (r, k, s), m, x in zip(part, most, low, strict=True)]
                for (r, k, _), m, x, (edits, u, v) in zip(part, most, low, least_edits([self.chars[k] for _, k, _ in part], regions, most).tolist(), strict=True):
                    if edits <= m:
                        best[r, k] = min(best.get((r, k), (edits, x + u, x + v)), (edits, x + u, x + v))
        return [(r, k, s - int(begin[r]), e - int(begin[r]), edits) for (r, k), (edits, s, e) in sorted(best.items())]

    def _equal(self, windows: np.ndarray, chars: np.ndarray, begin: np.ndarray, end: np.ndarray) -> dict[tuple[int, int], tuple[int, int, int]]:
        """The first of each row's windows that equal their item; such items are short."""
        row, item, start = windows.T
        length = self.length[item]
        same = (start >= begin[row]) & (start + length <= end[row])
        for k in range(int(length.max(initial=0))):
            own = np.array([c[k] if k < len(c) and not m else 0 for c, m in zip(self.chars, self.most.tolist(), strict=True)], np.uint32)
            same &= (k >= length) | (chars[np.minimum(start + k, len(chars) - 1)] == own[item])
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        _, first = np.unique(row[same] * len(self.ids) + item[same], return_index=True)  # windows come in order of their starts
        for r, k, s in windows[same][first].tolist():
            best[r, k] = (0, s, s + int(self.length[k]))
        return best


def _leaks(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: Items = sent.value
        for batch in batches:
            texts = [normalised(x) for x in batch.column("text").to_pylist()]
            rows, k = [], 0
            while k < len(texts):  # about _BLOCK characters at a time; a longer text alone
                m, size = k, 0
                while m < len(texts) and (m == k or size + len(texts[m]) < _BLOCK):
                    size += len(texts[m]) + 1
                    m += 1
                joined = _codes("\n".join(texts[k:m]) + "\n")
                lengths = np.array([len(x) for x in texts[k:m]], np.int64)
                begin = np.cumsum(lengths + 1) - lengths - 1
                row = np.repeat(np.arange(m - k), lengths + 1)
                rows += [(k + r, *hit) for r, *hit in items.found(joined, begin, begin + lengths, row)]
                k = m
            own = batch.column("id").take(pa.array([r[0] for r in rows], pa.int64()))
            theirs = pa.array([items.ids[r[1]] for r in rows], items.kind)
            numbers = [pa.array([r[c] for r in rows], pa.int64()) for c in (2, 3, 4)]
            sizes = pa.array([int(items.length[r[1]]) for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([own, theirs, *numbers, sizes], ["id", "item", "start", "end", "edits", "item_chars"])
    return run


def leaks(docs: DataFrame, benchmark: DataFrame, edits: float = EDITS, id_col: str = "doc_id", text_col: str = "text",
          item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per document and item of which it holds a passage: the ids, ``start, end, edits, item_chars``.

    The passage of the fewest edits counts, the first of those; places are those of the
    normalised text. An item may have EDITS of its characters in edits, rounded down, so one of fewer than
    10 characters none. Null and empty items are never found; neither is anything in null or empty texts. Repeated documents or
    items give rows of their own. An empty table on either side gives an empty result. Other
    columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), text_or_empty(F.col(f"`{text_col}`")).alias("text"))
    known = benchmark.select(F.col(f"`{item_col}`").alias("item"), text_or_empty(F.col(f"`{item_text_col}`")).alias("text"))
    kinds = texts.schema["id"].dataType.simpleString(), known.schema["item"].dataType.simpleString()
    size = known.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars")).head()
    blocks = max(1, -(-size["n"] // BLOCK_ITEMS), -(-size["chars"] // BLOCK_CHARS))
    out = None
    for block in range(blocks):
        rows = known.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block).orderBy("item", "text").toArrow()
        items = Items(rows.column("item").to_pylist(), [normalised(x) for x in rows.column("text").to_pylist()], edits)
        items.kind = rows.column("item").type
        if len(items.ids):
            items.own_keys  # noqa: B018  embedded once, here
        found = texts.mapInArrow(_leaks(spark.sparkContext.broadcast(items)), f"id {kinds[0]}, item {kinds[1]}, start long, end long, edits long, item_chars long")
        out = found if out is None else out.unionByName(found)
    return out.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "start", "end", "edits", "item_chars")

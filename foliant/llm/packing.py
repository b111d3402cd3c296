"""Packing of token streams into training sequences by dynamic programming.

Documents keep their order within a partition of the input, so nothing is shuffled. A
document's tokens are its ids and one end id. Cuts are wanted at document or sentence
ends: f(j) is the least cost of packing everything up to boundary j, and

    f(j) = penalty(j) + min over i < j of f(i) + k * HARD_CUT + (k + 1) * window - (j - i)

where k full windows lie between i and j and the last one is padded. For each k below
SPANS the boundaries i with k * window < j - i <= (k + 1) * window form a sliding range,
whose minimum of f(i) + i a monotone queue holds. Sentences longer than that get
boundaries of their own. The last window of a partition is cut into powers of two,
which need no padding.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import small_batches, text_or_empty

#: Costs in tokens of padding: of a cut at a sentence's end, and of one inside a sentence.
SENTENCE_CUT = 2
HARD_CUT = 8
#: Full windows and a last one that may lie between two boundaries.
SPANS = 4
#: Tokens that share one sentence end as a boundary, the last of them.
SPACING = 24
#: Tokens that are packed at a time; what the last window holds goes on to the next time.
CHUNK = 1 << 19
#: Distinct pieces of text whose ids a task remembers, and the characters it looks up at a time.
REMEMBERED = 400_000
#: Longer pieces (whole sentences, where a script has no spaces) aren't remembered, so that memory is bounded in bytes too.
LONGEST_REMEMBERED = 64
#: Fixed value: the public pre-token pattern of byte-level BPE.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A text with a space after another blank, or with a blank that only some libraries call one, is encoded as a whole.
_UNSAFE = ("  ", "\n ", "\r ", "\t ", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x1f")
_RARE_BLANK = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_TEXT_BLOCK = 1 << 20


def _byte_values() -> dict[str, int]:
    """The public rule by which byte-level tokenizers write bytes as printable characters."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Ids:
    """Token ids of texts, remembered by piece.

    A byte-level tokenizer lets no token cross into a space that follows a non-blank
    character, so a text's ids are those of its pieces between spaces, each with its
    space before it. New pieces are encoded many at a time, as one text, and told apart by
    the tokens' byte lengths; where the file allows it (byte-level BPE, ids in the order of the merges) by the
    faster of two public libraries, which gives the same ids.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path) as f:
            parts = json.load(f)
        names = [self.tokenizer.id_to_token(i) or "" for i in range(self.tokenizer.get_vocab_size())]
        self.special = [x["content"] for x in parts["added_tokens"]]
        self.ends_sentence = np.array([bool(re.search("[.!?…]$|Ċ", x)) for x in names])
        value = _byte_values()
        in_bytes = {i: bytes(value[c] for c in x) for i, x in enumerate(names) if x not in self.special}
        self.size = np.array([len(in_bytes.get(i, b"")) for i in range(len(names))])
        merges = [(tuple(x.split(" ")) if isinstance(x, str) else tuple(x)) for x in parts["model"]["merges"]]
        if [a + b for a, b in merges] == names[256:256 + len(merges)]:
            import tiktoken

            fast = tiktoken.Encoding("pieces", pat_str=PATTERN, mergeable_ranks={x: i for i, x in in_bytes.items()}, special_tokens={})
            self.encode = fast.encode_ordinary
        else:
            self.encode = self.encode_one
        self.forget()

    def encode_one(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.first, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0

    def _encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces, and how many each has; none starts a text or holds a special token's string."""
        ids = np.array(self.encode(" " + " ".join(pieces)), np.uint32)
        ends = np.cumsum(self.size[ids])
        sizes = np.fromiter((len(p.encode()) + 1 for p in pieces), np.int64, len(pieces))
        last = np.searchsorted(ends, np.cumsum(sizes)) + 1
        return ids, np.diff(last, prepend=0)

    def _of_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces, and how many each has. Pieces beyond REMEMBERED are encoded each time."""
        if max(map(len, pieces)) > LONGEST_REMEMBERED:
            return self._with_long_pieces(pieces)
        which = np.fromiter(map(self.number.get, pieces, repeat(-1)), np.int64, len(pieces))
        missing = np.flatnonzero(which < 0)
        if len(missing):
            absent = [pieces[k] for k in missing.tolist()]
            room = len(self.number) < REMEMBERED
            new = list(dict.fromkeys(absent)) if room else absent
            ids, count = self._encode_pieces(new)
            while self.used + len(ids) > len(self.pool):
                self.pool = np.concatenate([self.pool, np.zeros(len(self.pool), np.uint32)])
            self.pool[self.used:self.used + len(ids)] = ids
            first, n = self.used + np.cumsum(count) - count, len(self.first)
            starts, counts = np.concatenate([self.first, first]), np.concatenate([self.count, count])
            if room:
                self.number.update(zip(new, range(n, n + len(new)), strict=True))
                self.used, self.first, self.count = self.used + len(ids), starts, counts
                which[missing] = np.fromiter(map(self.number.__getitem__, absent), np.int64, len(absent))
            else:
                which[missing] = np.arange(n, n + len(new))
        else:
            starts, counts = self.first, self.count
        count = counts[which]
        place = np.repeat(starts[which] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        return self.pool[place], count

    def _with_long_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As ``_of_pieces``; long pieces are encoded together and leave nothing behind."""
        long = np.fromiter((len(p) > LONGEST_REMEMBERED for p in pieces), bool, len(pieces))
        parts = [([p for p, x in zip(pieces, long.tolist(), strict=True) if x], self._encode_pieces), ([p for p, x in zip(pieces, long.tolist(), strict=True) if not x], self._of_pieces)]
        done = [encode(own) if own else (np.zeros(0, np.uint32), np.zeros(0, np.int64)) for own, encode in parts]
        count = np.empty(len(pieces), np.int64)
        count[long], count[~long] = done[0][1], done[1][1]
        of_long = np.repeat(long, count)
        ids = np.empty(len(of_long), np.uint32)
        ids[of_long], ids[~of_long] = done[0][0], done[1][0]
        return ids, count

    def of(self, text: str) -> np.ndarray:
        return self.of_all([text])[0]

    def of_all(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, looked up in blocks of about _TEXT_BLOCK characters."""
        out: list[list] = [[] for _ in texts]
        owners, pieces, ends, chars = [], [], [], 0

        def look_up() -> None:
            if pieces:
                ids, count = self._of_pieces(pieces)
                at = np.concatenate([[0], np.cumsum(count)])[ends]
                for k, part in zip(owners, np.split(ids, at[:-1]), strict=True):
                    out[k].append(part)
            owners.clear(), pieces.clear(), ends.clear()

        for k, text in enumerate(texts):
            if any(x in text for x in self.special):
                out[k].append(np.array(self.encode_one(text), np.uint32))
            elif text.startswith(" ") or text.endswith(" ") or any(x in text for x in _UNSAFE) or (not text.isascii() and _RARE_BLANK.search(text)):
                out[k].append(np.array(self.encode(text), np.uint32))
            elif text:
                cut = text.find(" ")
                out[k].append(np.array(self.encode(text if cut < 0 else text[:cut]), np.uint32))
                while cut >= 0:
                    end = text.find(" ", cut + _TEXT_BLOCK)
                    pieces += (text[cut + 1:] if end < 0 else text[cut + 1:end]).split(" ")
                    owners.append(k)
                    ends.append(len(pieces))
                    chars += len(text) - cut if end < 0 else end - cut
                    cut = end
                    if chars > _TEXT_BLOCK:
                        look_up()
                        chars = 0
        look_up()
        return [np.concatenate(x) if x else np.zeros(0, np.uint32) for x in out]


@lru_cache(maxsize=2)
def ids_by(path: str) -> Ids:
    return Ids(path)


def cut_points(ends: np.ndarray, penalty: np.ndarray, window: int) -> list[int]:
    """Where windows end, at the least cost. ``ends``: boundaries after 0, ascending, the last one the stream's end."""
    places, fine = [0, *ends.tolist()], [0, *penalty.tolist()]
    n = len(places)
    value, back = [0] * n, [0] * n  # value: cost + place
    spans = [([0] * n, 0, 0, 0, k * window, k * (HARD_CUT + window) + window) for k in range(SPANS)]  # queue, its head and end, next to enter
    for j in range(1, n):
        at, best, chosen = places[j], 1 << 60, 0
        for k in range(SPANS):
            queue, head, tail, e, far, base = spans[k]
            nearest = at - far
            while places[e] < nearest and e < j:
                new = value[e]
                while tail > head and value[queue[tail - 1]] >= new:
                    tail -= 1
                queue[tail] = e
                tail += 1
                e += 1
            nearest -= window
            while head < tail and places[queue[head]] < nearest:
                head += 1
            spans[k] = queue, head, tail, e, far, base
            if head < tail and value[queue[head]] + base < best:
                best, chosen = value[queue[head]] + base, queue[head]
        value[j], back[j] = best + fine[j], chosen
    cuts, j = [], n - 1
    while j:
        i = back[j]
        cuts += range(places[i] + (places[j] - places[i] - 1) // window * window, places[i], -window)
        cuts.append(places[j])
        j = i
    return sorted(cuts)


def _boundaries(marks: np.ndarray, penalty: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """With further boundaries wherever two are more than (SPANS - 1) windows apart."""
    gaps = np.diff(marks, prepend=0)
    wide = np.flatnonzero(gaps > (SPANS - 1) * window)
    if not len(wide):
        return marks, penalty
    step = max(1, window // 16)
    extra = np.concatenate([np.arange(marks[k] - gaps[k] + step, marks[k], step) for k in wide])
    order = np.argsort(all_marks := np.concatenate([marks, extra]), kind="stable")
    return all_marks[order], np.concatenate([penalty, np.full(len(extra), HARD_CUT)])[order]


class Packer:
    """Pieces of one partition's documents, in order."""

    def __init__(self, ids: Ids, window: int, end_id: int, first_sequence: int, with_ids: bool) -> None:
        self.ids, self.window, self.end_id, self.with_ids = ids, window, end_id, with_ids
        self.sequence, self.waiting, self.held = first_sequence, [], 0

    def add(self, doc_id, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
        own = np.append(ids, np.uint32(self.end_id))
        self.waiting.append((doc_id, own, 0, len(own)))
        self.held += len(own)
        if self.held >= CHUNK:
            yield self.flush(False)

    def flush(self, last: bool) -> pa.RecordBatch:
        ids = np.concatenate([x[1] for x in self.waiting])
        doc_ends = np.cumsum([len(x[1]) for x in self.waiting])
        ending = self.ids.ends_sentence[ids]
        ending[doc_ends - 1] = True
        marks = np.flatnonzero(ending) + 1
        in_doc = np.searchsorted(doc_ends, marks)
        gap = (marks[1:] - 1) // SPACING != (marks[:-1] - 1) // SPACING
        marks = marks[np.append(gap | (in_doc[1:] != in_doc[:-1]), True)]  # a sentence end in each SPACING tokens, and all document ends
        penalty = np.full(len(marks), SENTENCE_CUT)
        penalty[np.searchsorted(marks, doc_ends)] = 0
        cuts = cut_points(*_boundaries(marks, penalty, self.window), self.window)
        if last:
            left = cuts[-1] - (cuts[-2] if len(cuts) > 1 else 0)
            at = cuts.pop() - left
            for k in range(left.bit_length() - 1, -1, -1):
                if left >> k & 1:
                    cuts.append(at := at + (1 << k))
        elif len(cuts) > 1:
            cuts.pop()
        else:
            return self.batch([], [])
        cuts = np.array(cuts)
        edges = np.union1d(cuts, doc_ends[doc_ends < cuts[-1]])
        starts = np.concatenate([[0], edges[:-1]])
        doc = np.searchsorted(doc_ends, starts, "right")
        window = np.searchsorted(cuts, starts, "right")
        window_start = np.concatenate([[0], cuts[:-1]])
        doc_start = np.concatenate([[0], doc_ends[:-1]])
        rows, slices = [], []
        for a, b, d, w in zip(starts.tolist(), edges.tolist(), doc.tolist(), window.tolist(), strict=True):
            doc_id, _, before, total = self.waiting[d]
            piece = ids[a:b]
            rows.append((doc_id, before + a - int(doc_start[d]), b - a, zlib.crc32(piece.astype("<u4").tobytes()), total, self.sequence + w, a - int(window_start[w])))
            slices.append(piece)
        out = self.batch(rows, slices)
        self.sequence += len(cuts)
        done, keep = int(cuts[-1]), []
        for (doc_id, own, before, total), end in zip(self.waiting, doc_ends.tolist(), strict=True):
            if end > done:
                skip = max(0, done - (end - len(own)))
                keep.append((doc_id, own[skip:], before + skip, total))
        self.waiting, self.held = keep, sum(len(x[1]) for x in keep)
        return out

    def batch(self, rows: list[tuple], slices: list[np.ndarray]) -> pa.RecordBatch:
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        arrays = [pa.array([r[k] for r in rows], self.kind if k == 0 else pa.int64()) for k in range(7)]
        if self.with_ids:
            names, arrays = [*names, "ids"], [*arrays, pa.array([x.astype(np.int32) for x in slices], pa.list_(pa.int32()))]
        return pa.RecordBatch.from_arrays(arrays, names)

    kind: pa.DataType = pa.int64()


def _packed(path: str, window: int, end_id: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        packer = Packer(ids_by(path), window, end_id, TaskContext.get().partitionId() << 40, with_ids)
        for batch in batches:
            packer.kind = batch.column("doc_id").type
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), packer.ids.of_all(batch.column("text").to_pylist()), strict=True):
                yield from packer.add(doc_id, ids)
        if packer.waiting:
            yield packer.flush(True)
    return run


def pack(docs: DataFrame, tokenizer: str, window: int = 1024, end_id: int = 0, with_ids: bool = True,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` and, if asked for, ``ids``.

    ``tokenizer``: a byte-level tokenizer file. Every document has at least its end id, so
    a null or empty text gives one piece of one token; a null id is kept as it is; rows
    that repeat an id or a text are packed as rows of their own. An empty table gives no
    piece. sequence_id is unique over the table, ``offset`` counts within the sequence.
    Other columns are ignored.
    """
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text_or_empty(F.col(f"`{text_col}`")).alias("text"))
    kind = texts.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids
    return texts.mapInArrow(_packed(tokenizer, window, end_id, with_ids), schema)

"""Licence scans with a generalised suffix automaton of licence tokens.

The automaton holds every run of words of every template. A text's words are hashed in
numpy and looked up in the templates' vocabulary; runs of at least MIN_MATCH known words
(no match can lie elsewhere) stream through the automaton, which gives at each word the
longest run of template words that ends there (matching statistics). Matches of MIN_MATCH
words or more that can't be extended are chained, template by template, in the order of
text and template; a chain that covers enough of its template is a span with its label.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import portions, small_batches, text_or_empty, utf8
from foliant.llm.licence_texts import BASE_PHRASES, TEMPLATES
from foliant.llm.shingles import BLOCK, word_hashes

MIN_MATCH = 4
#: Share of a template's words that a span covers at least; a template of up to SHORT words is wanted whole.
COVERED = 0.7
SHORT = 13
#: Words that may lie between two matches of a span.
MOST_GAP = 40
#: Score of a text with a base phrase, if no span gives more.
BASE_SCORE = 0.5

_BETWEEN = np.zeros(256, bool)
_BETWEEN[[*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text: str) -> list[str]:
    return _WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))


class SuffixAutomaton:
    """Of several token sequences. Each state knows where its runs end: {sequence: ascending ends}."""

    def __init__(self, sequences: list[list[int]]) -> None:
        self.next, self.link, self.length = [{}], [-1], [0]
        ends: list[dict[int, set]] = [defaultdict(set)]
        for number, sequence in enumerate(sequences):
            last = 0
            for at, token in enumerate(sequence):
                last = self._extend(last, token)
                while len(ends) < len(self.next):
                    ends.append(defaultdict(set))
                ends[last][number].add(at + 1)
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            for number, places in ends[state].items():
                ends[self.link[state]][number] |= places
        self.ends = [{k: sorted(v) for k, v in x.items()} for x in ends]

    def _state(self, length: int, link: int, following: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(following)
        return len(self.next) - 1

    def _split(self, above: int, token: int) -> int:
        """The state that ``token`` leads to from ``above``, of exactly one token more."""
        target = self.next[above][token]
        if self.length[target] == self.length[above] + 1:
            return target
        copy = self._state(self.length[above] + 1, self.link[target], dict(self.next[target]))
        self.link[target] = copy
        while above >= 0 and self.next[above].get(token) == target:
            self.next[above][token] = copy
            above = self.link[above]
        return copy

    def _extend(self, last: int, token: int) -> int:
        if token in self.next[last]:
            return self._split(last, token)
        new = self._state(self.length[last] + 1, 0, {})
        above = last
        while above >= 0 and token not in self.next[above]:
            self.next[above][token] = new
            above = self.link[above]
        if above >= 0:
            self.link[new] = self._split(above, token)
        return new

    def matches(self, tokens: list[int], least: int) -> list[tuple[int, int, int]]:
        """Matches of ``least`` tokens or more that can't be extended to the right: start, end, state."""
        found, state, length = [], 0, 0
        for at, token in enumerate(tokens):
            if token not in self.next[state] and length >= least:
                found.append((at - length, at, state))
            while state and token not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if token in self.next[state]:
                state, length = self.next[state][token], length + 1
        if length >= least:
            found.append((len(tokens) - length, len(tokens), state))
        return found


class Scanner:
    def __init__(self, templates: list[tuple[str, str]], phrases: list[tuple[str, str]]) -> None:
        self.labels = [label for label, _ in templates]
        split = [words(text) for _, text in templates]
        self.sizes = [len(x) for x in split]
        base = [words(text) for text, _ in phrases]
        vocabulary = sorted({w for x in [*split, *base] for w in x})
        number = {w: k for k, w in enumerate(vocabulary)}
        joined = " ".join(vocabulary).encode()
        hashes, _ = word_hashes(np.frombuffer(joined, np.uint8), np.array([0, len(joined)]))
        order = np.argsort(hashes)
        self.known, self.number = hashes[order], order
        self.automaton = SuffixAutomaton([[number[w] for w in x] for x in split])
        self.phrases = [(label, [number[w] for w in x]) for (_, label), x in zip(phrases, base, strict=True)]

    def tokens(self, hashes: np.ndarray) -> np.ndarray:
        """The words' numbers in the vocabulary, or -1."""
        at = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        return np.where(self.known[at] == hashes, self.number[at], -1)

    def base(self, tokens: np.ndarray, at: np.ndarray) -> list[tuple[str, np.ndarray]]:
        """For each base phrase its label and where it stands; ``at``: where rows start."""
        row = np.repeat(np.arange(len(at) - 1), np.diff(at))
        out = []
        for label, phrase in self.phrases:
            n = len(tokens) - len(phrase) + 1
            if n <= 0:
                continue
            hit = row[:n] == row[len(phrase) - 1:]
            for k, token in enumerate(phrase):
                hit &= tokens[k:k + n] == token
            out.append((label, np.flatnonzero(hit)))
        return out

    def spans(self, tokens: np.ndarray) -> list[tuple[int, int, str, float]]:
        """Start, end, label and covered share of each span in one text's tokens."""
        known = np.concatenate([[False], tokens >= 0, [False]])
        edges = np.flatnonzero(known[1:] != known[:-1]).reshape(-1, 2)
        chains: dict[int, list] = {}  # template: text start, text end, template end, covered words
        out = []

        def close(t: int) -> None:
            start, end, _, covered = chains.pop(t)
            share = covered / self.sizes[t]
            if share >= (1 if self.sizes[t] <= SHORT else COVERED):
                out.append((start, end, self.labels[t], min(1.0, share)))

        for a, b in edges[edges[:, 1] - edges[:, 0] >= MIN_MATCH].tolist():
            for first, last, state in self.automaton.matches(tokens[a:b].tolist(), MIN_MATCH):
                for t, ends in self.automaton.ends[state].items():
                    start, end = a + first, a + last
                    if t in chains:
                        chain = chains[t]
                        k = bisect_left(ends, chain[2] + 1)
                        if start - chain[1] <= MOST_GAP and k < len(ends):
                            new = min(end - max(start, chain[1]), ends[k] - chain[2])
                            chains[t] = [chain[0], end, ends[k], chain[3] + max(0, new)]
                            continue
                        close(t)
                    chains[t] = [start, end, ends[0], end - start]
        for t in list(chains):
            close(t)
        return sorted(out)


@lru_cache(maxsize=1)
def standard() -> Scanner:
    return Scanner(TEMPLATES, BASE_PHRASES)


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    scanner = standard()
    for batch in batches:
        data, places = utf8(batch.column("text"))
        n_words, n_base, first, last, base_labels, labels, scores, spans = [], [], [], [], [], [], [], []
        for a, b in portions(places, 4 * BLOCK):
            hashes, at = word_hashes(data[places[a]:places[b]], places[a:b + 1] - places[a], _BETWEEN)
            tokens = scanner.tokens(hashes)
            hits: dict[int, list] = defaultdict(list)
            for label, where in scanner.base(tokens, at):
                for w, r in zip(where.tolist(), (np.searchsorted(at, where, "right") - 1).tolist(), strict=True):
                    hits[r].append((w, label))
            for r in range(b - a):
                begin, end = int(at[r]), int(at[r + 1])
                own = [w - begin for w, _ in hits[r]]
                found = scanner.spans(tokens[begin:end])
                base = {x for _, x in hits[r]}
                n_words.append(end - begin)
                n_base.append(len(own))
                first.append(min(own, default=None))
                last.append(max(own, default=None))
                base_labels.append(",".join(sorted(base)))
                labels.append(",".join(sorted(base | {x[2] for x in found})))
                scores.append(max([BASE_SCORE if own else 0.0, *(x[3] for x in found)]))
                spans.append([{"start": s, "end": e, "label": x, "covered": c} for s, e, x, c in found])
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("covered", pa.float64())]))
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), *(pa.array(x, pa.int64()) for x in (n_words, n_base, first, last)), pa.array(base_labels, pa.string()),
             pa.array(labels, pa.string()), pa.array(scores, pa.float64()), pa.array(spans, kind)],
            ["id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: the id, ``n_words, n_base, first_word, last_word, base_labels, labels, score, spans``.

    Base places are those of BASE_PHRASES; spans (word start, end exclusive, label, covered
    share of the template) are the automaton's. The score is the largest covered share, at
    least BASE_SCORE with a base place, else 0. Null and empty texts have no words and empty
    labels. Repeated rows get equal rows; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), text_or_empty(F.col(f"`{text_col}`")).alias("text"))
    kind = texts.schema["id"].dataType.simpleString()
    out = texts.mapInArrow(_scanned, f"id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<start:long,end:long,label:string,covered:double>>")
    return out.withColumnRenamed("id", id_col)

"""Text quality by positive-unlabelled learning with the non-negative risk estimator.

Trusted positives are texts that a label marks as good. All other texts, and copies of good
ones, are the unlabelled side; labels of bad texts are not used. With p the share of good
texts among the unlabelled (the class prior), R_p(+), R_p(-) and R_u(-) the mean logistic
losses of positives taken as good, positives taken as bad and unlabelled taken as bad, the
risk is

    p * R_p(+) + max(0, R_u(-) - p * R_p(-)).

Where the second part falls below 0, its gradient is turned round instead of cut, so that the
model stops fitting single unlabelled texts (Kiryo et al. 2017).

The prior is estimated from positives and unlabelled texts alone: a first model is trained on
one half of both samples; over the other half, the share of unlabelled texts above a threshold
divided by that of positives above it is smallest where hardly any bad text is left, and is
the prior there (best-bin estimation, Garg et al. 2021).

Features are read from whole texts in numpy: shares of hashed runs of one to three character
kinds and of hashed words, and a few measures of repetition, marks, capitals and lengths. The
model is linear and of fixed size; it is fitted on the driver to a bounded sample (SAMPLE texts
of each side, those of the smallest hashes of their ids) and broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import mix, small_batches, utf8
from foliant.llm.langid import held_out
from foliant.llm.wordgrams import Words, crcs

#: Texts of each side that the model is fitted to, at most.
SAMPLE = 6000
THRESHOLD = 0.7
KIND_BUCKETS = 384
WORD_BUCKETS = 128
MEASURES = 12
SIZE = KIND_BUCKETS + WORD_BUCKETS + MEASURES
STEPS = 300
RATE = 0.05
DECAY = 1e-3
#: Bytes that are looked at together; longer texts are cut at multiples of it, and counts added up.
_BLOCK = 1 << 18

#: Kinds of bytes: lower case, capitals, digits and bytes of other characters have one kind each, all others their own.
_KIND = np.arange(256, dtype=np.uint8)
_KIND[ord("a"):ord("z") + 1] = ord("a")
_KIND[ord("A"):ord("Z") + 1] = ord("A")
_KIND[ord("0"):ord("9") + 1] = ord("0")
_KIND[128:] = ord("a")


def _totals(data: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Additive counts of each row: hashed kinds, hashed words, and what the measures need."""
    rows = len(places) - 1
    sizes = np.diff(places)
    out = np.zeros((rows, SIZE))
    kind = _KIND[data].astype(np.uint64)
    row = np.repeat(np.arange(rows), sizes)
    with np.errstate(over="ignore"):
        for n in (1, 2, 3):
            code = np.full(max(0, len(kind) - n + 1), n, np.uint64)
            for k in range(n):
                code = code * np.uint64(256) + kind[k:len(kind) - n + 1 + k]
            own = row[:len(code)]
            whole = own == row[n - 1:]
            bucket = (mix(code[whole]) % np.uint64(KIND_BUCKETS)).astype(np.int64)
            out[:, :KIND_BUCKETS] += np.bincount(own[whole] * KIND_BUCKETS + bucket, minlength=rows * KIND_BUCKETS).reshape(rows, -1)
    words = Words(data, places)
    crc = crcs(words.data, words.starts, words.ends)
    bucket = crc.astype(np.int64) % WORD_BUCKETS
    out[:, KIND_BUCKETS:KIND_BUCKETS + WORD_BUCKETS] = np.bincount(words.rows * WORD_BUCKETS + bucket, minlength=rows * WORD_BUCKETS).reshape(rows, -1)
    per_row = lambda hit, weight=None: np.bincount(hit, weight, rows)
    same = (words.rows[1:] == words.rows[:-1]) & (crc[1:] == crc[:-1])
    keyed = np.unique(words.rows.astype(np.int64) << 32 | crc.astype(np.int64)) >> 32
    marks = (_KIND[data] != ord("a")) & (_KIND[data] != ord("A")) & (_KIND[data] != ord("0")) & (data > 32)
    measured = [
        sizes, per_row(words.rows), per_row(keyed), per_row(words.rows[1:][same]), per_row(words.rows, words.ends - words.starts),
        per_row(row[marks]), per_row(row[_KIND[data] == ord("A")]), per_row(row[_KIND[data] == ord("0")]), per_row(row[data == 10]),
        per_row(words.rows, words.ends - words.starts >= 16), per_row(row[data >= 128]), per_row(row[:-1][marks[:-1] & marks[1:] & (row[:-1] == row[1:])]) if len(data) else sizes,
    ]
    out[:, KIND_BUCKETS + WORD_BUCKETS:] = np.stack(measured, axis=1)
    return out


def features(texts: pa.Array) -> np.ndarray:
    """A row of SIZE numbers per text: square roots of shares, and measures between about 0 and 1. A text without words has zeros there."""
    data, places = utf8(texts)
    rows = len(places) - 1
    total = np.zeros((rows, SIZE))
    first = 0
    while first < rows:
        last = max(first + 1, int(np.searchsorted(places, places[first] + _BLOCK, "right")) - 1)
        last = min(last, first + 1024)
        for at in range(int(places[first]), max(int(places[last]), int(places[first]) + 1), _BLOCK):
            end = min(int(places[last]), at + _BLOCK)
            if last - first > 1:
                end = int(places[last])
            inner = np.clip(places[first:last + 1], at, end)
            total[first:last] += _totals(data[at:end], inner - at)
            if end == int(places[last]):
                break
        first = last
    kinds, words, measured = np.split(total, [KIND_BUCKETS, KIND_BUCKETS + WORD_BUCKETS], axis=1)
    share = lambda part: np.sqrt(part / np.maximum(part.sum(axis=1, keepdims=True), 1))
    size, n, distinct, same, letters, marks, capitals, digits, breaks, long, others, doubled = measured.T
    size, some = np.maximum(size, 1), np.maximum(n, 1)
    shown = np.stack([np.log1p(size) / 15, np.log1p(n) / 15, distinct / some, same / some, letters / some / 15, marks / size * 5,
                      capitals / size, digits / size, breaks / some, long / some, others / size, doubled / size * 5], axis=1)
    return np.hstack([share(kinds), share(words), shown]).astype(np.float32)


def _risk_gradient(g_p: np.ndarray, g_u: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """Derivatives of the non-negative risk by the outputs for positives and unlabelled texts."""
    down = lambda z: 1 / (1 + np.exp(np.clip(z, -50, 50)))
    loss = lambda z: np.logaddexp(0, -z)
    bad = loss(-g_u).mean() - prior * loss(-g_p).mean()
    bad_p, bad_u = -prior * down(-g_p) / len(g_p), down(-g_u) / len(g_u)
    if bad < 0:
        return -bad_p, -bad_u
    return -prior * down(g_p) / len(g_p) + bad_p, bad_u


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = STEPS) -> np.ndarray:
    """Weights and, last, the intercept that minimise the risk (full batches, Adam, from zero)."""
    x = np.vstack([positive, unlabelled]).astype(np.float32)
    n = len(positive)
    w, m, v = np.zeros((3, x.shape[1] + 1))
    w[-1] = np.log(prior / (1 - prior))
    for step in range(1, steps + 1):
        g = x @ w[:-1].astype(np.float32) + w[-1]
        d_p, d_u = _risk_gradient(g[:n].astype(float), g[n:].astype(float), prior)
        d = np.concatenate([d_p, d_u])
        grad = np.append(x.T @ d.astype(np.float32) + DECAY * w[:-1], d.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad ** 2
        w -= RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return w


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of good texts among the unlabelled, between 0.02 and 0.98: the best bin over the half that the first model hasn't seen."""
    w = fit(positive[::2], unlabelled[::2], 0.5)
    p, u = (np.sort(part[1::2] @ w[:-1] + w[-1]) for part in (positive, unlabelled))
    if not len(p) or not len(u):
        return 0.5
    at = np.unique(p)
    above_p, above_u = 1 - np.searchsorted(p, at) / len(p), 1 - np.searchsorted(u, at) / len(u)
    slack = np.sqrt(np.log(4 / 0.1) / 2 / len(u)) + np.sqrt(np.log(4 / 0.1) / 2 / len(p))
    best = int(np.argmin((above_u + slack) / above_p))
    return float(np.clip(above_u[best] / above_p[best], 0.02, 0.98))


def _collected(docs: DataFrame, ids: DataFrame, text_col: str) -> np.ndarray:
    """Features of the texts of at most SAMPLE ids (a bounded broadcast), in order of the ids' hashes; half precision on the way to the driver."""
    def seen(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([row.tobytes() for row in features(texts).astype(np.float16)], pa.binary())

    texts = docs.select(F.col("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")).filter("text != ''")
    rows = texts.join(F.broadcast(ids), "doc_id").select("_hash", F.arrow_udf(seen, "binary")(F.col("text")).alias("x"))
    found = rows.orderBy("_hash", "x").limit(2 * SAMPLE).collect()
    return np.array([np.frombuffer(r["x"], np.float16) for r in found], np.float32).reshape(-1, SIZE)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, text_col: str = "text", label_col: str = "quality") -> tuple[np.ndarray, float]:
    """The model and the estimated prior, from rows that aren't held out.

    A document is a trusted positive if it has a label and no label but 1; null ids and null
    labels don't count. Unlabelled are all documents. Empty texts aren't learned from. Without positives or texts
    the model is all zero (every score 0.5).
    """
    small_batches(docs.sparkSession)
    hashed = F.xxhash64(F.lit("quality"), F.col("doc_id").cast("string")).alias("_hash")
    smallest = lambda ids: ids.filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", hashed).distinct().orderBy("_hash", "doc_id").limit(sample)
    good = labels.groupBy("doc_id").agg(F.min(F.col(f"`{label_col}`").cast("long")).alias("low"), F.max(F.col(f"`{label_col}`").cast("long")).alias("high")).filter("low = 1 and high = 1")
    positive = _collected(docs, smallest(good.select("doc_id")), text_col)
    unlabelled = _collected(docs, smallest(docs.select("doc_id")), text_col)
    if len(positive) < 2 or len(unlabelled) < 2:
        return np.zeros(SIZE + 1), 0.5
    prior = estimated_prior(positive, unlabelled)
    return fit(positive, unlabelled, prior), prior


def score(docs: DataFrame, model: np.ndarray, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from ``threshold`` on), which replace columns of these names.

    Null texts count as empty; an empty text is scored by the intercept and its zero
    features. Equal texts get equal scores. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            z = features(texts).astype(float) @ shared.value[:-1] + shared.value[-1]
            yield pa.array(1 / (1 + np.exp(-np.clip(z, -50, 50))))

    judged = docs.withColumn("score", F.arrow_udf(scored, "double")(F.col(f"`{text_col}`").cast("string")))
    return judged.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def assess(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row, by a model of the rows that aren't held out."""
    model, _ = train(docs, labels, **options)
    own: Column = held_out(F.col("doc_id")).alias("held_out")
    return score(docs.select("doc_id", F.col("text").cast("string").alias("text")), model).select("doc_id", own, "score", "predicted")

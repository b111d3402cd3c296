"""Language identification by multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased; every run of letters, with a mark before and after it, gives its
n-grams of ORDERS characters, hashed into BUCKETS. Training counts (language, bucket)
are summed in Spark over all labelled rows. The model is a matrix of smoothed log
probabilities, BUCKETS x languages, whose size doesn't grow with the data, so it is
broadcast. A batch is scored sparsely: each distinct n-gram of a text picks its row of
the matrix.

The score is the posterior of the best language after the log likelihood is tempered: naive Bayes
takes n-grams as independent, which makes posteriors of long texts 1 whatever the text;
at most EVIDENCE n-grams' worth of evidence counts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import BATCH_BYTES, mix, small_batches, text_or_empty, utf8

ORDERS = (1, 2, 3)
BUCKETS = 1 << 16
SMOOTHING = 0.5
EVIDENCE = 50
#: Languages a model holds at most, since the matrix is broadcast: those with the most texts, ties to the first by name.
MOST_LANGUAGES = 200
UNKNOWN = "und"
_BLOCK = 1 << 18
_LOWER = np.arange(0x110000, dtype=np.uint32)
_LETTER = np.zeros(0x110000, bool)


def _load_letters() -> None:
    """Letters and their lower-case forms, from Python's own tables."""
    if not _LETTER.any():
        for c in range(0x110000):
            x = chr(c)
            if x.isalpha():
                _LETTER[c] = True
                low = x.lower()
                _LOWER[c] = ord(low) if len(low) == 1 else c


def code_points(data: np.ndarray) -> np.ndarray:
    """UTF-8 bytes as code points."""
    return np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)


def grams(chars: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams, and of which row each is; rows start at ``places``."""
    letter = _LETTER[chars]
    row = np.repeat(np.arange(len(places) - 1, dtype=np.int32), np.diff(places))
    low = np.where(letter, _LOWER[chars], 0).astype(np.uint64)
    if not len(low):
        return np.zeros(0, np.int64), np.zeros(0, np.int32)
    # marks: a 0 before each row and after the last, as blanks within a row are 0
    firsts = places[:-1]
    wide = np.append(np.insert(low, firsts, 0), np.uint64(0))
    owner = np.append(np.insert(row, firsts, np.arange(len(firsts), dtype=np.int32)), row[-1])
    inner = wide > 0
    buckets, rows = [], []
    with np.errstate(over="ignore"):
        for n in ORDERS:
            m = len(wide) - n + 1
            h, ok = np.zeros(m, np.uint64), np.ones(m, bool)
            for k in range(n):
                h = h * np.uint64(0x100000001B3) + wide[k:k + m] + np.uint64(1)
                if 0 < k < n - 1:
                    ok &= inner[k:k + m]
            if n < 3:
                ok = inner[:m] | inner[n - 1:n - 1 + m]
            at = np.where(inner[:m], owner[:m], owner[1:1 + m]) if n == 2 else owner[n // 2:n // 2 + m]
            h = mix(h + np.uint64(n << 32)) >> np.uint64(64 - BUCKETS.bit_length() + 1)
            buckets.append(h[ok].astype(np.int64))
            rows.append(at[ok])
    return np.concatenate(buckets), np.concatenate(rows)


def _blocks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows first to last of a column with their code points; a very long row comes in several blocks of its own."""
    _load_letters()
    data, places = utf8(column)
    first, rows = 0, len(places) - 1
    while first < rows:
        last = max(first + 1, int(np.searchsorted(places, places[first] + _BLOCK, "right")) - 1)
        at, end = int(places[first]), int(places[last])
        if last == first + 1 and end - at > _BLOCK:
            while at < end:
                to = min(end, at + _BLOCK)
                while to < end and 0x80 <= data[to] < 0xC0:  # not inside a character
                    to += 1
                chars = code_points(data[at:to])
                yield first, last, chars, np.array([0, len(chars)])
                at = to
        else:
            part = data[at:end]
            lead = np.concatenate([[0], np.cumsum((part & 0xC0) != 0x80)])
            yield first, last, code_points(part), lead[places[first:last + 1] - at]
        first = last


def _counted(languages: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(languages), BUCKETS), np.int64)
        number = {x: k for k, x in enumerate(languages)}
        for batch in batches:
            own = np.array([number[x] for x in batch.column("lang").to_pylist()], np.int64)
            for first, last, chars, places in _blocks(batch.column("text")):
                bucket, row = grams(chars, places)
                for k in np.unique(own[first:last]):
                    total[k] += np.bincount(bucket[own[first + row] == k], minlength=BUCKETS)
        for k, lang in enumerate(languages):
            hit = np.flatnonzero(total[k])
            if len(hit):
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(hit)), pa.array(hit), pa.array(total[k][hit])], ["lang", "bucket", "n"])
    return run


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages, and the log probabilities (BUCKETS x languages, with the log priors in a last row).

    Takes all rows whose language and text are not null, of MOST_LANGUAGES languages at most;
    without any there are no languages.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{text_col}`").cast("string").alias("text")).filter("lang is not null and text is not null")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES).collect()}
    languages = sorted(sizes)
    rows = rows.filter(F.col("lang").isin(languages))
    counts = np.zeros((BUCKETS, len(languages)))
    if languages:
        summed = rows.mapInArrow(_counted(languages), "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
        number = F.array_position(F.array(*map(F.lit, languages)), F.col("lang")).cast("int") - 1
        for part in summed.select("bucket", number.alias("lang"), "n").toArrow().to_batches():  # at most BUCKETS x MOST_LANGUAGES rows of 20 bytes
            bucket, lang, n = (part.column(c).to_numpy(zero_copy_only=False) for c in ("bucket", "lang", "n"))
            counts[bucket, lang] = n
    counts += SMOOTHING
    prior = np.array([sizes[x] for x in languages], float)
    return languages, np.vstack([np.log(counts / counts.sum(axis=0)), np.log(prior / max(prior.sum(), 1))]).astype(np.float32)


def _scored(languages: list[str], model):
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.StructArray]:
        table = model.value
        weights, prior = np.ascontiguousarray(table[:-1].T), table[-1].astype(float)
        for texts in batches:
            rows = len(texts)
            total, n = np.zeros((rows, len(languages))), np.zeros(rows)
            for first, last, chars, places in _blocks(texts):
                bucket, row = grams(chars, places)
                n[first:last] += np.bincount(row, minlength=last - first)
                for k in range(len(languages)):
                    total[first:last, k] += np.bincount(row, weights[k][bucket], minlength=last - first)
            best, score = [UNKNOWN] * rows, np.zeros(rows)
            if len(languages):
                tempered = total * (np.minimum(n, EVIDENCE) / np.maximum(n, 1))[:, None] + prior
                post = np.exp(tempered - tempered.max(axis=1, keepdims=True))
                post /= post.sum(axis=1, keepdims=True)
                top = tempered.argmax(axis=1)
                best = [languages[t] if some else UNKNOWN for t, some in zip(top.tolist(), n.tolist(), strict=True)]
                score = np.where(n > 0, post[np.arange(rows), top], 0.0)
            yield pa.StructArray.from_arrays([pa.array(best, pa.string()), pa.array(score, pa.float64())], ["lang_pred", "score"])
    return run


def predict(docs: DataFrame, languages: list[str], table: np.ndarray, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (which replace columns of these names).

    A text that is null or has no letter is ``und`` with score 0, as is every text where
    the model has no language. Equal texts get equal results; equal scores go to the
    language that comes first by name. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    run = _scored(languages, spark.sparkContext.broadcast(table))

    def scored(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return run(texts)

    udf = F.arrow_udf(scored, "lang_pred string, score double")
    judged = docs.withColumn("_judged", udf(F.col(f"`{text_col}`").cast("string")))
    return judged.withColumns({"lang_pred": F.col("_judged.lang_pred"), "score": F.col("_judged.score")}).drop("_judged")


def held_out(doc_id: Column) -> Column:
    """The quarter of documents that training leaves out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))

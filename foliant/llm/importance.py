"""Importance resampling towards a target distribution, with each distinct line counted once.

Texts are bags of features: all runs of ``orders`` consecutive words, hashed into buckets by
CRC-32. A bucket's gain is its log ratio of smoothed shares in the target and in the corpus;
a document's weight is the sum of its features' gains, and a fixed random number per
document (Gumbel) makes the highest scores a sample without replacement.

Corpora repeat lines (headers, notices, boilerplate), so texts are cut at newlines. Equal lines
of the whole corpus meet in one row with their number, which is summed before the shuffle; a
distinct line's features are counted once, times its occurrences. Runs of words that cross
a newline belong to no line and are added from the texts. Weights need no shuffle: each batch
of documents scores its distinct lines once and adds their totals up per document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import small_batches, written
from foliant.llm.ranks import ranked
from foliant.llm.wordgrams import cut, distinct_lines, runs

BUCKETS = 10_000
SEED = 2024
LEAST_WORDS = 20
PERCENT = 10


def _emitted(total: np.ndarray) -> Iterator[pa.RecordBatch]:
    hit = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(total[hit])], ["bucket", "n"])


def counts(texts: DataFrame, text_col: str, orders: tuple[int, int], buckets: int) -> np.ndarray:
    """How often each bucket's features stand in all texts.

    A null text has none. Every task emits at most one row a bucket.
    """
    small_batches(texts.sparkSession)
    text = F.col(f"`{text_col}`").cast("string")
    lines = texts.select(F.explode(F.split(text, "\n")).alias("line")).filter("line != ''").groupBy("line").agg(F.count("*").alias("n"))

    def of_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            times = batch.column("n").to_numpy(zero_copy_only=False)
            for first, _, words in cut(batch.column("line")):
                for crc, row in runs(words, orders, across=False):
                    total += np.bincount(crc % buckets, times[first + row], buckets).astype(np.int64)
        yield from _emitted(total)

    def across_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, words in cut(batch.column("text")):
                for crc, _ in runs(words, orders, across=True):
                    total += np.bincount(crc % buckets, minlength=buckets)
        yield from _emitted(total)

    found = lines.mapInArrow(of_lines, "bucket long, n long")
    if orders[1] > 1:
        found = found.unionByName(texts.select(text.alias("text")).mapInArrow(across_lines, "bucket long, n long"))
    total = np.zeros(buckets, np.int64)
    for bucket, n in found.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most one row a bucket
        total[bucket] = n
    return total


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A bucket's floored log ratio of smoothed shares, times 1000."""
    s, t, S, T = corpus.astype(float), target.astype(float), float(corpus.sum()), float(target.sum())
    return np.floor(1000 * np.log((t + 1) * (S + len(s)) / ((s + 1) * (T + len(s))))).astype(np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, orders: tuple[int, int], text_col: str = "text") -> DataFrame:
    """``docs`` with ``weighed``: n_words, n_features and weight of each text."""
    spark = docs.sparkSession
    small_batches(spark)
    shared, buckets = spark.sparkContext.broadcast(gain), len(gain)

    def totals(texts: pa.Array, across: bool) -> np.ndarray:
        """Words, features and gains per row."""
        table = shared.value
        out = np.zeros((3, len(texts)), np.int64)
        for first, last, words in cut(texts):
            out[0, first:last] = np.bincount(words.rows, minlength=last - first)
            for crc, row in runs(words, orders, across):
                out[1, first:last] += np.bincount(row, minlength=last - first)
                out[2, first:last] += np.bincount(row, table[crc % buckets], last - first).astype(np.int64)
        return out

    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            lines, number, starts = distinct_lines(texts)
            once = totals(lines, across=False)
            found = np.add.reduceat(once[:, number], starts[:-1], axis=1) if len(texts) else np.zeros((3, 0), np.int64)
            if orders[1] > 1:
                found[1:] += totals(texts, across=True)[1:]
            yield pa.StructArray.from_arrays([pa.array(x) for x in found], ["n_words", "n_features", "weight"])

    return docs.withColumn("weighed", F.arrow_udf(scored, "n_words long, n_features long, weight long")(F.col(f"`{text_col}`").cast("string")))


def resample(docs: DataFrame, target: DataFrame, orders: tuple[int, int] = (1, 1), buckets: int = BUCKETS, seed: int = SEED,
             least_words: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` of every row of ``docs``; rank is null for rows that aren't drawn.

    A null text has no words, weight 0, and is never drawn, as is any text of fewer than
    ``least_words`` words. Rows that repeat an id are scored and drawn on their own; their random numbers
    are equal. A null id counts as an empty one in the random number and loses ties. Equal scores go to the smaller id, then in
    any order. Without target texts all of the target's counts are 0. Empty tables give empty results.
    """
    own = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"))
    gain = gains(counts(own, "text", orders, buckets), counts(target, "text", orders, buckets))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")
    rows = weigh(own, gain, orders).select("doc_id", "weighed.n_words", "weighed.n_features", "weighed.weight", noise.alias("noise"))
    rows = written(rows.withColumn("score", F.col("weight") + F.col("noise")).drop("noise"))
    fit = ranked(rows.filter(F.col("n_words") >= least_words).withColumn("_all", F.lit(0)), "_all", [F.col("score").desc(), F.col("doc_id").asc_nulls_last()])
    drawn = F.when(F.col("pos") < F.floor(F.col("n") * percent / 100), F.col("pos") + 1)
    columns = ["doc_id", "n_features", "weight", "score"]
    rest = rows.filter(F.col("n_words") < least_words).select(*columns, F.lit(None).cast("long").alias("rank"))
    return fit.select(*columns, drawn.cast("long").alias("rank")).unionByName(rest)

"""Near-duplicate detection by one-permutation hashing.

Method: a document's set of word shingles is hashed once; the hash range is cut into
BINS bins and the smallest hash of each bin is its signature entry. An empty bin takes
the entry of the first non-empty bin in its own fixed random order of bins (optimal
densification), so entries of two sets agree with a probability equal to their
similarity, independently from bin to bin. BANDS bands of BINS / BANDS entries are the
bucket keys.

Documents with the same set are one class; only one head of it goes on. In a bucket the
candidates form a star: every member against one pivot, so that pairs grow with the
members. Members of a bucket whose links with their pivot fail may still be linked with
each other, so the buckets that then hold more than one component (others can gain
nothing) are compared in cells: their members' sets are dealt out to blocks of bounded
bytes, each pair of blocks is one group, and within it only members of different
components are compared, in numpy; what is emitted are links between components, never
pairs. So no pair that shares a bucket is lost unless it is connected anyway.

Links are confirmed on full sets. A pair of similarity 0.8 shares no bucket with a
probability of (1 - 0.8**4)**32 = 5e-8.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import dropped, mix, only, shared_folder, small_batches, text_or_empty, utf8, written
from foliant.llm.graph import components
from foliant.llm.shingles import shingle_sets

BINS = 128
BANDS = 32
#: Signature bytes of which so many agree at least go on to the exact check; at similarity 0.8 fewer do once in 10**8.
LEAST_EQUAL = 76
#: Bytes of sets in one block of a large bucket.
CELL_BYTES = 8 << 20
#: A class of equal sets with more than one in so many of all rows is looked up by a broadcast table, which so has at most that many rows.
HOT = 1000
#: Orders in which an empty bin looks for another's entry; each row is a permutation of all bins.
_ORDERS = np.stack([np.random.default_rng(1_000 + i).permutation(BINS) for i in range(BINS)])
_SHIFT = np.uint64(64 - BINS.bit_length() + 1)


def signature(hashes: np.ndarray) -> np.ndarray:
    """BINS entries for sorted distinct hashes (at least one)."""
    bins = (hashes >> _SHIFT).astype(np.int64)
    first = np.ones(len(bins), bool)
    first[1:] = bins[1:] != bins[:-1]
    entries, filled = np.zeros(BINS, np.uint64), np.zeros(BINS, bool)
    entries[bins[first]], filled[bins[first]] = hashes[first], True
    empty = np.flatnonzero(~filled)
    if len(empty):
        entries[empty] = entries[_ORDERS[empty, filled[_ORDERS[empty]].argmax(axis=1)]]
    return entries


def band_keys(entries: np.ndarray) -> np.ndarray:
    """One 64-bit bucket key for each band."""
    rows = entries.reshape(BANDS, -1)
    with np.errstate(over="ignore"):
        key = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for k in range(rows.shape[1]):
            key = mix(key * np.uint64(0xFF51AFD7ED558CCD) + rows[:, k])
    return key.view(np.int64)


def _digest(packed: bytes) -> bytes:
    return hashlib.blake2b(packed, digest_size=16).digest()


def _sketches(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, places = utf8(batch.column("text"))
            sizes, digests, bands, sigs = [], [], [], []
            for hashes in shingle_sets(data, places, words):
                sizes.append(len(hashes))
                if len(hashes):
                    entries = signature(hashes)
                    digests.append(_digest(hashes.tobytes()))
                    bands.append(band_keys(entries))
                    sigs.append((entries & np.uint64(0xFF)).astype(np.uint8).tobytes())
                else:
                    digests.append(None)
                    bands.append(np.zeros(0, np.int64))
                    sigs.append(None)
            ends = np.cumsum([0, *map(len, bands)]).astype(np.int32)
            flat = np.concatenate(bands) if bands else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()),
                 pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), pa.array(sigs, pa.binary())],
                ["id", "n_shingles", "digest", "bands", "sig"])
    return run


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, places = utf8(batch.column("text"))
            packed = [x.tobytes() for x in shingle_sets(data, places, words)]
            digests = [_digest(x) for x in packed]
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(packed, pa.binary())], ["digest", "packed"])
    return run


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for left, right in zip(batch.column("left"), batch.column("right"), strict=True):
                a, b = (np.frombuffer(x.as_buffer(), np.uint64) for x in (left, right))
                if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
                    keep.append(False)
                    continue
                both = np.concatenate([a, b])
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                keep.append(100 * shared >= percent * (len(both) - shared))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))
    return run


def _alike(least: int):
    """Keeps pairs of whose signature bytes at least ``least`` agree."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            left, right = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, BINS) for c in ("left", "right"))
            keep = (left == right).sum(axis=1) >= least
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep))
    return run


def _with_both(pairs: DataFrame, table: DataFrame, value: str) -> DataFrame:
    """a, b and the value of each."""
    left, right = only(table, digest="a", **{value: "left"}), only(table, digest="b", **{value: "right"})
    return pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right")


def _sets_of(texts: DataFrame, heads: DataFrame, comp: DataFrame, words: int) -> DataFrame:
    """The full sets of the digests in ``comp``; ``heads`` has their texts' ids."""
    chosen = texts.join(heads.select("low").distinct(), F.col("id").eqNullSafe(F.col("low")), "left_semi")
    sets = chosen.mapInArrow(_sets(words), "digest binary, packed binary").join(comp.select("digest"), "digest", "left_semi")
    return sets.groupBy("digest").agg(F.first("packed").alias("packed"))


def _open_buckets(members: DataFrame, comp: DataFrame, aggregate: list) -> tuple[DataFrame, DataFrame]:
    """``members`` with their components, and one row for each bucket that holds two components."""
    placed = members.join(comp, "digest")
    undone = placed.groupBy("bucket").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), *aggregate)
    return placed, undone.filter("low < high").drop("low", "high")


def _stars(members: DataFrame, comp: DataFrame) -> DataFrame:
    """The members of open buckets, each marked as its bucket's pivot or not."""
    ranked = F.min(F.struct(F.xxhash64("digest").alias("h"), "digest")).alias("first")
    placed, undone = _open_buckets(members, comp, [ranked])
    return placed.join(undone, "bucket").select("bucket", "digest", (F.col("digest") == F.col("first.digest")).alias("pivot"))


def _cells(members: DataFrame, comp: DataFrame, sets: DataFrame) -> DataFrame:
    """The members of open buckets dealt out to cells of at most about two blocks of CELL_BYTES of sets.

    A bucket of b blocks has a cell for each pair of blocks, so that any two of its members meet once.
    """
    sized = members.join(sets.select("digest", F.length("packed").alias("size")), "digest")
    placed, undone = _open_buckets(sized, comp, [F.ceil(F.sum("size") / CELL_BYTES).cast("long").alias("blocks")])
    own = F.pmod(F.xxhash64("digest", F.lit("block")), F.col("blocks"))
    placed = placed.join(undone, "bucket").withColumn("block", own).withColumn("to", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    placed = placed.select("bucket", "digest", "comp", "block", F.least("block", "to").alias("i"), F.greatest("block", "to").alias("j"))
    return placed.join(sets, "digest")


def _within_cells(percent: int):
    """Links between different components of a cell; of two components only the first link found."""
    def run(key: tuple, table: pa.Table) -> pa.Table:
        crossing = key[1].as_py() != key[2].as_py()
        digest, packed = table.column("digest").to_pylist(), table.column("packed").to_pylist()
        block = np.array(table.column("block"))
        flat = np.frombuffer(b"".join(packed), np.uint64)
        sizes = np.array([len(x) // 8 for x in packed])
        starts = np.concatenate([[0], np.cumsum(sizes)])
        values, codes = np.unique(flat, return_inverse=True)
        _, comp = np.unique(np.array(table.column("comp").to_pylist(), dtype="S16"), return_inverse=True)
        top = np.bincount(comp).argmax()
        mark, found = np.zeros(len(values), bool), []
        for q in np.flatnonzero(comp != top):
            others = comp != comp[q]
            if crossing:
                others &= block != block[q]
            others &= 100 * np.minimum(sizes, sizes[q]) >= percent * np.maximum(sizes, sizes[q])
            if not others.any():
                continue
            own = codes[starts[q]:starts[q + 1]]
            mark[own] = True
            shared = np.add.reduceat(mark[codes], starts[:-1], dtype=np.int64)
            mark[own] = False
            for k in np.flatnonzero(others & (100 * shared >= percent * (sizes + sizes[q] - shared))):
                if comp[k] != comp[q]:
                    found.append((digest[q], digest[k]))
                    comp[comp == comp[k]] = comp[q]
        return pa.table({"a": pa.array([x for x, _ in found], pa.binary()), "b": pa.array([x for _, x in found], pa.binary())})
    return run


def near_duplicates(docs: DataFrame, words: int = 4, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id`` (named by id_col), ``n_shingles``, ``component_id``, ``kept``.

    component_id is the smallest id that links reach, kept says whether it is the own one.
    Texts that are null, empty or without words have an empty set and are linked with
    nothing: their component is their own id. Rows that repeat an id are rows of their own
    (equal texts fall into one component in any case). A null id is never a component's
    smallest unless all ids are null; then component_id is null and the row is kept. An
    empty table gives an empty result. Other columns of ``docs`` are ignored.
    """
    spark, base = docs.sparkSession, shared_folder(docs.sparkSession)
    small_batches(spark)
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), text_or_empty(F.col(f"`{text_col}`")).alias("text"))
    kind = texts.schema["id"].dataType.simpleString()
    sketches = written(texts.mapInArrow(_sketches(words), f"id {kind}, n_shingles long, digest binary, bands array<long>, sig binary"))

    # one head for each class of equal sets, from partial sums: a class of any size is no hot group
    heads = written(sketches.filter("n_shingles > 0").groupBy("digest")
                    .agg(F.min("id").alias("low"), F.first("bands").alias("bands"), F.first("sig").alias("sig"), F.count("*").alias("rows")))
    buckets = heads.select("digest", F.explode("bands").alias("bucket"))
    shared = buckets.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1").select("bucket")
    members = written(buckets.join(shared, "bucket", "left_semi"), f"{base}/members")
    comp = written(members.select("digest").distinct().withColumn("comp", F.col("digest")))
    sets = written(_sets_of(texts, heads.join(comp, "digest", "left_semi").select("low"), comp, words), f"{base}/sets")

    # stars: each member of a bucket against its pivot
    stars = written(_stars(members, comp), f"{base}/stars")
    pivots = stars.filter("pivot").select("bucket", F.col("digest").alias("other"))
    pairs = (stars.filter("not pivot").join(pivots, "bucket")
             .select(F.least("digest", "other").alias("a"), F.greatest("digest", "other").alias("b")).distinct())
    alike = written(_with_both(pairs, heads, "sig").mapInArrow(_alike(LEAST_EQUAL), "a binary, b binary"), f"{base}/alike")
    links = _with_both(alike, sets, "packed").mapInArrow(_confirm(percent), "a binary, b binary")
    comp = components(links, comp)

    # what the stars left apart in a bucket
    cells = _cells(stars.filter("not pivot").select("bucket", "digest"), comp, sets)
    links = cells.groupBy("bucket", "i", "j").applyInArrow(_within_cells(percent), "a binary, b binary")
    comp = components(links, comp)
    dropped(spark, *[f"{base}/{x}" for x in ("members", "sets", "stars", "alike")])
    lowest = comp.join(heads.select("digest", "low"), "digest").groupBy("comp").agg(F.min("low").alias("component"))
    placed = heads.select("digest", "low", "rows").join(comp.join(lowest, "comp"), "digest", "left").select("digest", "rows", F.coalesce("component", "low").alias("component"))
    return _of_rows(sketches.select("id", "n_shingles", "digest"), written(placed), id_col)


def _of_rows(sketches: DataFrame, placed: DataFrame, id_col: str) -> DataFrame:
    """Every row with its class's component. Rows without words and those of large classes, which would meet in one task, aren't shuffled."""
    total = placed.agg(F.coalesce(F.sum("rows"), F.lit(0))).head()[0]
    large = F.broadcast(placed.filter(F.col("rows") * HOT > total).select("digest", "component"))
    wordless = sketches.filter("digest is null").withColumn("component", F.col("id"))
    worded = sketches.filter("digest is not null")
    known = worded.join(large, "digest")
    others = worded.join(large, "digest", "left_anti").join(placed.select("digest", "component"), "digest")
    columns = [F.col("id").alias(id_col), "n_shingles", F.col("component").alias("component_id")]
    rows = wordless.select(*columns).unionByName(known.select(*columns)).unionByName(others.select(*columns))
    return rows.withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))

"""Sources to chunks: identity, reuse, chunking, manifests, upload rules."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import col, corpus_clean, let, strip
from ..plans.scans import top_rows
from ..plans.sizing import bounded_broadcast
from ..session import cut, stored

CHUNK_SIZE = 1100
CHUNK_OVERLAP = 220
MIN_CHUNK_CHARS = 40
SEPARATORS = ["\n\n", "\n", ". ", "? ", "! ", "; ", ": ", " "]
CHUNK_VERSION = 1
BATCH_CHARS = 1 << 20
TEXT_SUFFIXES = [".txt"]
PDF_SUFFIXES = [".pdf"]
IMAGE_SUFFIXES = [".png", ".jpg", ".jpeg", ".webp", ".bmp", ".gif"]


# -- identity -------------------------------------------------------------------------

def json_string(x) -> Column:
    """A JSON string literal with everything beyond ASCII escaped as ``\\uXXXX`` pairs."""
    quoted = F.to_json(F.struct(col(x).alias("v")))
    inner = F.substr(quoted, F.lit(6), F.length(quoted) - 6)

    def escape(ch):
        # UTF-16 units in hexadecimal, so characters beyond the basic plane become a pair
        units = F.lower(F.hex(F.encode(ch, "UTF-16BE")))
        return F.regexp_replace(units, "(.{4})", r"\\u$1")

    escaped = F.array_join(F.transform(
        F.regexp_extract_all(inner, F.lit(r"[\x00-\x7F]+|[^\x00-\x7F]"), F.lit(0)),
        lambda ch: F.when(ch.rlike(r"^[^\x00-\x7F]"), escape(ch)).otherwise(ch)), "")
    return F.when(inner.rlike(r"[^\x00-\x7F]"), escaped).otherwise(inner)


def dataset_ids(sources: DataFrame, corpus: str = "corpus") -> DataFrame:
    """First 16 hex digits of the hash over the ordered (name, sha256) list of each corpus.

    The hash is defined over one ordered byte sequence, so rows are sorted by
    (corpus, name, hash, path) and fed through an incremental hash: no list of
    a corpus is ever built, memory stays constant whatever its size.
    """
    entry = F.concat(F.lit('{"name": '), json_string("name"), F.lit(', "sha256": "'), F.col("sha256"), F.lit('"}'))
    rows = sources.select(
        F.col(corpus).alias("corpus"), F.lower("name").alias("k1"), F.col("sha256").alias("k2"),
        F.col("path").alias("k3"), entry.alias("entry"))
    ordered = rows.repartition("corpus").sortWithinPartitions("corpus", "k1", "k2", "k3").select("corpus", "entry")

    def feed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state, count = None, None, 0
        for batch in batches:
            done = []
            for name, entries in batch.groupby("corpus", sort=False)["entry"]:
                if state is None or name != current:
                    if state is not None:
                        state.update(b"]")
                        done.append((current, state.hexdigest()[:16], count))
                    current, state, count = name, hashlib.sha256(b"["), 0
                joined = ", ".join(entries)
                state.update(((", " if count else "") + joined).encode())
                count += len(entries)
            if done:
                yield pd.DataFrame(done, columns=["corpus", "dataset_id", "source_count"])
        if state is not None:
            state.update(b"]")
            yield pd.DataFrame([(current, state.hexdigest()[:16], count)],
                               columns=["corpus", "dataset_id", "source_count"])

    return ordered.mapInPandas(feed, "corpus string, dataset_id string, source_count long")


#: Entries of one run of a change key, about; a run is one row's work.
RUN = 1024


def change_keys(entries: DataFrame, corpus: str = "corpus", run: int = RUN) -> DataFrame:
    """corpus, change_key, entry_count: equal keys mean equal multisets of entries (all other columns).

    Entries are hashed each for itself and fall into runs by the first hexadecimal digits of
    their hashes, as many digits as leave about ``run`` entries to a run. A run's digest is
    that of its sorted hashes; a corpus of one run has that as its key. Otherwise the key is the hash over its
    runs in order, digits and digest, which go through one task with constant memory as in ``dataset_ids``: entries
    of a corpus of any size spread over many tasks, and only one short row a run is left for the last step.
    """
    body = F.to_json(F.struct(*[F.col(c) for c in entries.columns if c != corpus]), {"ignoreNullFields": "false"})
    hashed = entries.select(F.col(corpus).alias("corpus"), F.sha2(body, 256).alias("digest"))
    sizes = cut(hashed.groupBy("corpus").agg(F.count("*").alias("entry_count")))
    digits = F.greatest(F.lit(0), F.ceil(F.log(F.col("entry_count") / run) / F.log(F.lit(16.0)))).cast("int")
    named = sizes.select("corpus", "entry_count", digits.alias("digits"), F.to_json(F.struct("corpus")).alias("key"))
    rows = hashed.join(bounded_broadcast(named.select(F.col("corpus").alias("_c"), "digits", "key")), F.col("corpus").eqNullSafe(F.col("_c"))).select(
        "key", F.substr("digest", F.lit(1), F.col("digits")).alias("run"), "digest")
    rows = rows.groupBy("key", "run").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("digest")), ""), 256).alias("digest"))
    ordered = rows.repartition("key").sortWithinPartitions("key", "run").select("key", (F.col("run") == "").alias("whole"), F.concat("run", "digest").alias("entry"))

    def feed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, None
        for batch in batches:
            done = []
            for (key, whole), runs in batch.groupby(["key", "whole"], sort=False)["entry"]:
                if key != current and state is not None:
                    done.append((current, state.hexdigest()))
                    state = None
                if whole:
                    done.append((key, runs.iloc[0]))
                    continue
                current, state = key, state or hashlib.sha256()
                state.update("".join(runs).encode())
            if done:
                yield pd.DataFrame(done, columns=["key", "change_key"])
        if state is not None:
            yield pd.DataFrame([(current, state.hexdigest())], columns=["key", "change_key"])

    return named.join(ordered.mapInPandas(feed, "key string, change_key string"), "key").select("corpus", "entry_count", "change_key")


def changed_by_key(old: DataFrame, new: DataFrame, corpus: str = "corpus") -> DataFrame:
    """corpus, changed: corpora of either side whose change keys differ; only one row a corpus is compared."""
    a, b = (change_keys(side, corpus).select("corpus", F.col("change_key").alias(name)) for side, name in ((old, "was"), (new, "now")))
    return a.join(b, "corpus", "full_outer").select("corpus", (~F.col("was").eqNullSafe(F.col("now"))).alias("changed"))


def corpus_labels(sources: DataFrame, corpus: str, order: str, name: str = "name", limit: int = 80) -> DataFrame:
    """Names joined by ``, `` and cut to ``limit``: only the names that can still show are gathered."""
    shown = top_rows(sources.select(F.col(corpus).alias("corpus"), F.col(name).alias("name"), F.col(order).alias("_o")),
                     ["corpus"], [F.col("_o"), F.col("name")], limit // 2 + 2)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "name"))), lambda s: s["name"]), ", ")
    text = shown.groupBy("corpus").agg(joined.alias("_text"))
    cut_text = F.concat(F.regexp_replace(F.substring("_text", 1, limit - 3), r"(?U)\s+$", ""), F.lit("..."))
    return text.select("corpus", F.when(F.length("_text") <= limit, F.col("_text")).otherwise(cut_text).alias("label"))


# -- chunking ---------------------------------------------------------------------------

def chunk_id(sha, index) -> Column:
    return F.concat(F.substring(col(sha), 1, 12), F.lit("-"), F.format_string("%04d", col(index).cast("int")))


def fixed_chunks(sources: DataFrame, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """Windows of ``size`` characters at a stride of ``size - overlap``, all native.

    They are cut from a form of four bytes a character, so that a window is a place in
    memory; from UTF-8 each cut would count the characters before it.
    """
    text = F.col("_text")
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(size - overlap))
    window = lambda wide, s: strip(F.decode(F.substring(wide, s * 4 + 1, F.lit(size * 4)), "UTF-32"))
    cut_up = let(F.encode(text, "UTF-32"), lambda wide: F.transform(starts, lambda s: window(wide, s)))
    pieces = sources.withColumn("_text", corpus_clean("content")).filter(F.length("_text") > 0).select(
        "name", "path", "sha256", F.posexplode(cut_up).alias("chunk_index", "content"))
    return _chunk_rows(pieces)


def split_recursively(text: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, separators=SEPARATORS) -> list[str]:
    """Cut at the coarsest separator present, recurse into long parts, merge short ones with an overlap.

    A separator stays at the head of the part that follows it.
    """
    level = next((i for i, s in enumerate(separators) if s in text), len(separators) - 1)
    separator, finer = separators[level], separators[level + 1:]
    head, *rest = text.split(separator)
    parts = [p for p in [head, *(separator + r for r in rest)] if p]
    chunks: list[str] = []
    short: list[str] = []

    def flush():
        if short:
            chunks.extend(_merge(short, size, overlap))
            short.clear()

    for part in parts:
        if len(part) < size:
            short.append(part)
            continue
        flush()
        chunks.extend(split_recursively(part, size, overlap, finer) if finer else [part])
    flush()
    return chunks


def _merge(parts: list[str], size: int, overlap: int) -> list[str]:
    merged, first, total = [], 0, 0
    for position, part in enumerate(parts):
        if total + len(part) > size and position > first:
            merged.append("".join(parts[first:position]).strip())
            while total > overlap or (total > 0 and total + len(part) > size):
                total -= len(parts[first])
                first += 1
        total += len(part)
    merged.append("".join(parts[first:]).strip())
    return [m for m in merged if m]


def chunk_batches(batches: Iterator[pa.RecordBatch], split) -> Iterator[pa.RecordBatch]:
    """Pieces of the texts of (name, path, sha256, content) batches, one text after another: a batch may
    hold thousands, and all their pieces as Python rows take several times its size."""
    schema = pa.schema([("name", pa.string()), ("path", pa.string()), ("sha256", pa.string()), ("chunk_index", pa.int32()), ("content", pa.string())])
    rows_of = lambda columns: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
    for batch in batches:
        made, held = ([], [], [], [], []), 0
        for name, path, sha256, content in zip(*batch.columns, strict=True):
            text = content.as_py()
            for number, piece in enumerate(split(text) if text else []):
                for column, value in zip(made, (name.as_py(), path.as_py(), sha256.as_py(), number, piece.strip()), strict=True):
                    column.append(value)
                held += len(piece)
                if held > BATCH_CHARS:
                    yield rows_of(made)
                    made, held = ([], [], [], [], []), 0
        if made[0]:
            yield rows_of(made)


def recursive_chunks(sources: DataFrame, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP,
                     splitter=split_recursively) -> DataFrame:
    """Recursive chunking: sequential inside a document, documents spread over all tasks.

    ``splitter`` is the plug point for another chunker: (text, size, overlap) -> list of strings.
    """
    cleaned = sources.select("name", "path", "sha256", corpus_clean("content").alias("content"))

    run = lambda batches: chunk_batches(batches, lambda text: splitter(text, size, overlap))
    return _chunk_rows(cleaned.mapInArrow(
        run, "name string, path string, sha256 string, chunk_index int, content string"))


def _chunk_rows(pieces: DataFrame) -> DataFrame:
    return pieces.filter(F.length("content") >= MIN_CHUNK_CHARS).select(
        chunk_id("sha256", "chunk_index").alias("chunk_id"),
        F.col("name").alias("source_name"), F.col("path").alias("source_path"),
        F.col("sha256").alias("source_sha256"), F.col("chunk_index").cast("int").alias("chunk_index"), "content")


# -- reuse ---------------------------------------------------------------------------------

def pending_sources(sources: DataFrame, chunked: DataFrame) -> DataFrame:
    """Sources whose content has no chunks yet."""
    return sources.join(chunked.select(F.col("source_sha256").alias("sha256")), "sha256", "left_anti")


_STORE = ["version", "chunk_size", "chunk_overlap", "bucket"]
CHUNK_ROW = "chunk_id string, source_name string, source_path string, source_sha256 string, chunk_index int, content string"


def write_chunks(chunks: DataFrame, path: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> None:
    """Put chunks into the store at ``path``; sources that it holds already are replaced, so that a repeated write changes nothing.

    The store is cut into buckets by the first two digits of the source's hash. Only the
    buckets of the written sources are read and written anew, each as a whole: a write that
    fails leaves them as they were.
    """
    spark = chunks.sparkSession
    new = stored(chunks.withColumn("bucket", F.substring("source_sha256", 1, 2)))
    touched = [r[0] for r in new.select("bucket").distinct().collect()]  # 256 at most
    rows = new
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        held = _held(spark, path, size, overlap).filter(F.col("bucket").isin(touched))
        kept = held.join(new.select("source_sha256").distinct(), "source_sha256", "left_anti")
        rows = stored(new.unionByName(kept.select(*new.columns)))
    (rows.withColumn("version", F.lit(CHUNK_VERSION)).withColumn("chunk_size", F.lit(size)).withColumn("chunk_overlap", F.lit(overlap))
     .repartition("bucket").sortWithinPartitions("bucket", "source_sha256", "chunk_index")
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*_STORE).parquet(path))


def _held(spark, path: str, size: int, overlap: int) -> DataFrame:
    rows = spark.read.schema(f"{CHUNK_ROW}, version int, chunk_size int, chunk_overlap int, bucket string").parquet(path)
    return rows.filter((F.col("version") == CHUNK_VERSION) & (F.col("chunk_size") == size) & (F.col("chunk_overlap") == overlap))


def read_chunks(spark, path: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """The stored chunks of one size and overlap."""
    return _held(spark, path, size, overlap).drop(*_STORE)


def reused_chunks(sources: DataFrame, path: str, chunker=fixed_chunks, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """The chunks of all ``sources``: stored ones are read, only the others are cut and stored. Each has the name and path of its source here."""
    spark = sources.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    known = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
    pending = pending_sources(sources, read_chunks(spark, path, size, overlap)) if known else sources
    write_chunks(chunker(pending.dropDuplicates(["sha256"]), size, overlap), path, size, overlap)
    chunks = read_chunks(spark, path, size, overlap).drop("source_name", "source_path")
    own = sources.select(F.col("name").alias("source_name"), F.col("path").alias("source_path"), F.col("sha256").alias("source_sha256"))
    return chunks.join(own, "source_sha256").select(*[c.split(" ")[0] for c in CHUNK_ROW.split(", ")])


def chunk_status(sources: DataFrame, chunks: DataFrame, key: str = "sha256") -> DataFrame:
    counts = chunks.groupBy(F.col("source_sha256").alias(key)).agg(F.count("*").alias("chunk_count"))
    return sources.join(counts, key, "left").select(
        *sources.columns, F.coalesce(F.col("chunk_count") > 0, F.lit(False)).alias("ready"), "chunk_count")


# -- manifests -------------------------------------------------------------------------------

def manifest_headers(sources: DataFrame, chunks: DataFrame, model: str, corpus: str = "corpus",
                     size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """One row of counts and settings per corpus; the id lists stay in their own tables."""
    s = sources.groupBy(F.col(corpus).alias("corpus")).agg(F.count("*").alias("source_count"))
    c = chunks.groupBy(F.col(corpus).alias("corpus")).agg(F.count("*").alias("chunk_count"))
    return s.join(c, "corpus", "left").select(
        "corpus", F.lit(model).alias("embedding_model"), F.lit(size).alias("chunk_size"),
        F.lit(overlap).alias("chunk_overlap"), "source_count", F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"))


def changed_corpora(old: DataFrame, new: DataFrame, corpus: str = "corpus") -> DataFrame:
    """Corpora whose manifest rows differ. Both sides hold one row per source or chunk entry.

    Multisets are compared by counting each entry on both sides, so no corpus is
    gathered anywhere: entries combine before the shuffle and keys spread evenly.
    """
    entry = [c for c in new.columns if c != corpus]
    both = (old.select(corpus, *entry, F.lit(1).alias("_side"))
            .unionByName(new.select(corpus, *entry, F.lit(-1).alias("_side"))))
    per_entry = both.groupBy(corpus, *entry).agg(F.sum("_side").alias("_net"))
    return per_entry.groupBy(corpus).agg(F.max(F.col("_net") != 0).alias("changed"))


def upsert(existing: DataFrame, incoming: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Rows of ``incoming`` replace rows of ``existing`` with the same key."""
    new = incoming.select(key, F.struct(*fields).alias("_new"))
    old = existing.select(key, F.struct(*fields).alias("_old"))
    return old.join(new, key, "full_outer").select(key, F.coalesce("_new", "_old").alias("_row")).select(
        key, *[F.col("_row")[f].alias(f) for f in fields])


# -- uploads ----------------------------------------------------------------------------------

def new_uploads(batch: DataFrame, stored: DataFrame, keys=("user_id", "original_name", "sha256")) -> DataFrame:
    """Rows of the batch that are neither stored yet nor repeated within the batch."""
    return batch.dropDuplicates(list(keys)).join(stored.select(*keys), list(keys), "left_anti")


def suffix(name) -> Column:
    """Lower-case file suffix; a leading dot alone is not one."""
    base = F.element_at(F.split(col(name), "/"), -1)
    return F.lower(F.regexp_extract(base, r"(?<=[^.])(\.[^.]+)$", 1))


def attachment_kind(name) -> Column:
    s = suffix(name)
    return F.when(s.isin(TEXT_SUFFIXES), "text").when(s.isin(PDF_SUFFIXES), "pdf").when(s.isin(IMAGE_SUFFIXES), "image")


def uploadable(name, chat: bool = False) -> Column:
    allowed = TEXT_SUFFIXES + PDF_SUFFIXES + (IMAGE_SUFFIXES if chat else [])
    return suffix(name).isin(allowed)


def restored_selection(selected: DataFrame, sources: DataFrame) -> DataFrame:
    """The stored selection when all its paths still exist; nothing otherwise."""
    known = sources.select("path").distinct().withColumn("_known", F.lit(True))
    marked = selected.join(known, "path", "left")
    gaps = marked.groupBy("selection").agg(F.count_if(F.col("_known").isNull()).alias("_missing"))
    return selected.join(gaps.filter("_missing = 0").select("selection"), "selection", "left_semi")

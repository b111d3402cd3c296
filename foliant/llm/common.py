"""Helpers that several operators of this folder share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.session import cut

#: Rows and bytes of one Arrow batch that a task holds at a time.
BATCH_ROWS = 1000
BATCH_BYTES = 16 << 20


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most BATCH_ROWS rows and about BATCH_BYTES bytes, so that long texts don't fill a task."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the cluster's shared one (spark.checkpoint.dir).

    Where that is unset, as in tests, the context's checkpoint folder is taken;
    ``cut`` makes one for a single machine.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        cut(spark.range(1))
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    return f"{base.rstrip('/')}/llm-{uuid.uuid4().hex}"


def written(df: DataFrame, folder: str | None = None) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: cuts lineage, keeps column pruning."""
    path = folder or shared_folder(df.sparkSession)
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, *paths: str) -> None:
    """Delete tables that ``written`` made and nothing reads any more, through the file system that holds them."""
    for path in paths:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def only(df: DataFrame, **columns: str) -> DataFrame:
    """The named columns under new names: ``only(df, doc_id="id")``. Whatever else ``df`` has is left behind."""
    return df.select(*[F.col(f"`{name}`").alias(new) for name, new in columns.items()])


def text_or_empty(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit(""))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, and where each row starts (one more at the end). Null counts as empty."""
    column = column.fill_null("").cast(pa.large_string())
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, places, data = column.buffers()
    places = np.frombuffer(places, np.int64, len(column) + 1, column.offset * 8) if places else np.zeros(1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data and data.size else np.zeros(0, np.uint8)
    return whole[places[0]:places[-1]], places - places[0]


def portions(places: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes together; a longer row stands alone."""
    first, rows = 0, len(places) - 1
    while first < rows:
        last = int(np.searchsorted(places, places[first] + most, "right")) - 1
        last = min(rows, max(first + 1, last))
        yield first, last
        first = last


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly (the public splitmix64 finaliser)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def stream(seed: int, n: int) -> np.ndarray:
    """n fixed 64-bit values from a seed."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))

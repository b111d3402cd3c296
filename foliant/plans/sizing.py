"""Broadcast only what has been counted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 64 << 20


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether ``df`` has at most ``rows`` rows of ``size`` bytes together, written as text; reads at most ``rows + 1`` rows."""
    seen = df.limit(rows + 1).select(F.length(F.to_json(F.struct("*"))).cast("long").alias("n"))
    told = seen.agg(F.count("*").alias("rows"), F.coalesce(F.sum("n"), F.lit(0)).alias("bytes")).head()
    return told["rows"] <= rows and told["bytes"] <= size


def bounded_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, written once, with a broadcast hint when it is small; otherwise as it is,
    so that the join shuffles and adaptive execution splits its skewed keys."""
    df = cut(df)  # measured and joined without computing it twice
    return F.broadcast(df) if is_small(df, rows) else df


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition by key into a fixed number of tasks, before work that costs far more
    CPU than its byte size suggests (adaptive coalescing looks at bytes only)."""
    spark = df.sparkSession
    width = max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), spark.sparkContext.defaultParallelism)
    return df.repartition(width, *keys)


def widen(df: DataFrame, *keys: str) -> DataFrame:
    """``spread`` only when the input has fewer splits than there are cores, as with one small file."""
    if df.rdd.getNumPartitions() < df.sparkSession.sparkContext.defaultParallelism:
        return spread(df, *keys)
    return df

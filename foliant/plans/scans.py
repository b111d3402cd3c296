"""Ordered scans that keep one hot key spread over many tasks.

A plain window partitioned by a key puts that whole key into one task. These
helpers cut each key's order column into blocks of ``block`` positions: blocks
are summarised first (combined before the shuffle), the summaries (rows/block
of them) are scanned per key, and each block then finishes on its own.
The order column must be an integer that is unique within the key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import stored

BLOCK = 8192


def _blocked(df: DataFrame, order: str, block: int) -> DataFrame:
    return df.withColumn("_block", F.floor(F.col(order) / F.lit(block)).cast("long"))


def running_sum(df: DataFrame, keys: list[str], order: str, value: Column, out: str,
                block: int = BLOCK, newest_first: bool = False) -> DataFrame:
    """Sum of ``value`` over all rows of the key up to and including this row."""
    rows = _blocked(df.withColumn("_value", value), order, block)
    direction = (lambda c: F.col(c).desc()) if newest_first else (lambda c: F.col(c).asc())
    before = Window.partitionBy(*keys).orderBy(direction("_block")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        rows.groupBy(*keys, "_block").agg(F.sum("_value").alias("_sum"))
        .select(*keys, "_block", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset"))
    )
    inside = Window.partitionBy(*keys, "_block").orderBy(direction(order)).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    return (
        rows.join(offsets, [*keys, "_block"])
        .withColumn(out, F.sum("_value").over(inside) + F.col("_offset"))
        .drop("_block", "_value", "_offset")
    )


def dense_index(df: DataFrame, keys: list[str], order: str, out: str, block: int = BLOCK) -> DataFrame:
    """Position 1, 2, 3, ... of each row within its key."""
    return running_sum(df, keys, order, F.lit(1).cast("long"), out, block)


def carry_forward(df: DataFrame, keys: list[str], order: str, value: str, out: str,
                  block: int = BLOCK) -> DataFrame:
    """Latest non-null ``value`` at or before this row."""
    rows = _blocked(df, order, block)
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    entering = (
        rows.groupBy(*keys, "_block")
        .agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col(order))).alias("_last"))
        .select(*keys, "_block", F.last("_last", ignorenulls=True).over(before).alias("_entering"))
    )
    inside = Window.partitionBy(*keys, "_block").orderBy(order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    return (
        rows.join(entering, [*keys, "_block"])
        .withColumn(out, F.coalesce(F.last(value, ignorenulls=True).over(inside), F.col("_entering")))
        .drop("_block", "_entering")
    )


def preceding_rows(df: DataFrame, keys: list[str], position: str, fields: list[str], count: int, out: str,
                   block: int = BLOCK) -> DataFrame:
    """The ``count`` rows before each row as an array of structs, oldest first.

    ``position`` must be dense (see ``dense_index``). The last ``count`` rows of
    a block are copied into the next one, so blocks need no neighbours.
    """
    body = F.struct(F.col(position).alias("position"), *fields)
    rows = _blocked(df, position, block).withColumn("_halo", F.lit(False))
    halo = (
        rows.filter(F.pmod(F.col(position), F.lit(block)) >= block - count)
        .withColumn("_block", F.col("_block") + 1).withColumn("_halo", F.lit(True))
    )
    inside = Window.partitionBy(*keys, "_block").orderBy(position).rowsBetween(-count, -1)
    return (
        rows.unionByName(halo)
        .withColumn(out, F.collect_list(body).over(inside))
        .filter(~F.col("_halo")).drop("_block", "_halo")
    )


def sorted_place(df: DataFrame, keys: list[str], order: list[Column], out: str = "place") -> DataFrame:
    """Position 1, 2, 3, ... of each row within its key by any ``order``, whatever the size of a key.

    Rows are dealt into ranges of (keys, order) and written, so that the ranges stay as they
    are when an executor is lost. A place is the row's place in its range plus the rows of the
    key in earlier ranges; only one row per key and range is scanned for that. A null is a key
    of its own. Rows that are equal in ``order`` follow each other in any sequence; they are dealt apart too.
    """
    by = [*[F.col(k).asc_nulls_first() for k in keys], *order, F.col("_tie")]
    dealt = df.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*by).sortWithinPartitions(*by)
    dealt = stored(dealt.drop("_tie").withColumn("_at", F.monotonically_increasing_id()))
    dealt = dealt.withColumn("_range", F.shiftright("_at", 33))
    sums = dealt.groupBy(*keys, "_range").agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*[F.col(k).alias(f"_{i}") for i, k in enumerate(keys)], F.col("_range").alias("_of"), "_first",
                       F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    same = F.col("_range") == F.col("_of")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_{i}"))
    place = (F.col("_at") - F.col("_first") + F.col("_before") + 1).cast("long")
    return dealt.join(sums, same).select(*df.columns, place.alias(out))


def top_rows(df: DataFrame, keys: list[str], order: list[Column], limit: Column | int, out: str = "rank") -> DataFrame:
    """Best rows per key. A constant limit is pushed below the shuffle as a group limit."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(out, F.row_number().over(window)).filter(F.col(out) <= limit)

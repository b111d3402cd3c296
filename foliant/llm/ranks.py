"""Positions in a sorted order, without a task that sees the whole order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm.common import written


def ranked(rows: DataFrame, group: str, order: list[Column]) -> DataFrame:
    """``rows`` with ``pos`` (0, 1, 2, ... in its group by ``order``) and ``n`` (rows of its group).

    Rows are dealt into ranges of (group, order), so a group of any size spreads over many
    tasks; a position is the place in the range plus the rows of earlier ranges, and only
    one row per range and group is summed for that. A null is a group of its own. Rows that
    are equal in ``order`` follow each other in any sequence; they are dealt apart too.
    """
    keys = [F.col(group).asc_nulls_first(), *order, F.col("_tie")]
    dealt = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    dealt = written(dealt.drop("_tie").withColumn("_at", F.monotonically_increasing_id()))
    dealt = dealt.withColumn("_range", F.shiftright("_at", 33))
    sums = dealt.groupBy(F.col(group).alias("_group"), F.col("_range").alias("_of")).agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    whole = Window.partitionBy("_group")
    before = whole.orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumns({"_before": F.coalesce(F.sum("_rows").over(before), F.lit(0)), "n": F.sum("_rows").over(whole)})
    found = dealt.join(sums, (F.col("_range") == F.col("_of")) & F.col(group).eqNullSafe(F.col("_group")))
    return found.withColumn("pos", F.col("_at") - F.col("_first") + F.col("_before")).drop("_at", "_range", "_group", "_of", "_first", "_rows", "_before")

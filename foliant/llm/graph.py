"""Connected components by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import dropped, shared_folder, written


def components(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """``labels`` (a node column, comp) after joining the components that ``edges`` (a, b: nodes) connect.

    Every round each component takes the smallest component it has an edge to, and then that
    one's choice; edges are kept between components only. A path of n nodes needs about log n
    rounds. No row holds more than one edge, so that a node of any degree is no hot group:
    minima are summed before the shuffle.
    """
    spark, base, step = labels.sparkSession, shared_folder(labels.sparkSession), 0
    node = labels.columns[0]
    of = labels.select(F.col(node).alias("node"), "comp")
    left, right = (of.select(F.col("node").alias(x), F.col("comp").alias(f"{x}_comp")) for x in ("a", "b"))
    edges = edges.join(left, "a").join(right, "b").select(F.col("a_comp").alias("a"), F.col("b_comp").alias("b"))
    edges = written(edges.filter("a <> b").distinct(), f"{base}/edges-0")
    while not edges.isEmpty():
        step += 1
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = written(both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("comp"), F.least("a", "least").alias("next")), f"{base}/near-{step}")
        further = near.select(F.col("comp").alias("next"), F.col("next").alias("last"))
        choice = written(near.join(further, "next").select("comp", F.col("last").alias("next")), f"{base}/choice-{step}")
        labels = written(labels.join(choice, "comp", "left").select(node, F.coalesce("next", "comp").alias("comp")), f"{base}/labels-{step}")
        a, b = (choice.select(F.col("comp").alias(x), F.col("next").alias(f"next_{x}")) for x in ("a", "b"))
        edges = edges.join(a, "a").join(b, "b").select(F.col("next_a").alias("a"), F.col("next_b").alias("b"))
        edges = written(edges.filter("a <> b").distinct(), f"{base}/edges-{step}")
        dropped(spark, f"{base}/edges-{step - 1}", f"{base}/near-{step}", f"{base}/choice-{step}", f"{base}/labels-{step - 1}")
    dropped(spark, f"{base}/edges-{step}")
    return labels

"""A training corpus from ``documents``: five stages, each written as Parquet and read again by the next.

1. language: documents without a recognised language go.
2. near_duplicates: of each component of near copies the document of the smallest id stays.
3. decontaminate: documents that hold a passage of a benchmark item go.
4. secrets: every secret is replaced by a mark; n_chars follows the text.
5. pack: what is left becomes pieces of sequences of at most 1024 tokens.

Null, empty and repeated rows: a null or empty text has no language and goes in stage 1.
Rows that share an id, or have none, stay or go together; of rows that share id and text
one stays. An empty table passes through as an empty table. Other columns are dropped.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm import decontam, langid, minhash, packing, secrets
from foliant.llm.common import shared_folder, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Posterior below which a text has no recognised language.
LEAST_SCORE = 0.4


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a recognised language; learned from those that have a language label. Without any label, those with a letter."""
    model = langid.train(docs)
    if not model[0]:
        return docs.filter(F.col("text").rlike(r"\p{L}")).select(*COLUMNS)
    scored = langid.predict(docs.select(*COLUMNS), *model)
    return scored.filter((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies, that of the smallest id."""
    kept = minhash.near_duplicates(docs, words=5, percent=80).filter("kept").select(F.col("doc_id").alias("id")).distinct()
    return docs.select(*COLUMNS).join(kept, F.col("doc_id").eqNullSafe(F.col("id")), "left_semi").dropDuplicates(["doc_id", "text"])


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark item."""
    found = decontam.leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(F.col("doc_id").alias("id")).distinct()
    return docs.select(*COLUMNS).join(found, F.col("doc_id").eqNullSafe(F.col("id")), "left_anti")


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in the place of each secret."""
    found = secrets.find(docs, secrets.train(docs), keep=["text", "lang", "source", "n_chars"])
    clean = found.withColumn("clean", secrets.masked(F.col("text"), F.col("found")))
    return clean.select("doc_id", F.col("clean").alias("text"), "lang", "source", F.when(F.size("found") > 0, F.length("clean")).otherwise(F.col("n_chars")).cast("long").alias("n_chars"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), window=1024, end_id=0, with_ids=False)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("secrets", mask_secrets),
    ("pack", pack),
]
#: No stage but the masking can be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every stage's table lies in the cluster's shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"{shared_folder(spark)}-{name}")
    return docs


QUERIES = {"pipeline": run}
ORACLES = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}

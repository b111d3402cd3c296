"""Registered queries of the operators in this folder, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm import chat, decontam, html_text, importance, langid, licences, merkle, minhash, mtree, packing, quality, queries_sql, secrets, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to a content-addressed archive and read back."""
    folder = warc.write(table(spark, sf_dir, "pages"))
    back = warc.read(spark, folder)
    return back.select("page_id", F.length("payload").cast("long").alias("payload_bytes"), "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"), "verified")


def op2_mtree_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best scores of every vector whose id is divisible by 50 among all others."""
    return mtree.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256)


#: The conversation that holds control strings of a common template.
ADDED_TURNS = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and the added one, folded, rendered and read back."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.createDataFrame(ADDED_TURNS, "conv_id long, turn long, role string, text string")
    return chat.digests(chat.format_log(chat.from_rows(rows.unionByName(added))))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from the three quarters that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.filter(~langid.held_out(F.col("doc_id"))))
    return langid.predict(docs.select("doc_id", "text"), *model).select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's component of links between 4-word shingle sets of similarity 0.8 or more."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), words=4, percent=80)


def op6_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a passage of a benchmark item, with the item and the passage."""
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html_text.extract(table(spark, sf_dir, "pages"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' tokens in sequences of at most 1024."""
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), window=1024, end_id=0, with_ids=False)


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: base patterns and random-looking tokens."""
    docs = table(spark, sf_dir, "documents")
    return secrets.report(secrets.find(docs, secrets.train(docs)))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and template spans of every document."""
    return licences.scan(table(spark, sf_dir, "documents"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of all documents, drawn towards the features of the benchmark."""
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every document, learned from trusted positives and unlabelled texts that aren't held out."""
    return quality.assess(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place in the dataset's Merkle tree, with its proof folded anew."""
    return merkle.manifest(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc_archive": op1_warc_archive,
    "op2_mtree_top_k": op2_mtree_top_k,
    "op3_chat_format": op3_chat_format,
    "op4_language_id": op4_language_id,
    "op5_minhash_near_dedup": op5_minhash_near_dedup,
    "op6_benchmark_leaks": op6_benchmark_leaks,
    "op7_html_text": op7_html_text,
    "op8_packing": op8_packing,
    "op9_secret_scan": op9_secret_scan,
    "op10_license_scan": op10_license_scan,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_quality_scores": op12_quality_scores,
    "op13_merkle_manifest": op13_merkle_manifest,
}
ORACLES: dict[str, str] = {
    "op1_warc_archive": f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages), f AS (SELECT html, CASE WHEN octet_length(encode(html)) >= {warc.LEAST_SHARED} THEN max(page_id) END AS first FROM p GROUP BY html)
SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest, CASE WHEN page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to, true AS verified FROM p JOIN f USING (html)""",
    "op2_mtree_top_k": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings),
s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5""",
    "op3_chat_format": queries_sql.OP3,
    "op5_minhash_near_dedup": queries_sql.OP5,
    "op11_importance_resampling": queries_sql.OP11,
    "op13_merkle_manifest": queries_sql.OP13,
}

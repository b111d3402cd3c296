"""Engine tables derived from the test tables, in Spark and as SQL fragments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.operators.ingest import fixed_chunks
from foliant.operators.lexical import with_tokens
from foliant.plans.sizing import widen
from foliant.session import stored


TEXT_KEYS = {"documents": "doc_id", "conversations": "conv_id", "pages": "page_id"}


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{d}/{name}.parquet")
    # text work costs far more than its bytes, and the test texts are one file with one row group
    return widen(df, TEXT_KEYS[name]) if name in TEXT_KEYS else df


def sources(spark: SparkSession, d: str) -> DataFrame:
    """Documents as sources; copies of one text count once (lowest id)."""
    docs = table(spark, d, "documents").withColumn("sha256", F.sha2(F.encode("text", "UTF-8"), 256))
    # only hashes and ids are grouped; copies combine before the shuffle
    hashes = docs.select("doc_id", "sha256")
    first = hashes.groupBy("sha256").agg(F.min("doc_id").alias("doc_id")).select("doc_id")
    name = F.concat("source", F.lit("-"), F.col("doc_id").cast("string"))
    return docs.join(first, "doc_id", "left_semi").select(
        name.alias("name"), F.concat(name, F.lit(".txt")).alias("path"), "sha256", F.col("text").alias("content"),
        F.col("source").alias("corpus"), "doc_id")


def chunks(spark: SparkSession, d: str) -> DataFrame:
    return fixed_chunks(sources(spark, d))


def stored_chunks(spark: SparkSession, d: str) -> DataFrame:
    """The chunk table as ingestion leaves it for retrieval: written once, with its tokens."""
    return stored(with_tokens(chunks(spark, d)))


def benchmark_queries(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


# -- SQL fragments ---------------------------------------------------------------------------

def lit(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def arr(values) -> str:
    return "[" + ", ".join(lit(v) for v in values) + "]"


def sq(x: str) -> str:
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def search_norm(x: str) -> str:
    return sq(rf"regexp_replace(lower(replace(replace({x}, '?', ''''), '<channel|>', ' ')), '[^a-z0-9\s'']', ' ', 'g')")


def canonical(t: str) -> str:
    return f"regexp_replace(trim(lower({t}), ''''), '''s$', '')"


def search_tokens(norm: str) -> str:
    from foliant.functions.lists import SEARCH_STOPWORDS
    return (f"list_filter(list_transform(string_split({norm}, ' '), lambda t: {canonical('t')}), "
            f"lambda t: length(t) > 1 and not list_contains({arr(SEARCH_STOPWORDS)}, t))")


def question_norm(x: str) -> str:
    return sq(rf"regexp_replace(lower({x}), '[^a-z0-9\s]', '', 'g')")


def support_terms(x: str) -> str:
    from foliant.functions.lists import SUPPORT_STOPWORDS
    return (f"list_distinct(list_filter(string_split({question_norm(x)}, ' '), "
            f"lambda t: length(t) > 1 and not list_contains({arr(SUPPORT_STOPWORDS)}, t)))")


def sentences(x: str, least: int = 1) -> str:
    marked = rf"regexp_replace(regexp_replace({x}, '([.!?])\s+', '\1' || chr(1), 'g'), ';\s+', chr(1), 'g')"
    return (f"list_filter(list_transform(string_split({marked}, chr(1)), lambda s: {sq('s')}), "
            f"lambda s: length(s) >= {least})")


def corpus_clean(x: str) -> str:
    framed = (rf"regexp_replace(regexp_replace({x}, '(?is)^.*?\*\*\*\s*START OF (?:THE|THIS) PROJECT GUTENBERG EBOOK.*?\*\*\*', ''), "
              rf"'(?is)\*\*\*\s*END OF (?:THE|THIS) PROJECT GUTENBERG EBOOK.*?\*\*\*.*$', '')")
    lines = rf"regexp_replace({framed}, '\r\n?', chr(10), 'g')"
    return strip(rf"regexp_replace(regexp_replace({lines}, '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')")


SOURCES = """
src AS (
  SELECT sha256, d.source || '-' || d.doc_id AS name, d.source || '-' || d.doc_id || '.txt' AS path,
         d.text AS content, d.source AS corpus, d.doc_id AS doc_id
  FROM (SELECT sha256(text) AS sha256, arg_min({doc_id: doc_id, source: source, text: text}, doc_id) AS d
        FROM documents GROUP BY 1))"""

CHUNKS = SOURCES + f""",
cleaned AS (SELECT *, {corpus_clean('content')} AS body FROM src),
pieces AS (
  SELECT name, path, sha256, corpus, CAST(i AS INTEGER) AS chunk_index, {strip('substr(body, i * 880 + 1, 1100)')} AS content
  FROM (SELECT *, unnest(range(0, CAST(ceil(length(body) / 880.0) AS BIGINT))) AS i FROM cleaned WHERE length(body) > 0)),
chunks AS (
  SELECT substr(sha256, 1, 12) || '-' || printf('%04d', chunk_index) AS chunk_id, name AS source_name,
         path AS source_path, sha256 AS source_sha256, corpus, chunk_index, content
  FROM pieces WHERE length(content) >= 40)"""

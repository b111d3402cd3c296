"""Reading and writing corpora, page rows, interaction logs and session events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import preview

PAGE_SCHEMA = "source string, page int, section string, text string, visual_text string, has_visual_description boolean"
INTERACTION_SCHEMA = (
    "event_type string, timestamp timestamp, session_id string, dataset_id string, "
    "source_file_names array<string>, user_question string, generated_question string, model_answer string, "
    "user_answer string, score int, feedback string, evidence_ids array<string>, question_id string, "
    "source_chunk_ids array<string>, security_stage string, security_blocked boolean, "
    "security_categories array<string>, security_reasons array<string>, text_preview string")


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """One row per ``*.txt`` file (not recursive); bytes that are not UTF-8 are dropped."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[tT][xX][tT]").load(path)
    # a genuine replacement mark is kept: it is hidden before bad bytes turn into one
    mark, spare = "�", "\U0010fffe"
    hidden = F.replace(F.col("content").cast("string"), F.lit(mark), F.lit(spare))
    decoded = F.replace(F.replace(F.make_valid_utf8(hidden), F.lit(mark)), F.lit(spare), F.lit(mark))
    return with_profile(files.select(
        F.element_at(F.split("path", "/"), -1).alias("name"),
        F.col("path"),
        decoded.alias("content"),
        F.col("length").alias("size_bytes"),
        F.col("modificationTime").alias("modified_at"),
    ))


def with_profile(sources: DataFrame) -> DataFrame:
    """Content hash, and size and time where the source has none."""
    out = sources.withColumn("sha256", F.sha2(F.encode("content", "UTF-8"), 256))
    if "size_bytes" not in out.columns:
        out = out.withColumn("size_bytes", F.octet_length("content").cast("long"))
    if "modified_at" not in out.columns:
        out = out.withColumn("modified_at", F.lit(None).cast("timestamp"))
    return out.select("name", "path", "content", "sha256", "size_bytes", "modified_at")


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PAGE_SCHEMA).json(path)


def write_pages(pages: DataFrame, path: str, mode: str = "overwrite") -> None:
    pages.select(*[f.strip().split(" ")[0] for f in PAGE_SCHEMA.split(",")]).write.mode(mode).json(path)


def page_text_rows(pages: DataFrame) -> DataFrame:
    """One text block per page; the first block of a source carries the document header.

    Blocks stay separate rows, so a source of any size is written by many tasks.
    Concatenated in page order they are the document's plain-text form.
    """
    first = pages.groupBy("source").agg(F.min("page").alias("_first"))
    block = F.concat(F.lit("--- Page "), F.col("page").cast("string"), F.lit(" ---\n"), F.col("text"))
    header = F.concat(F.lit("Document: "), F.col("source"), F.lit("\n" + "=" * 60 + "\n\n"))
    return pages.join(first, "source").select(
        "source", "page", F.when(F.col("page") == F.col("_first"), F.concat(header, block)).otherwise(block).alias("block"))


def write_page_text(pages: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Plain-text files per source, in page order within and across part files."""
    (page_text_rows(pages)
     .repartitionByRange("source", "page").sortWithinPartitions("source", "page")
     .select("source", F.concat("block", F.lit("\n")).alias("block"))
     .write.mode(mode).partitionBy("source").text(path))


def interaction_rows(*parts: DataFrame) -> DataFrame:
    """Union of event rows under the one wide nullable schema."""
    names = [(c.strip().split(" ")[0], c.strip().split(" ")[1]) for c in INTERACTION_SCHEMA.split(",")]
    shaped = [
        part.select(*[(F.col(n) if n in part.columns else F.lit(None)).cast(t).alias(n) for n, t in names])
        for part in parts
    ]
    out = shaped[0]
    for part in shaped[1:]:
        out = out.unionByName(part)
    return out


def asked_rows(answers: DataFrame, queries: DataFrame, at: Column) -> DataFrame:
    """``user_question`` rows of answered queries. ``queries``: query_id, query, session_id, dataset_id."""
    rows = queries.join(answers.select("query_id", "answer", "evidence_ids", "source_names"), "query_id")
    return rows.select(F.lit("user_question").alias("event_type"), at.alias("timestamp"), "session_id", "dataset_id", F.col("source_names").alias("source_file_names"),
                       F.col("query").alias("user_question"), F.col("answer").alias("model_answer"), "evidence_ids")


def made_rows(questions: DataFrame) -> DataFrame:
    """``generated_question`` rows. ``questions``: question_id, session_id, dataset_id, question, model_answer, source_names, source_chunk_ids, created_at."""
    return questions.select(F.lit("generated_question").alias("event_type"), F.col("created_at").alias("timestamp"), "session_id", "dataset_id",
                            F.col("source_names").alias("source_file_names"), F.col("question").alias("generated_question"), "model_answer", "question_id", "source_chunk_ids")


def graded_rows(grades: DataFrame, attempts: DataFrame, questions: DataFrame, at: Column) -> DataFrame:
    """``graded_answer`` rows. ``attempts``: attempt_id, question_id, session_id, user_answer; ``grades``: attempt_id, score, feedback."""
    told = questions.select("question_id", "dataset_id", F.col("source_names").alias("source_file_names"), F.col("question").alias("generated_question"), "model_answer", "source_chunk_ids")
    rows = attempts.select("attempt_id", "question_id", "session_id", "user_answer").join(grades.select("attempt_id", "score", "feedback"), "attempt_id").join(told, "question_id")
    return rows.withColumns({"event_type": F.lit("graded_answer"), "timestamp": at}).drop("attempt_id")


def security_rows(decisions: DataFrame, stage: str, at: Column, text: str, decision: str = "decision") -> DataFrame:
    """``security_event`` rows of the blocked texts. ``decisions``: session_id, dataset_id, the text and its policy decision."""
    d = F.col(decision)
    rows = decisions.filter(d["blocked"])
    names = F.col("source_file_names") if "source_file_names" in decisions.columns else F.array().cast("array<string>")
    return rows.select(F.lit("security_event").alias("event_type"), at.alias("timestamp"), "session_id", "dataset_id", names.alias("source_file_names"),
                       F.lit(stage).alias("security_stage"), d["blocked"].alias("security_blocked"), d["categories"].alias("security_categories"),
                       F.transform(d["findings"], lambda x: x["reason"]).alias("security_reasons"), preview(text).alias("text_preview"))


def append_interactions(rows: DataFrame, path: str) -> None:
    interaction_rows(rows).write.mode("append").partitionBy("event_type").parquet(path)


def session_events(df: DataFrame, session: Column, event_type: Column, created_at: Column, **payload: Column) -> DataFrame:
    """Session events with their payload as JSON text."""
    body = F.to_json(F.struct(*[value.alias(name) for name, value in payload.items()]))
    return df.select(session.alias("session_id"), event_type.alias("event_type"), body.alias("payload"),
                     created_at.alias("created_at"))

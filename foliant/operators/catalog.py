"""Relational queries over sessions, corpora, documents, questions and attempts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIBRARY_TITLE = "Document Library"
LIBRARY_PREFIX = "__document_library__:"


def corpora_of_document(corpora: DataFrame, bridge: DataFrame, document_ids: DataFrame) -> DataFrame:
    """Corpora that hold any of the documents."""
    hit = bridge.join(document_ids, "document_id", "left_semi").select("corpus_id").distinct()
    return corpora.join(hit, "corpus_id", "left_semi")


def by_ids(table: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return table.join(ids.select(key), key, "left_semi")


def with_active_label(sessions: DataFrame, corpora: DataFrame) -> DataFrame:
    labels = corpora.select(F.col("corpus_id").alias("active_corpus_id"), F.col("dataset_label").alias("active_corpus_label"))
    return sessions.join(labels, "active_corpus_id", "left")


def with_active_flag(documents: DataFrame, active: DataFrame) -> DataFrame:
    """``is_active``: whether the document is in the active corpus."""
    marks = active.select("document_id").distinct().withColumn("_in", F.lit(True))
    return documents.join(marks, "document_id", "left").withColumn("is_active", F.col("_in").isNotNull()).drop("_in")


def requests_complete(requested: DataFrame, documents: DataFrame, request: str = "request_id") -> DataFrame:
    """Per request: whether every distinct id asked for exists."""
    ids = requested.select(request, "document_id").distinct()
    known = documents.select("document_id").distinct().withColumn("_k", F.lit(1))
    return ids.join(known, "document_id", "left").groupBy(request).agg(
        F.count("*").alias("asked"), F.count("_k").alias("matched")).withColumn("complete", F.col("asked") == F.col("matched"))


def delete_documents(tables: dict[str, DataFrame], document_ids: DataFrame) -> dict[str, DataFrame]:
    """Surviving rows of every table once the documents are gone, with active corpora reset."""
    out = dict(tables)
    corpora = tables["corpus_documents"].join(document_ids, "document_id", "left_semi").select("corpus_id").distinct()
    questions = tables["questions"].join(corpora, "corpus_id", "left_semi").select("question_id")
    out["attempts"] = tables["attempts"].join(questions, "question_id", "left_anti")
    for name in ("questions", "corpus_documents", "corpora"):
        out[name] = tables[name].join(corpora, "corpus_id", "left_anti")
    out["documents"] = tables["documents"].join(document_ids, "document_id", "left_anti")
    out["sessions"] = reset_references(tables["sessions"], corpora, "active_corpus_id", "corpus_id")
    return out


def delete_sessions(tables: dict[str, DataFrame], session_ids: DataFrame) -> dict[str, DataFrame]:
    """Surviving rows of every table that belongs to a session."""
    out = {name: t.join(session_ids, "session_id", "left_anti") for name, t in tables.items() if "session_id" in t.columns}
    gone = tables["corpora"].join(session_ids, "session_id", "left_semi").select("corpus_id")
    out["corpus_documents"] = tables["corpus_documents"].join(gone, "corpus_id", "left_anti")
    return out


def reset_references(table: DataFrame, gone: DataFrame, column: str, key: str) -> DataFrame:
    """Null ``column`` where it points at a removed row."""
    marks = gone.select(F.col(key).alias(column)).distinct().withColumn("_gone", F.lit(True))
    return table.join(marks, column, "left").withColumn(column, F.when(F.col("_gone").isNull(), F.col(column))).select(*table.columns)


def missing_libraries(users: DataFrame, sessions: DataFrame) -> DataFrame:
    """One library row for every owner that has none."""
    have = sessions.filter("is_library").select("user_id").distinct()
    return users.select("user_id").distinct().join(have, "user_id", "left_anti").select(
        F.concat(F.lit(LIBRARY_PREFIX), F.col("user_id").cast("string")).alias("session_id"), "user_id",
        F.lit(LIBRARY_TITLE).alias("title"), F.lit(True).alias("is_library"))


def recent_sessions(sessions: DataFrame, limit: int = 20) -> DataFrame:
    return sessions.orderBy(F.desc("updated_at"), F.desc("created_at"), "session_id").limit(limit)


def selection_totals(documents: DataFrame) -> DataFrame:
    return documents.agg(F.count_if("ready").alias("ready_count"), F.sum(F.coalesce("chunk_count", F.lit(0))).alias("chunk_total"),
                         F.sum(F.coalesce("size_bytes", F.lit(0))).alias("byte_total"))


def latest_attempts(attempts: DataFrame, key: str = "question_id", order: str = "created_at", tie: str = "attempt_id") -> DataFrame:
    """Newest attempt of each question; combines before the shuffle."""
    body = [c for c in attempts.columns if c != key]
    best = attempts.groupBy(key).agg(F.max_by(F.struct(*body), F.struct(order, tie)).alias("_row"))
    return best.select(key, *[F.col("_row")[c].alias(c) for c in body])


def corpus_details(corpora: DataFrame, bridge: DataFrame) -> DataFrame:
    """Corpus rows with their documents, one row per document; a corpus without any has null."""
    return corpora.join(bridge.select("corpus_id", "document_id"), "corpus_id", "left")


def same_paths(active: DataFrame, target: DataFrame, key: str = "corpus_id") -> DataFrame:
    """Per corpus: whether both sides name the same set of paths (compared row by row)."""
    a = active.select(key, "path").distinct().withColumn("_s", F.lit(1))
    b = target.select(key, "path").distinct().withColumn("_s", F.lit(-1))
    net = a.unionByName(b).groupBy(key, "path").agg(F.sum("_s").alias("_n"))
    return net.groupBy(key).agg(F.min(F.col("_n") == 0).alias("same"))


def unexpired(tokens: DataFrame, as_of: Column) -> DataFrame:
    return tokens.filter(F.col("expires_at") > as_of)


def throughput(events: DataFrame, session: str = "session_id") -> DataFrame:
    """Tokens, reasoning tokens, elapsed seconds and tokens per second of each session."""
    out = events.groupBy(session).agg(
        F.count_if(F.col("kind") == "token").alias("tokens"), F.count_if(F.col("kind") == "reasoning").alias("reasoning_tokens"),
        F.greatest(F.lit(0.001), (F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))) / 1e6).alias("elapsed_seconds"))
    return out.withColumn("elapsed_seconds", F.round("elapsed_seconds", 3)).withColumn(
        "tokens_per_second", F.round(F.col("tokens") / F.col("elapsed_seconds"), 6))

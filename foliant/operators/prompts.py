"""Prompt tables: the input of a generation step, one row per prompt.

Each has an id and ``system`` and ``prompt`` texts; ``answer.generate`` runs a plugged-in model
over such a table. Models read the wording, nothing here depends on it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lists
from .answer import wants_reason

QUESTION_RULES = " ".join([
    "Write one concrete question about the passage that a reader of the passage can answer.",
    "Ask for a single fact, or for one thing that somebody said or did, and name whom or what the question is about.",
    "Don't ask for opinions, themes, interpretations or a yes or no, and don't begin with a pronoun that nothing explains.",
    "Ask nothing that was asked before.",
    'Return JSON alone: {"question": "...", "model_answer": "..."}; the answer is short and stands in the passage.'])
GRADING_RULES = " ".join([
    "Grade the student's answer by the context first and by the reference answer second.",
    "Other words for the same thing are right, and more than was asked costs little unless it contradicts the text.",
    "If the question is about something said, its meaning counts, not the exact words."])
RETRY_RULES = " ".join([
    "Answer every part of the question from the excerpts alone, in plain text without JSON, lists or headings.",
    "If they don't support an answer, reply exactly NOT_AVAILABLE."])


def _lines(*parts: Column | str) -> Column:
    return F.concat_ws("\n\n", *[F.lit(p) if isinstance(p, str) else p for p in parts])


def question_prompts(chunks: DataFrame, recent: DataFrame, corpus: str = "dataset_id") -> DataFrame:
    """A prompt for each chunk: query_id (its chunk_id), system, prompt.

    ``recent``: corpus, question, age, the latest questions of each corpus (see
    ``questions.recent_questions``), which the new one mustn't repeat.
    """
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("age", "question"))), lambda x: F.concat(F.lit("- "), x["question"]))
    asked = recent.groupBy(corpus).agg(F.array_join(ordered, "\n").alias("asked"))
    place = F.concat(F.lit("[chunk_id="), F.col("chunk_id"), F.lit(" | source="), F.col("source_name"), F.lit("]\n"), F.col("content"))
    return chunks.join(asked, corpus, "left").select(F.col("chunk_id").alias("query_id"), F.lit(QUESTION_RULES).alias("system"), _lines(
        F.concat(F.lit("Asked before:\n"), F.coalesce("asked", F.lit("- none"))), F.concat(F.lit("Passage:\n"), place)).alias("prompt"))


def grading_prompts(attempts: DataFrame, contexts: DataFrame) -> DataFrame:
    """A prompt for each attempt: query_id (its attempt_id), system with the rubric, prompt. Attempts without a context get an empty one."""
    rubric = "; ".join(f"{score} = {said}" for score, said in sorted(lists.RUBRIC.items(), reverse=True))
    system = f"{GRADING_RULES} Scores: {rubric}. " + 'Return JSON alone: {"score": 0, "feedback": "...", "model_answer": "..."}.'
    named = lambda name, column: F.concat(F.lit(f"{name}: "), column)
    rows = attempts.join(contexts, "attempt_id", "left")
    return rows.select(F.col("attempt_id").alias("query_id"), F.lit(system).alias("system"), _lines(
        named("Question", F.col("question")), F.concat(F.lit("Context:\n"), F.coalesce("context", F.lit(""))), named("Reference answer", F.col("model_answer")),
        named("Student's answer", F.coalesce("user_answer", F.lit("")))).alias("prompt"))


def retry_prompts(queries: DataFrame, contexts: DataFrame, parsed: DataFrame) -> DataFrame:
    """A plain-text prompt for each query whose response could not be read as JSON: query_id, system, prompt.

    ``parsed``: query_id and parse_path, as ``answer.parse_responses`` has them (``plain`` where no JSON was found).
    """
    form = F.when(wants_reason("query"), F.lit("Answer in two lines:\nReason: ...\nConsequence: ...")).otherwise(F.lit("Answer in one or two sentences."))
    failed = parsed.filter(F.col("parse_path") == "plain").select("query_id")
    rows = queries.join(failed, "query_id", "left_semi").join(contexts, "query_id", "left")
    return rows.select("query_id", F.lit(RETRY_RULES).alias("system"), _lines(
        F.concat(F.lit("Question: "), F.col("query")), F.concat(F.lit("Excerpts:\n"), F.coalesce("context", F.lit(""))), form).alias("prompt"))

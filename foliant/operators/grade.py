"""Grading of answers against a reference and its evidence."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from ..functions import lists
from ..functions import text as T
from ..plans.sizing import spread
from ..session import cut, stored
from .lexical import ChunkIndex
from .retrieve import build_context, excerpt_block, joined_blocks, neighbors, retrieve
from .vectors import embed

#: The lowest ratios that any grading rule looks at: of an answer to its reference, and to evidence.
LEAST_RATIO, LEAST_EVIDENCE_RATIO = 0.5, 0.82


def _ratios(lefts: pd.Series, rights: pd.Series) -> pd.Series:
    """Matching-block ratio of each pair of texts, the first of a row being answer and reference.

    A pair that can't reach the lowest ratio that counts for it, by its lengths or by the
    characters that both texts have, scores 0 without being matched.
    """
    def one(a: str, b: str, least: float) -> float:
        if not a or not b or 2 * min(len(a), len(b)) < least * (len(a) + len(b)):
            return 0.0
        if a == b:
            return 1.0
        match = SequenceMatcher(None, a, b)
        return match.ratio() if match.quick_ratio() >= least else 0.0

    def of_row(x, y) -> list[float]:
        return [one(a, b, LEAST_EVIDENCE_RATIO if k else LEAST_RATIO) for k, (a, b) in enumerate(zip(x, y, strict=True))]

    return pd.Series([of_row(x, y) for x, y in zip(lefts, rights, strict=True)])


sequence_ratios = F.pandas_udf(_ratios, ArrayType(DoubleType()))


# -- measures ----------------------------------------------------------------------------

def support_measures(user: Column, reference: Column, context: Column) -> Column:
    """precision, recall, context_support, reference_coverage, extra_support, unsupported of term sets."""
    size = lambda c: F.size(c).cast("double")
    share = lambda part, whole: size(part) / F.greatest(size(whole), F.lit(1.0))
    both = F.array_intersect(user, reference)
    extra = F.array_except(user, reference)
    none = F.size(user) == 0
    return F.struct(
        share(both, user).alias("precision"), share(both, reference).alias("recall"),
        share(F.array_intersect(user, F.array_union(context, reference)), user).alias("context_support"),
        F.when(none, 0.0).otherwise(share(both, reference)).alias("reference_coverage"),
        F.when(none, 0.0).when(F.size(extra) == 0, 1.0).otherwise(share(F.array_intersect(extra, context), extra)).alias("extra_support"),
        F.when(none, 1.0).when(F.size(extra) == 0, 0.0).otherwise(share(F.array_except(extra, context), user)).alias("unsupported"))


def obvious_match(user_norm, reference_norm, user_terms, reference_terms, ratio) -> Column:
    """10 or 9 for an unmistakable match, else null."""
    both = T.overlap(user_terms, reference_terms).cast("double")
    precision, recall = both / F.size(user_terms), both / F.size(reference_terms)
    return (F.when((user_norm == "") | (reference_norm == ""), F.lit(None))
            .when(user_norm == reference_norm, 10)
            .when((F.size(user_terms) == 0) | (F.size(reference_terms) == 0), F.lit(None))
            .when((ratio >= 0.93) & (precision >= 0.93) & (recall >= 0.9), 10)
            .when((ratio >= 0.82) & (precision >= 0.82) & (recall >= 0.78), 9))


def is_dialogue(question, reference) -> Column:
    n = T.strip(F.lower(T.col(question)))
    asks = n.startswith("what did ") | (n.startswith("how did ") & n.contains("respond after hearing"))
    return (T.quoted_content(reference) != "") & asks


def is_manner_only(answer, terms) -> Column:
    rest = F.array_except(T.col(terms), T.words(["he", "she", "they", "speaker"]))
    return ~T.col(answer).rlike("""["'?]""") & (F.size(rest) > 0) & (F.size(F.array_except(rest, T.words(lists.MANNER_TERMS))) == 0)


def context_sentences(context) -> Column:
    """Distinct sentences of 20 characters or more; excerpt headers left out."""
    lines = F.filter(F.transform(F.split(T.col(context), "\r\n|\r|\n", -1), T.strip), lambda s: (s != "") & ~s.startswith("[Excerpt "))
    return F.array_distinct(T.sentences(F.array_join(lines, " "), 20))


def best_evidence(question_terms, reference_terms, sentences, limit: int = 3) -> Column:
    """Of sentences (array of sentence and terms) those sharing most with question and reference, best first, ties by text descending."""
    scored = lambda s: F.struct(F.round(T.overlap(question_terms, s["terms"]) * 1.35 + T.overlap(reference_terms, s["terms"]) * 1.1, 6).alias("score"), s["sentence"].alias("sentence"))
    ranked = F.reverse(F.array_sort(F.filter(F.transform(T.col(sentences), scored), lambda r: r["score"] > 0)))
    return F.transform(F.slice(ranked, 1, limit), lambda r: r["sentence"])


# -- floors ---------------------------------------------------------------------------------

def heuristic_floor(m, ratio, similarity) -> Column:
    p, r, c = m["precision"], m["recall"], m["context_support"]
    return (F.when((r >= 0.95) & (p >= 0.84) & (c >= 0.72), F.when((ratio >= 0.9) | (similarity >= 0.96), 10).otherwise(9))
            .when((similarity >= 0.95) & (r >= 0.72) & (p >= 0.5) & (c >= 0.5), 9)
            .when((r >= 0.72) & (p >= 0.55) & (c >= 0.68), 8)
            .when((similarity >= 0.9) & (r >= 0.58) & (p >= 0.42) & (c >= 0.45), 8)
            .when((similarity >= 0.84) & (r >= 0.48) & (p >= 0.32) & (c >= 0.35), 7)
            .when((r >= 0.55) & (c >= 0.4), 6).when((r >= 0.4) & (c >= 0.3), 5).otherwise(0))


def semantic_floor(m, ratio, similarity, evidence_similarity) -> Column:
    p, r, c = m["precision"], m["recall"], m["context_support"]
    s = F.greatest(similarity, evidence_similarity)
    return (F.when((s >= 0.96) & (c >= 0.58), F.when((r >= 0.5) | (ratio >= 0.78), 10).otherwise(9))
            .when((s >= 0.96) & (r >= 0.45), F.when(c >= 0.3, 8).otherwise(7))
            .when((s >= 0.92) & (c >= 0.5), 9)
            .when((s >= 0.88) & (c >= 0.42), F.when((r >= 0.24) | (p >= 0.2) | (ratio >= 0.5), 8).otherwise(7))
            .when((s >= 0.82) & (c >= 0.35), 7).when((s >= 0.76) & (c >= 0.3), 6).when((s >= 0.68) & (c >= 0.24), 5).otherwise(0))


def equivalence_floor(m, quote_recall, similarity, evidence_similarity, reference_similarity, e_ratio, e_precision, e_quote) -> Column:
    """Supported answers in other words. ``quote_recall`` is 0 outside dialogue questions."""
    c, cover, extra, loose = m["context_support"], m["reference_coverage"], m["extra_support"], m["unsupported"]
    near = ((evidence_similarity <= 0.05) & (reference_similarity <= 0.05)) | (
        evidence_similarity >= F.greatest(F.lit(0.62), reference_similarity - 0.1))
    strong = (c >= 0.78) & (extra >= 0.82) & (loose <= 0.08) & near
    fair = (c >= 0.7) & (extra >= 0.75) & (loose <= 0.12) & near
    return (F.when((cover >= 0.92) & strong, 10).when((quote_recall >= 0.9) & strong, 10)
            .when((e_quote >= 0.96) & (c >= 0.58) & (loose <= 0.08), 10)
            .when((e_ratio >= 0.94) & (e_precision >= 0.72) & (c >= 0.62) & (loose <= 0.08), 10)
            .when((cover >= 0.72) & fair, F.when((similarity >= 0.5) | (evidence_similarity >= 0.82), 10).otherwise(9))
            .when((quote_recall >= 0.68) & fair, F.when((evidence_similarity >= 0.7) | (similarity >= 0.45), 10).otherwise(9))
            .when((e_ratio >= 0.88) & (e_precision >= 0.6) & (c >= 0.54) & (loose <= 0.12), 9)
            .when((cover >= 0.48) & fair, 9).otherwise(0))


def dialogue_floor(usable, manner_only, quote_recall, m, similarity, evidence_similarity) -> Column:
    """For questions about what was said; null elsewhere."""
    c, r = m["context_support"], m["recall"]
    s = F.greatest(similarity, evidence_similarity)
    return (F.when(~usable, F.lit(None)).when(manner_only & (quote_recall < 0.25), 2)
            .when((quote_recall >= 0.92) & (c >= 0.42), F.when(s >= 0.88, 10).otherwise(9))
            .when((s >= 0.96) & (quote_recall >= 0.25), 8).when((quote_recall >= 0.68) & (s >= 0.72), 8)
            .when((s >= 0.9) & (c >= 0.5), 8).when((quote_recall >= 0.4) & (c >= 0.32), 6)
            .when((s >= 0.72) & ((r >= 0.18) | (c >= 0.3)), 5).when((quote_recall > 0) | (c >= 0.22), 3).otherwise(0))


def similarity_score(similarity) -> Column:
    s = T.col(similarity)
    bands = [(0.97, 10), (0.93, 9), (0.89, 8), (0.84, 7), (0.76, 6), (0.68, 5), (0.59, 4), (0.50, 3), (0.40, 2)]
    out = None
    for least, score in bands:
        out = F.when(s >= least, score) if out is None else out.when(s >= least, score)
    return out.when(s > 0, 1).otherwise(0)


def blended_similarity(similarity, evidence_similarity, context_recall, term_recall) -> Column:
    return F.greatest(similarity, evidence_similarity, similarity * 0.55 + context_recall * 0.25 + term_recall * 0.2)


def rubric(score) -> Column:
    return F.element_at(F.from_json(F.lit("{" + ", ".join(f'"{k}": "{v}"' for k, v in lists.RUBRIC.items()) + "}"), "map<string,string>"),
                        T.col(score).cast("string"))


# -- the job ----------------------------------------------------------------------------------

def _whole_score(x) -> Column:
    """A model's score as a whole number: numbers lose their fraction, a missing one is 0, anything else is null."""
    number = T.strip(T.col(x).cast("string"))
    exact = F.when(number.rlike(r"^[+-]?\d+(\.\d*)?$"), F.regexp_extract(number, r"^([+-]?\d+)", 1).try_cast("int"))
    return F.when(T.col(x).isNull(), 0).otherwise(exact)


def grading_contexts(attempts: DataFrame, chunks: DataFrame | ChunkIndex, window: int = 2, **retrieval) -> DataFrame:
    """Context text per attempt: its question's chunks and their neighbors, or, without any of these, what its question retrieves.

    ``retrieval``: options of ``retrieve`` for the latter; with a ``dataset_id`` on both sides a question stays in its corpus.
    Attempts on the same chunks, and those that ask the same, share one context, which is built once.
    """
    table = chunks.chunks if isinstance(chunks, ChunkIndex) else chunks
    place = table.select("chunk_id", *[c for c in ("dataset_id",) if c in table.columns], "source_name", "chunk_index", "content")
    ids = F.coalesce("source_chunk_ids", F.array().cast("array<string>")) if "source_chunk_ids" in attempts.columns else F.array().cast("array<string>")
    rows = attempts.withColumn("_ids", ids).withColumn("_key", F.sha2(F.to_json("_ids"), 256))
    wanted = rows.filter(F.size("_ids") > 0).select("_key", "_ids").dropDuplicates(["_key"]).select(F.col("_key").alias("query_id"), F.posexplode("_ids").alias("seed_no", "chunk_id"))
    seeds = wanted.join(place.drop("content"), "chunk_id").drop("chunk_id")
    near = neighbors(seeds, place, ["query_id"], window)
    block = excerpt_block("place", "chunk_id", "source_name", "content")
    own = cut(joined_blocks(near, "place", block).withColumnRenamed("query_id", "_key"))
    placed = cut(rows.join(own, "_key", "left"))
    corpus = [c for c in ("dataset_id",) if c in rows.columns]
    open_ = placed.filter("context is null").withColumn("_key", F.sha2(F.to_json(F.struct(*corpus, "question")), 256))
    if not open_.isEmpty():
        asked = open_.select(F.col("_key").alias("query_id"), *corpus, F.col("question").alias("query")).dropDuplicates(["query_id"])
        found = retrieve(asked, chunks, **retrieval)
        found = build_context(found).withColumnRenamed("query_id", "_key")
        open_ = open_.drop("context").join(found, "_key", "left")
    return placed.filter("context is not null").select("attempt_id", "context").unionByName(open_.filter("context is not null").select("attempt_id", "context"))


def graded_items(attempts: DataFrame, contexts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(attempts with ``item``, items with their best evidence and context terms).

    An item is a question, a reference answer and a context; what depends on these alone is
    computed once for all attempts on it, and what depends on the context once for all items.
    """
    key = lambda *c: F.sha2(F.to_json(F.struct(*c)), 256)
    rows = attempts.join(contexts, "attempt_id", "left").withColumn("context", F.coalesce("context", F.lit("")))
    rows = rows.withColumn("_context", F.sha2("context", 256))
    rows = stored(rows.withColumn("item", key("question", "model_answer", "_context")))
    texts = rows.select("_context", "context").dropDuplicates(["_context"])
    sentence = lambda s: F.struct(s.alias("sentence"), T.content_terms(s).alias("terms"))
    texts = stored(spread(texts, "_context").select("_context", T.content_terms("context").alias("ct"), T.word_set(T.question_norm("context")).alias("cw"),
                                                   F.transform(context_sentences("context"), sentence).alias("sentences")))
    items = rows.select("item", "question", "model_answer", "_context").dropDuplicates(["item"])
    items = items.withColumn("rq", T.quoted_content("model_answer")).withColumn("rt", T.content_terms("model_answer")).withColumn("qt", T.content_terms("question"))
    items = items.withColumn("rqt", F.when(F.col("rq") != "", T.content_terms("rq")).otherwise(F.col("rt")))
    items = items.join(texts, "_context").withColumn("evidence", best_evidence(F.col("qt"), F.col("rqt"), F.col("sentences")))
    kept = ["item", "rt", "rqt", "ct", "cw", "evidence"]
    return rows.drop("context", "_context"), stored(items.select(*kept))


def answer_similarities(attempts: DataFrame, items: DataFrame, embed_fn=None) -> DataFrame:
    """attempt_id and the cosines of answer and reference, and the best ones of each with the item's evidence.

    Every distinct text is embedded once, known by its hash, and its vector joined in where the text stands.
    """
    texts = attempts.join(items.select("item", "evidence"), "item").select(
        "attempt_id", T.squeeze(F.coalesce("user_answer", F.lit(""))).alias("answer"), F.col("model_answer").alias("reference"), "evidence")
    texts = texts.filter("answer != ''")
    roles = F.concat(F.array(F.struct(F.lit("answer").alias("role"), F.col("answer").alias("text")), F.struct(F.lit("reference").alias("role"), F.col("reference").alias("text"))),
                     F.transform("evidence", lambda e: F.struct(F.lit("evidence").alias("role"), e.alias("text"))))
    said = cut(texts.select("attempt_id", F.explode(roles).alias("r")).select("attempt_id", "r.role", F.coalesce("r.text", F.lit("")).alias("text")).withColumn("hash", F.sha2("text", 256)))
    vectors = embed(said.select("hash", "text").dropDuplicates(["hash"]), "text", embed_fn)
    placed = said.select("attempt_id", "role", "hash").join(vectors, "hash")
    one = lambda role: placed.filter(F.col("role") == role).select("attempt_id", F.col("embedding").alias(role))
    rows = one("answer").join(one("reference"), "attempt_id").join(one("evidence"), "attempt_id", "left")
    best = lambda left: F.coalesce(F.max(T.cosine(left, "evidence")), F.lit(0.0))
    return rows.groupBy("attempt_id").agg(F.max(T.cosine("answer", "reference")).alias("similarity"), best("answer").alias("evidence_similarity"), best("reference").alias("reference_similarity"))


def grade(attempts: DataFrame, contexts: DataFrame, responses: DataFrame | None = None, embed_fn=None, embedded: bool = True) -> DataFrame:
    """attempt_id, score, feedback, floor, and the similarities that the floors saw.

    ``attempts``: attempt_id, question, model_answer, user_answer; with any of similarity,
    evidence_similarity and reference_similarity these are taken as they are (0 for the others). Otherwise they
    are computed by ``embed_fn`` (the offline embedding without one), or are 0 with ``embedded=False``.
    ``responses``: attempt_id, status fields score and feedback of a model, optional.
    """
    similar = ["similarity", "evidence_similarity", "reference_similarity"]
    attempts, items = graded_items(attempts, contexts)
    if embedded and not set(similar) & set(attempts.columns):
        attempts = attempts.join(answer_similarities(attempts, items, embed_fn), "attempt_id", "left")
    rows = attempts.join(items, "item")
    for name in similar:
        rows = rows.withColumn(name, F.coalesce(F.col(name), F.lit(0.0)) if name in attempts.columns else F.lit(0.0))
    rows = spread(rows, "attempt_id").withColumn("user", T.squeeze(F.coalesce("user_answer", F.lit(""))))
    rows = rows.withColumn("un", T.grading_norm("user")).withColumn("rn", T.grading_norm("model_answer")).withColumn("ut", T.content_terms("user"))
    rows = rows.withColumn("evidence", F.when(F.col("un") != "", F.col("evidence")).otherwise(F.array().cast("array<string>")))
    rows = rows.withColumn("en", F.transform("evidence", T.grading_norm)).withColumn("et", F.transform("evidence", lambda e: T.content_terms(e)))
    rows = rows.withColumn("eq", F.transform("evidence", T.quoted_content))
    rows = rows.withColumn("eqn", F.transform("eq", T.grading_norm)).withColumn("eqt", F.transform("eq", lambda e: T.content_terms(e)))
    rows = rows.withColumn("uqn", T.grading_norm(T.quoted_content("user")))
    # pairs to measure: user-reference, user-sentences, user-quotes, user quote-quotes
    lefts = F.concat(F.array("un"), F.transform("en", lambda e: F.col("un")), F.transform("eqn", lambda e: F.col("un")),
                     F.transform("eqn", lambda e: F.col("uqn")))
    rights = F.concat(F.array("rn"), F.col("en"), F.col("eqn"), F.col("eqn"))
    rows = rows.withColumn("ratios", sequence_ratios(lefts, rights)).withColumn("n", F.size("evidence"))
    part = lambda k: F.slice("ratios", F.lit(2) + F.col("n") * k, F.col("n"))
    top = lambda arr: F.coalesce(F.array_max(arr), F.lit(0.0))
    rows = rows.withColumn("m", support_measures(F.col("ut"), F.col("rt"), F.col("ct")))
    blank = (F.col("un") == "") | (F.col("rn") == "")
    zero = F.struct(*[F.lit(0.0).alias(c) for c in ("precision", "recall", "context_support")],
                    *[F.col("m")[c].alias(c) for c in ("reference_coverage", "extra_support", "unsupported")])
    rows = rows.withColumn("m", F.when(blank, zero).otherwise(F.col("m"))).withColumn("ratio", F.col("ratios")[0])
    rows = rows.withColumn("obvious", obvious_match(F.col("un"), F.col("rn"), F.col("ut"), F.col("rt"), F.col("ratio")))
    seen = lambda norms, terms, k: F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: obvious_match(
        F.col("un"), F.get(F.col(norms), i), F.col("ut"), F.get(F.col(terms), i), F.get(part(k), i)))
    rows = rows.withColumn("evident", F.when(F.col("n") > 0, F.greatest(
        F.array_max(seen("en", "et", 0)), F.array_max(seen("eqn", "eqt", 1)))))
    share = lambda t: F.when(F.size("ut") > 0, T.overlap("ut", t).cast("double") / F.size("ut")).otherwise(0.0)
    rows = rows.withColumn("e_ratio", top(part(0))).withColumn("e_precision", top(F.transform("et", share))).withColumn("e_quote", top(part(2)))
    quote_share = F.when((F.size("rqt") == 0) | (F.size("ut") == 0), 0.0).otherwise(T.overlap("rqt", "ut").cast("double") / F.size("rqt"))
    rows = rows.withColumn("dialogue", is_dialogue("question", "model_answer")).withColumn("quote_share", quote_share)
    m, sim, ev, ref = F.col("m"), F.col("similarity"), F.col("evidence_similarity"), F.col("reference_similarity")
    usable = F.col("dialogue") & (F.size("rqt") > 0) & (F.size("ut") > 0)
    rows = rows.withColumn("floor", F.greatest(
        F.coalesce("obvious", F.lit(0)), F.coalesce("evident", F.lit(0)), heuristic_floor(m, F.col("ratio"), sim),
        semantic_floor(m, F.col("ratio"), sim, ev),
        equivalence_floor(m, F.when(F.col("dialogue"), F.col("quote_share")).otherwise(0.0), sim, ev, ref,
                          F.col("e_ratio"), F.col("e_precision"), F.col("e_quote")),
        F.coalesce(dialogue_floor(usable, is_manner_only("user", "ut"), F.col("quote_share"), m, sim, ev), F.lit(0))))
    early = F.when(F.col("user") == "", 0).when(F.col("obvious") == 10, 10).when(F.coalesce("evident", F.lit(0)) >= 9, 10)
    rows = rows.withColumn("score", F.coalesce(early, F.col("floor"))).withColumn(
        "feedback", F.when(F.col("user") == "", lists.NO_ANSWER_FEEDBACK).otherwise(rubric("score")))
    if responses is not None:
        words = lambda c: T.word_set(T.question_norm(c))
        share_of = lambda a, b, whole: T.overlap(a, b).cast("double") / F.greatest(F.size(whole), F.lit(1))
        blend = blended_similarity(sim, ev, share_of(F.col("cw"), words("user"), words("user")),
                                   share_of(words("model_answer"), words("user"), words("model_answer")))
        rows = rows.join(responses.select("attempt_id", _whole_score("score").alias("_given"), T.squeeze(
            F.coalesce("feedback", F.lit(""))).alias("_said")), "attempt_id", "left").withColumn("_fallback", similarity_score(blend))
        open_ = early.isNull() & F.col("floor").between(3, 7)
        usable_ = F.col("_given").isNotNull() & (F.col("_said") != "")
        clamped = F.greatest(F.least(F.greatest(F.col("_given"), F.lit(0)), F.lit(10)), F.col("floor"))
        final = F.when(open_ & usable_, clamped).when(open_, F.greatest("_fallback", "floor")).otherwise(F.col("score"))
        raised = usable_ & open_ & (clamped == F.col("floor")) & (clamped > F.col("_given"))
        rows = rows.withColumn("_final", final).withColumn("feedback", F.when(open_ & usable_ & ~raised, F.col("_said")).when(
            open_, rubric("_final")).otherwise(F.col("feedback"))).withColumn("score", F.col("_final"))
    return rows.select("attempt_id", F.col("score").cast("int").alias("score"), "feedback", "model_answer", F.col("floor").cast("int").alias("floor"), *similar)

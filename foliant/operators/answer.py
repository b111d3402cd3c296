"""Extractive and grounded answers: sentence picks, support gate, evidence, outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lists
from ..functions import responses as R
from ..functions import text as T
from ..functions.policy import is_blocked, refusal_message, with_policy
from ..plans.scans import top_rows
from ..session import cut
from .retrieve import (as_retrieved, focused_context, merge_lists, neighbors, retrieve)

SUPPORT_RELEVANCE = 0.55


# -- question types --------------------------------------------------------------------

def wants_reason(q) -> Column:
    n = F.lower(T.col(q))
    return T.any_of(n, ["why", "reason"]) & T.any_of(n, ["consequence", "result", "effect", "happen"])


def wants_treatment(q) -> Column:
    n = F.lower(T.col(q))
    return T.any_of(n, ["diagnosis", "condition"]) & T.any_of(n, ["treatment", "prescribe", "prescribed"])


def wants_identity(q) -> Column:
    n = T.strip(F.lower(T.col(q)))
    return n.rlike("^who (?:is|was) ") | T.any_of(
        n, [" responsibilities ", " responsibility ", " role ", " professions ", " profession "])


def needs_strong_support(q) -> Column:
    c = T.col(q)
    n = F.lower(c)
    exempt = c.rlike('["“]') | n.contains("excerpt")
    return ~exempt & ~(wants_reason(c) | wants_treatment(c) | wants_identity(c) | n.startswith("what did "))


def entity_name(q) -> Column:
    asks = T.words(["what", "when", "where", "which", "who", "why", "how"])
    found = F.filter(F.regexp_extract_all(T.col(q), F.lit(T.ENTITY), F.lit(0)), lambda w: ~F.array_contains(asks, F.lower(w)))
    return T.let(found, lambda e: F.when(
        (F.size(e) >= 2) & F.lower(F.get(e, F.lit(0))).isin("mr", "mrs", "ms", "miss", "dr"),
        F.concat(F.get(e, F.lit(0)), F.lit(". "), F.get(e, F.lit(1)))).otherwise(F.coalesce(F.get(e, F.lit(0)), F.lit(""))))


def speech_verb(q) -> Column:
    n = F.concat(F.lit(" "), F.lower(T.col(q)), F.lit(" "))
    return F.coalesce(*[F.when(n.contains(f" {word} "), F.lit(label)) for word, label in lists.SPEECH_VERBS], F.lit(""))


# -- sentences of the evidence ------------------------------------------------------------

def _terms(x) -> Column:
    return T.word_set(T.question_norm(x))


def text_sentences(content, asides: bool = True, least: int = 40) -> Column:
    """Sentences of a text in reading order, fragments left out, each with what every question about it needs:
    no, sentence, norm, words and, with ``asides``, lowered, asks and tells."""

    def lowered(s):
        return F.struct(s["no"].alias("no"), s["sentence"].alias("sentence"), F.lower(s["sentence"]).alias("lowered"))

    def formed(s):
        # a sentence has no white space but single spaces, so the normal form needs no Unicode classes
        norm = F.trim(F.regexp_replace(F.regexp_replace(s["lowered"], "[^a-z0-9 ]+", ""), " {2,}", " "))
        return F.struct(s["no"].alias("no"), s["sentence"].alias("sentence"), s["lowered"].alias("lowered"), norm.alias("norm"))

    def parted(s):
        own = [s[c].alias(c) for c in ("no", "sentence", "norm")] + [F.split(s["norm"], " ").alias("words")]
        if asides:
            own += [s["lowered"].alias("lowered"), T.any_of(s["lowered"], lists.ASKING_PHRASES).alias("asks"),
                    T.any_of(s["lowered"], lists.TELLING_PHRASES).alias("tells")]
        return F.struct(*own)

    numbered = F.transform(T.sentences(content, least), lambda s, i: F.struct(i.alias("no"), s.alias("sentence")))
    whole = F.filter(numbered, lambda s: ~s["sentence"].rlike("^[a-z]"))
    return F.transform(F.transform(F.transform(whole, lowered), formed), parted)


def _ranked(keep, score, first=None):
    """Struct per sentence that sorts as its rank in one text: wanted phrases first, then score, then place."""
    rows = F.filter("sentences", keep)
    return F.transform(rows, lambda s: F.struct(
        (F.lit(False) if first is None else first(s)).alias("first"), F.round(score(s), 6).alias("score"),
        (-s["no"]).alias("back"), s["sentence"].alias("sentence"), s["norm"].alias("norm")))


def _best(ranked: Column) -> Column:
    return F.array(F.array_max(ranked))


def _best_two(ranked: Column) -> Column:
    """The best sentence, and the best one of another normal form."""
    return T.let(ranked, lambda r: T.let(F.array_max(r), lambda top: F.array(
        top, F.array_max(F.filter(r, lambda x: x["norm"] != top["norm"])))))


def _hinted(hints, phrases=()) -> Column:
    """Sentences supported by the question and the hints; those that hold a hint phrase come before all others."""
    def hits(s):
        out = F.lit(0)
        for phrase in phrases:
            out = out + F.contains(s["lowered"], F.lit(phrase)).cast("int")
        return out

    def score(s):
        return (T.overlap(F.col("asked"), s["words"]) + T.overlap(T.words(hints), s["words"]) * 1.8 + hits(s) * 5.0
                + F.col("relevance") * 2.0 - F.when(F.contains(s["sentence"], F.lit("?")), 3.0).otherwise(0.0)
                - F.when(s["asks"], 3.0).otherwise(0.0) - F.when(s["tells"], 3.0).otherwise(0.0))

    ranked = _ranked(lambda s: s["norm"] != "", score, lambda s: hits(s) > 0)
    return F.filter(ranked, lambda r: r["score"] > -1.0)


def _named(s, leads: str) -> Column:
    return (F.col("entity") == "") | F.contains(s["lowered"], F.lower("entity")) | s["lowered"].rlike(leads)


def _identity() -> Column:
    return _ranked(
        lambda s: F.arrays_overlap(s["words"], T.words(lists.IDENTITY_REQUIRED))
        & (_named(s, "^(?:she is |he is |they are )") | s["lowered"].contains("john's sister"))
        & ~T.any_of(s["lowered"], ["my brother", "a friend who"]),
        lambda s: T.overlap(F.col("asked"), s["words"]) + T.overlap(T.words(lists.IDENTITY_HINTS), s["words"]) * 1.8 + F.col("relevance") * 2.0)


def _responsibility() -> Column:
    return _ranked(
        lambda s: F.arrays_overlap(s["words"], T.words(lists.RESPONSIBILITY_REQUIRED)) & _named(s, "^(?:she |he |they )")
        & ~T.any_of(s["lowered"], ["don't care", "do not care"]),
        lambda s: T.overlap(F.col("asked"), s["words"]) + T.overlap(T.words(lists.RESPONSIBILITY_HINTS), s["words"]) * 1.9
        + T.overlap(T.words(lists.RESPONSIBILITY_REQUIRED), s["words"]) * 2.2 + F.col("relevance") * 2.0
        + F.when(s["lowered"].contains("sees to everything"), 2.0).otherwise(0.0))


def _first_of(picks: DataFrame, part: str, out: str, other_than: DataFrame | None = None) -> DataFrame:
    """The best pick of a part per query: query_id, sentence as ``out``, norm. ``other_than``: picks whose normal form it must not have."""
    rows = picks.filter(F.col("part") == part)
    if other_than is not None:
        rows = rows.join(other_than.select("query_id", F.col("norm").alias("taken")), "query_id", "left").filter(
            F.col("taken").isNull() | (F.col("norm") != F.col("taken")))
    best = top_rows(rows, ["query_id"], [F.desc("first"), F.desc("score"), F.col("place"), F.desc("back")], 1, "_r")
    return best.select("query_id", F.col("sentence").alias(out), "norm")


def _general() -> Column:
    """The two sentences that share most with the question."""
    shared = F.transform("sentences", lambda s: F.struct(T.overlap(F.col("terms"), s["words"]).alias("n"), s.alias("s")))
    # terms that are shared are support terms of the sentence; without any it must have one of its own
    own = lambda s: F.size(F.filter(F.array_except(s["words"], T.words(lists.SUPPORT_STOPWORDS)), lambda t: F.length(t) > 1)) > 0
    told = F.filter(shared, lambda x: (x["n"] >= 2) | ((F.size("terms") <= 4) & ((x["n"] > 0) | own(x["s"]))))
    scored = F.transform(told, lambda x: F.struct(
        F.lit(False).alias("first"),
        F.round(x["n"] + F.col("relevance") * 2.0 - F.when(F.contains(x["s"]["sentence"], F.lit("?")), 2.5).otherwise(0.0), 6).alias("score"),
        F.lit(0).alias("back"), x["s"]["sentence"].alias("sentence"), x["s"]["norm"].alias("norm")))
    return F.slice(F.sort_array(F.filter(scored, lambda x: x["score"] > 0), asc=False), 1, 2)


#: Parts of the answers by what a question asks for: the first sentence, and the second, which must have another form.
PARTS = {"why": ("reason", "effect"), "ill": ("diagnosis", "treatment"), "who": ("identity", "responsibility")}


def _picks(rows: DataFrame, typed: bool) -> DataFrame:
    """query_id, place, part, first, score, back, sentence, norm: what goes on from a (query, text), its best sentences for each part.

    Where a text has both sentences of a typed answer, in whatever forms, the question needs no general one.
    """
    tag = lambda part: lambda x: F.struct(F.lit(part).alias("part"), x.alias("x"))
    none = F.array().cast("array<struct<first:boolean,score:double,back:int,sentence:string,norm:string>>")
    if typed:
        best = {"reason": _best(_hinted(lists.REASON_HINTS, lists.REASON_PHRASES)), "effect": _best_two(_hinted(lists.CONSEQUENCE_HINTS, lists.CONSEQUENCE_PHRASES)),
                "diagnosis": _best(_hinted(lists.DIAGNOSIS_HINTS)), "treatment": _best_two(_hinted(lists.TREATMENT_HINTS)),
                "identity": _best(_identity()), "responsibility": _best_two(_responsibility())}
        found = F.struct(*[F.when(F.col(kind), best[part]).otherwise(none).alias(part) for kind, pair in PARTS.items() for part in pair])
        got = lambda z, part, i: F.get(z[part], F.lit(i)).isNotNull()
        settled = lambda z: (got(z, "reason", 0) & got(z, "effect", 1)) | (got(z, "diagnosis", 0) & got(z, "treatment", 1)) | got(z, "responsibility", 1)
        parts = T.let(found, lambda z: F.concat(
            *[F.transform(z[part], tag(part)) for part in best], F.transform(F.when(settled(z), none).otherwise(_general()), tag("general"))))
    else:
        parts = F.transform(_general(), tag("general"))
    picks = rows.select("query_id", "place", F.explode(parts).alias("p"))
    return picks.filter("p.x is not null").select("query_id", "place", "p.part", "p.x.*")


def sentence_answers(uses: DataFrame, texts: DataFrame, typed: bool = True) -> DataFrame:
    """query_id, answer, branch from the sentences of each question's texts; a text is cut into sentences once for all of them."""
    rows = uses.join(_texts_of(texts, uses).select("text_id", text_sentences("content", typed).alias("sentences")), "text_id")
    picks = cut(_picks(rows, typed))
    found = {}
    if typed:
        joined = lambda left, right, glue: left.drop("norm").join(right.drop("norm"), "query_id").select("query_id", T.squeeze(glue).alias("answer"))
        first = {pair[0]: _first_of(picks, pair[0], pair[0]) for pair in PARTS.values()}
        second = {b: _first_of(picks, b, b, first[a]) for a, b in PARTS.values()}
        duty = second["responsibility"].drop("norm").join(first["identity"].drop("norm"), "query_id", "left").join(
            uses.filter("who").select("query_id", "entity").distinct(), "query_id")
        found = {
            "reason": joined(first["reason"], second["effect"], F.concat(F.lit("Reason: "), "reason", F.lit(" Consequence: "), "effect")),
            "treatment": joined(first["diagnosis"], second["treatment"], F.concat_ws(" ", "diagnosis", "treatment")),
            "identity": duty.select("query_id", T.squeeze(F.concat_ws(
                " ", named_sentence("entity", "identity"), named_sentence("entity", "responsibility"))).alias("answer"))}
    two = top_rows(picks.filter("part = 'general'"), ["query_id"], [F.desc("score"), F.desc("sentence")], 2, "r")
    text = F.transform(F.array_sort(F.collect_list(F.struct("r", "sentence"))), lambda x: x["sentence"])
    found["general"] = two.groupBy("query_id").agg(T.squeeze(F.array_join(text, " ")).alias("answer"))
    rows = None
    for order, (name, part) in enumerate(found.items()):
        part = part.filter("answer <> ''").withColumn("branch", F.lit(name)).withColumn("_o", F.lit(order))
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("query_id").agg(F.min_by(F.struct("answer", "branch"), "_o").alias("b")).select("query_id", "b.answer", "b.branch")


def named_sentence(entity, sentence) -> Column:
    """The entity's name in place of a leading pronoun."""
    e, s = T.col(entity), F.coalesce(T.col(sentence), F.lit(""))
    n = F.lower(s)
    return (F.when((s == "") | (e == "") | F.contains(n, F.lower(e)), s)
            .when(n.startswith("she is "), F.concat(e, F.lit(" "), F.substr(s, F.lit(4))))
            .when(n.startswith("he is "), F.concat(e, F.lit(" "), F.substr(s, F.lit(3))))
            .when(n.startswith("there comes john's sister"), F.concat(e, F.lit(" is John's sister.")))
            .otherwise(s))


def asks_for_speech(q) -> Column:
    asked = T.strip(F.lower(T.col(q)))
    return asked.startswith("what did ") & (asked.contains(" when ") | (speech_verb(q) != ""))


def reported_speech(uses: DataFrame, texts: DataFrame) -> DataFrame:
    """Answers to "what did X say when ...": query_id, answer."""
    rows = uses.filter(asks_for_speech("question"))
    rows = rows.withColumn("verb", speech_verb("question")).withColumn("entity", entity_name("question"))
    cue = T.question_norm(F.regexp_extract(T.strip("question"), r"(?iU)\bwhen\b\s+(.+?)\??$", 1))
    rows = rows.withColumn("cue", T.word_set(cue))
    # generators keep filters from computing the columns they look at a second time
    form = lambda text: F.struct(text.alias("text"), F.lower(text).alias("lowered"))
    spoken_texts = _texts_of(texts, rows).select("text_id", F.inline(F.transform(F.array(T.squeeze("content")), form))).filter(
        T.any_of("lowered", lists.SPEECH_MARKERS))
    # white space is single spaces by now
    spoken_texts = spoken_texts.select("*", F.explode(F.array(F.split(F.regexp_replace("lowered", "[^a-z0-9 ]+", ""), " +"))).alias("words"))
    rows = rows.join(spoken_texts, "text_id").withColumn("shared", T.overlap("cue", "words"))
    enough = (F.size("cue") == 0) | (F.col("shared") >= F.greatest(F.lit(1), F.least(F.lit(2), F.size("cue"))))
    rows = rows.filter(((F.col("entity") == "") | F.contains("lowered", F.lower("entity"))) & enough)
    lead = T.squeeze(T.strip_chars(F.regexp_extract(
        "text", r"(?iU)^(.+?)\b(?:said|whispered|asked|replied|returned|cried|shouted)\b", 1), " \"'?,;:-"))
    tail = F.when(F.contains("text", F.lit(",")), T.squeeze(T.strip_chars(F.substring_index("text", ",", -1), " \"'?"))).otherwise("")
    spoken = T.let(T.quoted_segments("text"), lambda quotes: T.squeeze(F.array_join(
        F.when((F.size("cue") > 0) & (F.size(quotes) > 1), F.slice(quotes, -1, 1)).otherwise(quotes), " ")))
    spoken = T.let(spoken, lambda s: F.when((s == "") & (F.col("verb") != ""), lead).otherwise(s))
    spoken = T.let(spoken, lambda s: F.when(s == "", tail).otherwise(s))
    rows = rows.select("*", F.explode(F.array(spoken)).alias("spoken")).filter(F.length("spoken") >= 6)
    guessed = (F.when(F.contains("lowered", F.lit("ask")) | F.contains("spoken", F.lit("?")), "asked")
               .when(F.contains("lowered", F.lit(" replied ")), "replied").when(F.contains("lowered", F.lit(" returned ")), "returned")
               .otherwise("said"))
    said = F.when(F.col("verb") == "", guessed).otherwise(F.col("verb"))
    said = F.when(said == "returned", "replied").otherwise(said)
    who = F.when(F.col("entity") == "", "The speaker").otherwise(F.col("entity"))
    rows = rows.withColumn("answer", F.concat(who, F.lit(" "), said, F.lit(', "'), "spoken", F.lit('"'))).withColumn("score", F.round(
        F.col("shared") * 2.5 + F.col("relevance") * 2.0 + F.when(F.contains("lowered", F.lit("news of the day")), 3.0).otherwise(0.0), 6))
    return top_rows(rows, ["query_id"], [F.desc("score"), F.col("place")], 1, "_r").select("query_id", "answer")


def _texts_of(texts: DataFrame, uses: DataFrame) -> DataFrame:
    return texts.join(uses.select("text_id").distinct(), "text_id", "left_semi")


def extractive_answers(queries: DataFrame, evidence: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """query_id, answer, branch. Evidence: query_id, place, relevance, content, or text_id instead of content where
    ``texts`` (text_id, content) has each text once.

    Branches in order of precedence: reported speech, reason and consequence,
    diagnosis and treatment, identity and responsibility, general. What speech answers goes no further.
    """
    q = queries.select("query_id", F.col("query").alias("question"))
    if texts is None:
        evidence = evidence.filter(F.col("content").isNotNull()).withColumn("text_id", F.unhex(F.sha2(F.encode("content", "UTF-8"), 256)))
        texts = evidence.select("text_id", "content")
        texts = texts.groupBy("text_id").agg(F.any_value("content").alias("content"))
    uses = evidence.select("query_id", "place", "relevance", "text_id")
    q = cut(q.withColumns({"why": wants_reason("question"), "ill": wants_treatment("question"), "who": wants_identity("question"),
                           "said": asks_for_speech("question")}))
    some = lambda kind: len(q.filter(kind).select(F.lit(1)).head(1)) > 0
    speech, open_q = None, q
    if some("said"):
        speaking = uses.join(q.filter("said").select("query_id", "question"), "query_id")
        speech = cut(reported_speech(speaking, texts).filter("answer <> ''").withColumn("branch", F.lit("speech")))
        open_q = q.join(speech.select("query_id"), "query_id", "left_anti")
    asked = open_q.select("query_id", *PARTS, _terms("question").alias("asked"), T.support_terms("question").alias("terms"), entity_name("question").alias("entity"))
    rows = sentence_answers(uses.join(asked, "query_id"), texts, some("why or ill or who"))
    return rows if speech is None else rows.unionByName(speech)


# -- gate and evidence ------------------------------------------------------------------------

def support_gate(queries: DataFrame, evidence: DataFrame) -> DataFrame:
    """query_id, coverage, top_relevance, supported over each query's evidence."""
    q = queries.select("query_id", F.col("query").alias("question")).withColumn("q", T.support_terms("question"))
    segments = F.filter(F.transform(F.regexp_extract_all("question", F.lit('["“”](.*?)["“”]'), F.lit(1)), T.question_norm),
                        lambda s: s != "")
    q = q.withColumn("segments", segments)
    parts = T.let(T.sentences("content", 25), lambda s: F.when(F.size(s) > 0, s).otherwise(F.array(T.squeeze("content"))))
    rows = evidence.join(q, "query_id").withColumn("best", F.array_max(F.transform(
        parts, lambda s: T.overlap("q", T.support_terms(s)) / F.greatest(F.size("q"), F.lit(1)))))
    said = T.let(T.question_norm("content"), lambda n: F.exists("segments", lambda s: F.contains(n, s)))
    rows = rows.withColumn("ratio", F.when((F.size("q") <= 2) | said, 1.0).otherwise(F.col("best")))
    out = rows.groupBy("query_id").agg(F.max("ratio").alias("coverage"), F.max("relevance").alias("top_relevance"))
    return out.withColumn("supported", (F.col("coverage") >= 0.45 - 1e-12) | (F.col("top_relevance") >= 0.72 - 1e-12))


def select_evidence(answers: DataFrame, evidence: DataFrame) -> DataFrame:
    """Up to two chunk ids per answer by shared terms, relevance and containment; else the first chunk.

    ``answers``: query_id, question, answer.
    """
    rows = evidence.join(answers.select("query_id", "question", "answer"), "query_id")
    target = T.support_terms(F.concat_ws(" ", "question", "answer"))
    norm = T.question_norm("answer")
    held = (norm != "") & F.contains(T.question_norm("content"), norm)
    score = T.overlap(target, T.support_terms("content")) + F.col("relevance") + F.when(held, 4.0).otherwise(0.0)
    rows = rows.withColumn("score", F.round(score, 6))
    best = top_rows(rows.filter("score > 0"), ["query_id"], [F.desc("score"), F.desc("chunk_id")], 2, "r")
    chosen = best.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "chunk_id"))),
                                                      lambda x: x["chunk_id"]).alias("ids"))
    first = rows.groupBy("query_id").agg(F.min_by("chunk_id", "place").alias("first"))
    return first.join(chosen, "query_id", "left").select("query_id", F.coalesce("ids", F.array("first")).alias("evidence_ids"))


# -- responses ----------------------------------------------------------------------------------

def parse_responses(responses: DataFrame) -> DataFrame:
    """query_id, status, answer, read, evidence_ids, parse_path from raw response text.

    Tried in order: JSON as it stands, JSON with mended brackets, fields by
    pattern, plain text. Only rows the native parse rejects reach the mending step.
    ``read`` is the answer as the response has it, null without one; of a plain text too short to be used, ``answer`` is empty.
    """
    rows = responses.withColumn("candidate", R.json_candidate("raw_text")).withColumn("ok", R.is_json_object("candidate"))
    rows = rows.withColumn("mended", R.mend_json(F.when(~F.col("ok"), F.col("candidate"))))
    rows = rows.withColumn("mended_ok", F.col("mended").isNotNull() & R.is_json_object("mended"))
    rows = rows.withColumn("partial", F.when(~F.col("ok") & ~F.col("mended_ok"), R.partial_payload("raw_text")))
    rows = rows.withColumn("payload", R.json_payload(F.when(F.col("ok"), F.col("candidate")).when(F.col("mended_ok"), F.col("mended"))))
    path = (F.when(F.col("ok"), "json").when(F.col("mended_ok"), "repaired").when(F.col("partial").isNotNull(), "partial")
            .otherwise("plain"))
    said = F.when(F.col("raw_text").isNotNull(), R.plain_text("raw_text"))
    rows = rows.withColumn("read", F.when(path == "plain", said).otherwise(T.squeeze(F.coalesce("payload.answer", "partial.answer"))))
    answer = F.when(path == "plain", R.usable_answer("read")).otherwise(F.coalesce("read", F.lit("")))
    ids = F.transform(F.coalesce(F.col("payload.evidence_ids"), F.col("partial.evidence_ids"), F.array().cast("array<string>")),
                      R.evidence_id)
    return rows.select("query_id", F.lower(T.strip(F.coalesce(F.col("payload.status"), F.col("partial.status"), F.lit("")))).alias("status"),
                       answer.alias("answer"), "read", ids.alias("evidence_ids"), path.alias("parse_path"), "raw_text",
                       F.col("payload.score").alias("score"), F.col("payload.feedback").alias("feedback"))


# -- the job ---------------------------------------------------------------------------------------

def with_support(retrieved: DataFrame, chunks: DataFrame, window: int = 2) -> DataFrame:
    """Retrieved chunks followed by their neighbors at a fixed relevance, each chunk once."""
    corpus = [c for c in ("dataset_id",) if c in retrieved.columns and c in chunks.columns]
    base = retrieved.select("query_id", *corpus, F.col("rank").alias("place") if "rank" in retrieved.columns else "place",
                            "chunk_id", "source_name", "chunk_index", "content", "distance", "relevance")
    seeds = base.select("query_id", *corpus, "source_name", "chunk_index", F.col("place").alias("seed_no"))
    around = as_retrieved(neighbors(seeds, chunks.select(*corpus, "chunk_id", "source_name", "chunk_index", "content"), ["query_id"], window),
                          SUPPORT_RELEVANCE).select(*base.columns)
    return merge_lists([base, is_blocked(around, "content", "retrieved_context", "_b").filter("not _b").drop("_b")])


def _not_available(answer) -> Column:
    return T.any_of(F.lower(T.col(answer)), lists.NOT_AVAILABLE_SIGNALS)


def answer_prompts(queries: DataFrame, contexts: DataFrame) -> DataFrame:
    """Prompt text per query, the input of a generation step."""
    return queries.join(contexts, "query_id").select("query_id", F.concat(
        F.lit("Answer only from the excerpts. Return JSON with status, answer and evidence_ids.\n\nQuestion: "), "query",
        F.lit("\n\nExcerpts:\n"), "context", F.lit("\n\nAnswer only if the excerpts directly support it.")).alias("prompt"))


def generate(prompts: DataFrame, generate_fn) -> DataFrame:
    """Responses from a plugged-in generator: batches of (query_id, prompt) to (query_id, raw_text)."""
    kind = prompts.schema["query_id"].dataType.simpleString()
    return prompts.select("query_id", "prompt").mapInPandas(generate_fn, f"query_id {kind}, raw_text string")


def grounded_answers(queries: DataFrame, chunks: DataFrame, retrieved: DataFrame | None = None,
                     responses: DataFrame | None = None) -> DataFrame:
    """Answer every query from its evidence: query_id, answer, found, outcome, evidence_ids, source_names.

    ``responses`` (query_id, raw_text) are optional; without them the answer is extractive.
    """
    asked = with_policy(queries, "query", "user_query", "decision")
    asked = cut(asked.withColumn("refusal", F.when(F.col("decision.blocked"), refusal_message("decision"))).drop("decision"))
    open_q = asked.filter("refusal is null").drop("refusal")
    hits = retrieve(open_q, chunks) if retrieved is None else retrieved.join(open_q.select("query_id"), "query_id", "left_semi")
    hits = is_blocked(hits, "content", "retrieved_context", "_b").filter("not _b").drop("_b")
    evidence = cut(with_support(hits, chunks))
    corpus = [c for c in ("dataset_id",) if c in evidence.columns]
    wide = merge_lists([evidence, as_retrieved(neighbors(
        evidence.select("query_id", *corpus, "source_name", "chunk_index", F.col("place").alias("seed_no")),
        chunks.select(*corpus, "chunk_id", "source_name", "chunk_index", "content"), ["query_id"], 2), SUPPORT_RELEVANCE).select(*evidence.columns)])
    extracted = extractive_answers(open_q, wide).withColumnRenamed("answer", "extracted")
    rows = open_q.withColumn("strong", needs_strong_support("query")).join(
        support_gate(open_q, evidence), "query_id", "left").join(extracted, "query_id", "left")
    passes = ~F.col("strong") | F.coalesce("supported", F.lit(False))
    if responses is None:
        rows = rows.withColumn("status", F.lit("")).withColumn("given", F.lit("")).withColumn(
            "given_ids", F.array().cast("array<string>"))
    else:
        rows = rows.join(parse_responses(responses).select("query_id", "status", F.col("answer").alias("given"), F.col("evidence_ids").alias("given_ids")), "query_id", "left")
        rows = rows.na.fill("", ["status", "given"]).withColumn("given_ids", F.coalesce("given_ids", F.array().cast("array<string>")))
    typed = wants_reason("query") | wants_treatment("query") | wants_identity("query")
    direct = (F.col("status") == "supported") & (F.col("given") != "") & ~_not_available("given")
    override = F.coalesce(F.col("extracted"), F.lit("")) != ""
    candidate = F.when(direct & override & typed, F.col("extracted")).when(direct, F.col("given")).when(
        override & passes, F.col("extracted")).when(F.col("status") == "", F.col("given")).otherwise("")
    early = F.col("coverage").isNull() | ~passes | ((F.col("status") == "not_available") & ~(override & passes))
    rows = rows.withColumn("keep_ids", direct & ~(override & typed)).withColumn("candidate", F.coalesce(candidate, F.lit(""))).withColumn(
        "unavailable", early | (F.col("candidate") == "") | _not_available("candidate"))
    rows = cut(with_policy(rows, "candidate", "model_output", "decision").withColumn(
        "refusal", F.when(F.col("decision.blocked"), refusal_message("decision"))).drop("decision"))
    live = rows.filter("not unavailable and refusal is null")
    chosen = select_evidence(live.select("query_id", F.col("query").alias("question"), F.col("candidate").alias("answer")), evidence)
    known = evidence.groupBy("query_id").agg(F.collect_set("chunk_id").alias("known"))
    picked = live.join(chosen, "query_id").join(known, "query_id").select("query_id", F.when(
        F.col("keep_ids"), F.array_intersect("given_ids", "known")).otherwise(F.col("evidence_ids")).alias("evidence_ids"))
    cited = evidence.join(picked, "query_id").filter((F.size("evidence_ids") == 0) | F.array_contains("evidence_ids", F.col("chunk_id")))
    again = support_gate(open_q, cited).select("query_id", F.col("supported").alias("still"))
    names = lambda t, out: t.groupBy("query_id").agg(F.array_distinct(F.transform(
        F.array_sort(F.collect_list(F.struct("place", "source_name"))), lambda s: s["source_name"])).alias(out))
    rows = rows.join(picked, "query_id", "left").join(again, "query_id", "left").join(
        names(cited, "cited_names"), "query_id", "left").join(names(evidence, "all_names"), "query_id", "left")
    found = ~F.col("unavailable") & F.col("refusal").isNull() & (~F.col("strong") | F.coalesce("still", F.lit(False)))
    refused = ~F.col("unavailable") & F.col("refusal").isNotNull()
    none = F.array().cast("array<string>")
    answered = rows.select(
        "query_id", F.when(found, F.col("candidate")).when(refused, F.col("refusal")).otherwise(lists.NOT_AVAILABLE_TEXT).alias("answer"),
        found.alias("found"), F.when(found, "found").when(refused, "refused").otherwise("not_available").alias("outcome"),
        F.when(found, F.col("evidence_ids")).otherwise(none).alias("evidence_ids"),
        F.coalesce(F.when(found, F.col("cited_names")).otherwise(F.col("all_names")), none).alias("source_names"))
    blocked = asked.filter("refusal is not null").select(
        "query_id", F.col("refusal").alias("answer"), F.lit(False).alias("found"), F.lit("refused").alias("outcome"),
        none.alias("evidence_ids"), none.alias("source_names"))
    return answered.unionByName(blocked)


def context_prompts(queries: DataFrame, evidence: DataFrame) -> DataFrame:
    ranked = evidence.withColumn("rank", F.col("place"))
    return answer_prompts(queries, focused_context(queries, ranked))

"""Answers, questions and grading."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import retrieval_sql as R
from checks import tables as S
from checks.pages import _SECRETS, _T
from checks.retrieval import mixed_queries
from foliant.functions import lists as LI
from foliant.functions import text as T
from foliant.operators import answer as A
from foliant.operators import grade as G
from foliant.operators import prompts as P
from foliant.operators import questions as Q
from foliant.operators import retrieve as H
from foliant.session import cut

QUERIES: dict = {}
ORACLES: dict = {}


def register(name: str, sql: str | None = None):
    def add(run):
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run
    return add


def _any(x, values):
    return "(" + " OR ".join(f"contains({x}, {S.lit(v)})" for v in values) + ")"


_TYPES = f"""(({_any('n', ['why', 'reason'])}) AND {_any('n', ['consequence', 'result', 'effect', 'happen'])}) AS reason,
  ({_any('n', ['diagnosis', 'condition'])} AND {_any('n', ['treatment', 'prescribe', 'prescribed'])}) AS treatment,
  (regexp_matches(trim(n), '^who (is|was) ') OR {_any('trim(n)', [' responsibilities ', ' responsibility ', ' role ', ' professions ', ' profession '])}) AS identity"""


@register("p14_question_types", f"""
WITH {R.QUERY_SETS['mixed']}, t AS (SELECT query_id, query, n, {_TYPES} FROM (SELECT *, lower(query) AS n FROM q))
SELECT query_id, reason, treatment, identity, NOT (contains(query, '"') OR contains(n, 'excerpt')) AND NOT (reason OR treatment OR identity OR starts_with(n, 'what did ')) AS strong FROM t""")
def p14(spark, d):
    return mixed_queries(spark, d).select("query_id", A.wants_reason("query").alias("reason"), A.wants_treatment("query").alias("treatment"),
                                          A.wants_identity("query").alias("identity"), A.needs_strong_support("query").alias("strong"))


_SECRET = f"coalesce({', '.join(_SECRETS)}) IS NOT NULL".replace("(t,", f"({_T.replace('text', 'content')},")


def _around(name: str, source: str, order: str) -> str:
    return f"""{name}_w AS (SELECT query_id, source_name, chunk_index + o AS chunk_index, min({{s: {order}, o: o}}) AS seen FROM {source}, (SELECT unnest([-2, -1, 0, 1, 2]) AS o) GROUP BY ALL),
{name} AS (SELECT query_id, chunk_id, source_name, chunk_index, content, row_number() OVER (PARTITION BY query_id ORDER BY seen) AS place FROM {name}_w JOIN chunks USING (source_name, chunk_index))"""


def _merged(name: str, first: str, second: str) -> str:
    return f"""{name}0 AS (SELECT query_id, chunk_id, source_name, chunk_index, content, max(relevance) AS relevance, min({{l: l, p: place}}) AS f FROM (
  SELECT query_id, chunk_id, source_name, chunk_index, content, relevance, 0 AS l, place FROM {first}
  UNION ALL SELECT query_id, chunk_id, source_name, chunk_index, content, 0.55, 1, place FROM {second}) GROUP BY ALL),
{name} AS (SELECT * EXCLUDE f, row_number() OVER (PARTITION BY query_id ORDER BY f) AS place FROM {name}0)"""


def _general(name: str, evidence: str) -> str:
    terms = S.support_terms
    return f"""{name}_s AS (SELECT query_id, relevance, s FROM (SELECT query_id, relevance, unnest({S.sentences('content', 40)}) AS s FROM {evidence}) WHERE NOT regexp_matches(s, '^[a-z]')),
{name}_t AS (SELECT {name}_s.*, {terms('query')} AS qt, {terms('s')} AS st FROM {name}_s JOIN q USING (query_id)),
{name}_x AS (SELECT *, round(len(list_intersect(qt, st)) + relevance * 2.0 - CASE WHEN contains(s, '?') THEN 2.5 ELSE 0 END, 6) AS score FROM {name}_t
  WHERE len(st) > 0 AND (len(list_intersect(qt, st)) >= 2 OR len(qt) <= 4)),
{name} AS (SELECT query_id, trim(string_agg(s, ' ' ORDER BY score DESC, s DESC)) AS answer FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, s DESC) AS r FROM {name}_x WHERE score > 0) WHERE r <= 2 GROUP BY 1)"""


def _gate(name: str, evidence: str) -> str:
    return f"""{name}_p AS (SELECT query_id, relevance, unnest(CASE WHEN len({S.sentences('content', 25)}) > 0 THEN {S.sentences('content', 25)} ELSE [{S.sq('content')}] END) AS s FROM {evidence}),
{name} AS (SELECT query_id, max(CASE WHEN len(qt) <= 2 THEN 1.0 ELSE len(list_intersect(qt, {S.support_terms('s')})) / greatest(len(qt), 1) END) AS coverage, max(relevance) AS top
  FROM {name}_p JOIN (SELECT query_id, {S.support_terms('query')} AS qt FROM q) USING (query_id) GROUP BY 1)"""


_HITS = R.hybrid("plain") + f""",
hit AS (SELECT query_id, rank AS place, chunk_id, source_name, chunk_index, content, relevance FROM ret WHERE NOT ({_SECRET})),
{_around('sup_all', 'hit', 'place')},
sup AS (SELECT * FROM sup_all WHERE NOT ({_SECRET})),
{_merged('ev', 'hit', 'sup')},
{_around('wid', 'ev', 'place')},
{_merged('wide', 'ev', 'wid')},
{_general('ga', 'wide')},
{_gate('gate', 'ev')}"""


def _evidence(spark, d):
    q, c = S.benchmark_queries(spark, d), S.stored_chunks(spark, d)
    return q, c, cut(H.retrieve(q, c))


def _safe(rows):
    from foliant.functions.policy import is_blocked
    return is_blocked(rows, "content", "retrieved_context", "_b").filter("not _b").drop("_b")


@register("p06_j14_j21_supported_evidence", f"WITH {_HITS} SELECT query_id, place, chunk_id, round(relevance, 6) AS relevance FROM ev")
def j14(spark, d):
    _, c, r = _evidence(spark, d)
    return A.with_support(_safe(r), c).select("query_id", "place", "chunk_id", F.round("relevance", 6).alias("relevance"))


@register("p15_support_gate", f"""
WITH {_HITS} SELECT query_id, round(coverage, 6) AS coverage, round(top, 6) AS top_relevance, coverage >= 0.45 - 1e-12 OR top >= 0.72 - 1e-12 AS supported FROM gate""")
def p15(spark, d):
    q, c, r = _evidence(spark, d)
    return A.support_gate(q, A.with_support(_safe(r), c)).select(
        "query_id", F.round("coverage", 6).alias("coverage"), F.round("top_relevance", 6).alias("top_relevance"), "supported")


_GENERAL = R.hybrid("plain") + ", " + _general("ga", "ret")


@register("m11_extractive_answers", f"WITH {_GENERAL} SELECT query_id, answer, 'general' AS branch FROM ga")
def m11(spark, d):
    q, _, r = _evidence(spark, d)
    return A.extractive_answers(q, r.withColumnRenamed("rank", "place"))


@register("m08_m09_m10_typed_answers")
def m08(spark, d):
    """Documents as evidence of typed questions about their own first name and words."""
    docs = S.table(spark, d, "documents")
    name = F.regexp_extract("text", "[A-Z][a-z]{2,}", 0)
    kinds = F.array(F.concat(F.lit("Why did "), name, F.lit(" leave and what was the result?")),
                    F.concat(F.lit("What condition did "), name, F.lit(" have and what treatment was prescribed?")),
                    F.concat(F.lit("Who is "), name, F.lit("?")), F.concat(F.lit("What did "), name, F.lit(" say when leaving?")))
    q = docs.select(F.posexplode(kinds).alias("k", "query"), (F.col("doc_id") * 4).alias("b")).select((F.col("b") + F.col("k")).alias("query_id"), "query")
    body = F.concat(name, F.lit(' said when leaving, "I could not come in." The housekeeper is his sister and the treatment was air. The result was solitude for all of them here. '), "text")
    e = docs.select((F.col("doc_id") * 4).alias("b"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k"), F.col("doc_id").alias("text_id")).select(
        (F.col("b") + F.col("k")).alias("query_id"), F.lit(1).alias("place"), "text_id", F.lit(1.0).alias("relevance"))
    return A.extractive_answers(q, e, docs.select(F.col("doc_id").alias("text_id"), body.alias("content")))


@register("m12_t06_grounded_answers", f"""
WITH {_HITS},
cand AS (SELECT q.query_id, query, answer, coverage >= 0.45 - 1e-12 OR top >= 0.72 - 1e-12 AS ok FROM q LEFT JOIN gate USING (query_id) LEFT JOIN ga USING (query_id)),
live AS (SELECT * FROM cand WHERE ok AND coalesce(answer, '') <> ''),
es AS (SELECT query_id, chunk_id, place, round(len(list_intersect({S.support_terms("concat_ws(' ', query, answer)")}, {S.support_terms('content')})) + relevance
  + CASE WHEN {S.question_norm('answer')} <> '' AND contains({S.question_norm('content')}, {S.question_norm('answer')}) THEN 4.0 ELSE 0 END, 6) AS score FROM ev JOIN live USING (query_id)),
ids AS (SELECT query_id, list(chunk_id ORDER BY r) AS evidence_ids FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id DESC) AS r FROM es WHERE score > 0) WHERE r <= 2 GROUP BY 1),
cited AS (SELECT ev.* FROM ev JOIN ids USING (query_id) WHERE list_contains(evidence_ids, chunk_id)),
{_gate('again', 'cited')}
SELECT cand.query_id, coalesce(again.coverage >= 0.45 - 1e-12 OR again.top >= 0.72 - 1e-12, false) AS found,
  CASE WHEN coalesce(again.coverage >= 0.45 - 1e-12 OR again.top >= 0.72 - 1e-12, false) THEN answer ELSE {S.lit(LI.NOT_AVAILABLE_TEXT)} END AS answer,
  CASE WHEN coalesce(again.coverage >= 0.45 - 1e-12 OR again.top >= 0.72 - 1e-12, false) THEN array_to_string(evidence_ids, '|') ELSE '' END AS evidence
FROM cand LEFT JOIN ids USING (query_id) LEFT JOIN again USING (query_id)""")
def m12(spark, d):
    q, c, r = _evidence(spark, d)
    return A.grounded_answers(q, c, r).select("query_id", "found", "answer", F.array_join("evidence_ids", "|").alias("evidence"))


@register("m12_s17_answers_with_responses")
def m12b(spark, d):
    """A stub generator answers with the question's own words as JSON."""
    q, c, r = _evidence(spark, d)
    prompts = A.context_prompts(q, A.with_support(_safe(r), c))

    def stub(batches):
        for b in batches:
            said = b["prompt"].str.extract(r"Question: (.*?)\n", expand=False).fillna("none")
            yield b[["query_id"]].assign(raw_text='{"status": "supported", "answer": "' + said + '", "evidence_ids": []}')

    return A.grounded_answers(q, c, r, A.generate(prompts, stub))


# -- questions ---------------------------------------------------------------------------------

@register("p05_question_chunks", f"""
WITH {S.CHUNKS}, s AS (SELECT * FROM chunks WHERE NOT ({_SECRET})), a AS (SELECT corpus, bool_or(length(content) >= 180) AS has_long FROM s GROUP BY 1)
SELECT corpus, chunk_id FROM s JOIN a USING (corpus) WHERE length(content) >= 180 OR NOT has_long""")
def p05(spark, d):
    c = S.chunks(spark, d).withColumn("corpus", F.substring_index("source_name", "-", 1))
    return Q.eligible_chunks(c, "corpus").select("corpus", "chunk_id")


@register("t11_shuffled_chunks", f"WITH {S.CHUNKS} SELECT chunk_id FROM chunks")
def t11(spark, d):
    return Q.shuffled(S.chunks(spark, d)).select("chunk_id")


_SAID = """said AS (SELECT conv_id, turn, conv_id || '-' || turn AS chunk_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM conversations)"""


def spoken(spark, d):
    t = T.squeeze("text")
    return S.table(spark, d, "conversations").select(
        F.lit("d").alias("dataset_id"), F.lit("s").alias("source_name"),
        F.concat(F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("chunk_id"),
        F.concat(F.lit("It rained. asked Anna Bell, while reading page "), F.col("conv_id").cast("string"), F.lit(', "'), t, F.lit('"')).alias("content"))


@register("m13_speech_questions", f"""
WITH {_SAID} SELECT chunk_id, 'What did Anna Bell ask while reading page ' || conv_id || '?' AS question, 'Anna Bell asked, "' || trim(t, ' ,;:-') || '"' AS model_answer
FROM said WHERE length(t) BETWEEN 6 AND 180""")
def m13(spark, d):
    return Q.speech_questions(spoken(spark, d)).select("chunk_id", "question", "model_answer")


@register("m14_j18_generated_questions")
def m14(spark, d):
    return Q.generate_questions(spoken(spark, d))


def question_rows(spark, d):
    """User messages as questions; every third comes again with a word more."""
    u = S.table(spark, d, "conversations").filter("role = 'user'")
    copies = u.withColumn("k", F.explode(F.when(F.pmod("turn", F.lit(3)) == 0, F.array(F.lit(0), F.lit(1), F.lit(2))).otherwise(F.array(F.lit(0)))))
    return copies.select((F.pmod("conv_id", F.lit(5))).cast("string").alias("dataset_id"), (F.col("conv_id") * 1000 + F.col("turn") * 10 + F.col("k")).alias("seq"),
                         F.concat("text", F.when(F.col("k") == 1, " again").when(F.col("k") == 2, " why").otherwise("")).alias("question"))


_QROWS = f"""qr AS (SELECT CAST(conv_id % 5 AS VARCHAR) AS dataset_id, conv_id * 1000 + turn * 10 + k AS seq, {S.question_norm("text || CASE k WHEN 1 THEN ' again' WHEN 2 THEN ' why' ELSE '' END")} AS n
  FROM (SELECT *, unnest(CASE WHEN turn % 3 = 0 THEN [0, 1, 2] ELSE [0] END) AS k FROM conversations WHERE role = 'user')),
qs AS (SELECT dataset_id, seq, list_distinct(list_filter(string_split(n, ' '), lambda w: w <> '')) AS t FROM qr WHERE n <> ''),
qf AS (SELECT dataset_id, list_sort(t) AS t, min(seq) AS id FROM qs GROUP BY ALL),
pairs AS (SELECT a.dataset_id, a.id AS early, b.id AS late, len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t))) AS similarity
  FROM qf a JOIN qf b ON a.dataset_id = b.dataset_id AND a.id < b.id)"""


@register("j17_f48_similar_questions", f"WITH {_QROWS} SELECT dataset_id, early, late, round(similarity, 6) AS similarity FROM pairs WHERE similarity >= 0.82 - 1e-12")
def j17(spark, d):
    sets = cut(Q._token_sets(question_rows(spark, d), ["dataset_id", "seq"], "question").groupBy("dataset_id", "tokens").agg(F.min("seq").alias("id")))
    return Q.similar_sets(sets, sets).filter("l_id < r_id").select(
        "dataset_id", F.col("l_id").alias("early"), F.col("r_id").alias("late"), F.round("similarity", 6).alias("similarity"))


_KEPT = f"""{_QROWS}, cand AS (SELECT dataset_id, id, row_number() OVER (PARTITION BY dataset_id ORDER BY id) AS k FROM qf),
conf AS (SELECT dataset_id, late AS id, list(early) AS c FROM pairs WHERE similarity >= {Q.SAME_QUESTION} GROUP BY 1, 2),
step AS (SELECT dataset_id, k, id, c FROM cand LEFT JOIN conf USING (dataset_id, id)),
kept AS (SELECT DISTINCT dataset_id, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS acc FROM cand
  UNION ALL SELECT r.dataset_id, s.k, CASE WHEN s.c IS NOT NULL AND list_has_any(r.acc, s.c) THEN r.acc ELSE list_append(r.acc, s.id) END FROM kept r JOIN step s ON s.dataset_id = r.dataset_id AND s.k = r.k + 1)
SELECT dataset_id, unnest(acc) AS seq FROM (SELECT dataset_id, arg_max(acc, k) AS acc FROM kept GROUP BY 1)"""


@register("j18_keep_first_questions", f"WITH RECURSIVE {_KEPT}")
def j18(spark, d):
    return Q.keep_first(question_rows(spark, d)).select("dataset_id", "seq")


@register("w09_recent_questions", """
SELECT dataset_id, seq, age FROM (SELECT dataset_id, seq, row_number() OVER (PARTITION BY dataset_id ORDER BY seq DESC) AS age FROM qr WHERE n <> '') WHERE age <= 8""".replace("SELECT dataset_id, seq, age", f"WITH {_QROWS} SELECT dataset_id, seq, age", 1))
def w09(spark, d):
    return Q.recent_questions(question_rows(spark, d)).select("dataset_id", "seq", "age")


_ASKED_PART = "CASE p_size % 6 WHEN 0 THEN 'What did Mr ' || p_name || ' say' WHEN 1 THEN 'What did the thing ' || p_name || ' do' WHEN 2 THEN 'What is ' || p_name || ' good for' WHEN 3 THEN 'What does it do with ' || p_name || ' today' WHEN 4 THEN 'Who feels what happened ' || p_name ELSE 'How is the ' || p_name || ' made here?' END"


@register("p09_p11_question_filters", rf"""
SELECT p_partkey, (n = '' OR regexp_full_match(n, 'what did (?:(?:mr|mrs|ms|miss|dr) )?[a-z]+(?: [a-z]+)? (?:say|ask|reply|return|cry|shout|whisper)')
  OR {_any("' ' || n || ' '", [f' {w} ' for w in LI.VAGUE_SUBJECTS])} OR (starts_with(n, 'what did the ') AND {_any("' ' || n || ' '", [f' {w} ' for w in LI.VAGUE_OBJECTS])})
  OR regexp_matches(n, ' (to|for|with|about)$') OR {_any('n', LI.VAGUE_PHRASES)}) AS low_precision,
  {"(" + " OR ".join(f"starts_with(l, {S.lit(p)})" for p in LI.PRONOUN_LEADS) + ")"} AS pronoun
FROM (SELECT p_partkey, {S.question_norm(_ASKED_PART)} AS n, lower({_ASKED_PART}) AS l FROM part)""")
def p09(spark, d):
    q = F.expr(_ASKED_PART)
    return S.table(spark, d, "part").select("p_partkey", Q.is_low_precision(q).alias("low_precision"), Q.has_pronoun_lead(q).alias("pronoun"))


@register("p10_answer_filter", rf"""
SELECT conv_id, turn, n = '' OR len(string_split(n, ' ')) < 4 OR length(text) > 200 OR length(text) - length(regexp_replace(text, '[.?!]', '', 'g')) > 1
  OR regexp_matches(lower(text), '^(and|but|or|so|then) ') AS low FROM (SELECT conv_id, turn, text, {S.question_norm('text')} AS n FROM conversations)""")
def p10(spark, d):
    return S.table(spark, d, "conversations").select("conv_id", "turn", Q.is_low_quality_answer(F.lit("why so"), "text").alias("low"))


@register("u06_pruned_history", f"WITH {_QROWS} SELECT dataset_id, seq FROM qr WHERE NOT contains(n, 'again')")
def u06(spark, d):
    return Q.pruned(question_rows(spark, d), T.question_norm("question").contains("again")).select("dataset_id", "seq")


# -- grading --------------------------------------------------------------------------------------

def attempts(spark, d):
    """Five answers to each benchmark passage: same, lower-cased, first half, shuffled, the next passage."""
    b = S.table(spark, d, "benchmark")
    w = F.split("text", " ")
    nxt = b.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("other"))
    rows = b.join(nxt, "item_id", "left").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(4))))
    given = (F.when(F.col("k") == 0, F.col("text")).when(F.col("k") == 1, F.lower("text"))
             .when(F.col("k") == 2, F.array_join(F.slice(w, F.lit(1), F.ceil(F.size(w) / 2).cast("int")), " "))
             .when(F.col("k") == 3, F.array_join(F.reverse(w), " ")).otherwise(F.coalesce("other", F.lit(""))))
    return rows.select((F.col("item_id") * 5 + F.col("k")).alias("attempt_id"), F.concat(F.lit("What is said about "), "text").alias("question"),
                       F.col("text").alias("model_answer"), given.alias("user_answer"), "item_id")


def sql_content_terms(x: str) -> str:
    norm = S.sq(rf"regexp_replace(regexp_replace(lower({x}), '([.!?;:,])([^\s])', '\1 \2', 'g'), '[^a-z0-9\s]', ' ', 'g')")
    stem = ("CASE WHEN length(t) > 4 AND ends_with(t, 'ies') THEN substr(t, 1, length(t) - 3) || 'y' WHEN length(t) > 4 AND ends_with(t, 'es') AND NOT ends_with(t, 'ses') "
            "THEN substr(t, 1, length(t) - 2) WHEN length(t) > 4 AND ends_with(t, 's') AND NOT ends_with(t, 'ss') THEN substr(t, 1, length(t) - 1) ELSE t END")
    over = f"CASE ({stem}) WHEN 'maybe' THEN 'perhaps' WHEN 'wi' THEN 'with' ELSE ({stem}) END"
    return (f"list_distinct(list_filter(list_transform(string_split({norm}, ' '), lambda t: {over}), lambda t: length(t) > 1 AND NOT list_contains({S.arr(LI.GRADING_STOPWORDS)}, t)))")


@register("f10_content_terms", f"SELECT doc_id, array_to_string(list_sort({sql_content_terms('text')}), ' ') AS terms FROM documents")
def f10(spark, d):
    return S.table(spark, d, "documents").select("doc_id", F.array_join(F.array_sort(T.content_terms("text")), " ").alias("terms"))


_ATTEMPTS = """att AS (SELECT item_id * 5 + k AS attempt_id, text AS reference, item_id, CASE k WHEN 0 THEN text WHEN 1 THEN lower(text)
  WHEN 2 THEN array_to_string(string_split(text, ' ')[1:CAST(ceil(len(string_split(text, ' ')) / 2) AS INTEGER)], ' ')
  WHEN 3 THEN array_to_string(list_reverse(string_split(text, ' ')), ' ') ELSE coalesce(other, '') END AS given
  FROM (SELECT b.*, o.text AS other, unnest([0, 1, 2, 3, 4]) AS k FROM benchmark b LEFT JOIN benchmark o ON o.item_id = b.item_id + 1))"""


@register("f49_support_measures", f"""
WITH {_ATTEMPTS}, t AS (SELECT attempt_id, {sql_content_terms('given')} AS u, {sql_content_terms('reference')} AS r, {sql_content_terms('d.text')} AS c FROM att JOIN documents d ON d.doc_id = att.item_id),
e AS (SELECT *, list_filter(u, lambda x: NOT list_contains(r, x)) AS x FROM t)
SELECT attempt_id, round(len(list_intersect(u, r)) / greatest(len(u), 1), 6) AS precision, round(len(list_intersect(u, r)) / greatest(len(r), 1), 6) AS recall,
  round(len(list_intersect(u, list_concat(c, r))) / greatest(len(u), 1), 6) AS context_support,
  round(CASE WHEN len(u) = 0 THEN 0 WHEN len(x) = 0 THEN 1 ELSE len(list_intersect(x, c)) / len(x) END, 6) AS extra_support,
  round(CASE WHEN len(u) = 0 THEN 1 WHEN len(x) = 0 THEN 0 ELSE len(list_filter(x, lambda y: NOT list_contains(c, y))) / len(u) END, 6) AS unsupported FROM e""")
def f49(spark, d):
    docs = S.table(spark, d, "documents").select(F.col("doc_id").alias("item_id"), T.content_terms("text").alias("c"))
    m = attempts(spark, d).join(docs, "item_id").select("attempt_id", G.support_measures(
        T.content_terms("user_answer"), T.content_terms("model_answer"), F.col("c")).alias("m"))
    return m.select("attempt_id", *[F.round(F.col("m")[k], 6).alias(k) for k in ("precision", "recall", "context_support", "extra_support", "unsupported")])


def item_chunks(spark, d, c):
    """All chunk ids of each item's document, in order; a copy has those of the stored first copy."""
    docs = S.table(spark, d, "documents").select(F.col("doc_id").alias("item_id"), F.sha2(F.encode("text", "UTF-8"), 256).alias("source_sha256"))
    ids = F.array_sort(F.collect_list(F.struct("chunk_index", "chunk_id")))
    return S.table(spark, d, "benchmark").select("item_id").join(docs, "item_id").join(c.select("source_sha256", "chunk_index", "chunk_id"), "source_sha256").groupBy(
        "item_id").agg(F.transform(ids, lambda x: x["chunk_id"]).alias("source_chunk_ids"))


def _graded(spark, d, responses=None):
    """Every attempt, with its whole document as evidence; one whose document has no chunk, with what its question retrieves."""
    c = S.stored_chunks(spark, d)
    a = cut(attempts(spark, d).join(item_chunks(spark, d, c), "item_id", "left"))
    return G.grade(a, G.grading_contexts(a, c), responses)


def _embedded(name, source):
    """CTE name: key and x, the offline embedding of the texts of ``source`` (key, text)."""
    tokens = S.search_tokens(S.search_norm("text"))
    return f"""{name}_t AS (SELECT key, unnest(list_distinct({tokens})) AS term FROM (SELECT key, text, {S.search_norm('text')} AS norm FROM {source})),
{name}_c AS (SELECT key, CAST('0x' || substr(md5(term), 1, 4) AS INTEGER) % 64 AS b, count(*) AS c FROM {name}_t GROUP BY ALL),
{name} AS (SELECT key, b, c / sqrt(sum(c * c) OVER (PARTITION BY key)) AS x FROM {name}_c)"""


_LINES = r"list_filter(list_transform(regexp_split_to_array(d.text, '\r\n|\r|\n'), lambda s: " + S.strip("s") + "), lambda s: s <> '')"


@register("m18_answer_similarities", f"""
WITH {_ATTEMPTS}, docs AS (SELECT b.item_id, b.text AS reference, unnest(list_distinct({S.sentences("array_to_string(" + _LINES + ", ' ')", 20)})) AS sentence FROM benchmark b JOIN documents d ON d.doc_id = b.item_id),
marked AS (SELECT item_id, sentence, round(len(list_intersect({sql_content_terms("'What is said here?'")}, {sql_content_terms('sentence')})) * 1.35 + len(list_intersect({sql_content_terms('reference')}, {sql_content_terms('sentence')})) * 1.1, 6) AS score FROM docs),
best AS (SELECT item_id, sentence FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, sentence DESC) AS r FROM marked WHERE score > 0) WHERE r <= 3),
texts AS (SELECT DISTINCT text AS key, text FROM (SELECT {S.sq('given')} AS text FROM att UNION ALL SELECT reference FROM att UNION ALL SELECT sentence FROM best)),
{_embedded('v', 'texts')},
said AS (SELECT attempt_id, item_id, {S.sq('given')} AS answer, reference FROM att WHERE {S.sq('given')} <> ''),
pairs AS (SELECT attempt_id, 0 AS kind, answer AS a, reference AS b FROM said UNION ALL SELECT attempt_id, 1, answer, sentence FROM said JOIN best USING (item_id) UNION ALL SELECT attempt_id, 2, reference, sentence FROM said JOIN best USING (item_id)),
dots AS (SELECT attempt_id, kind, p.a, p.b, coalesce(sum(l.x * r.x), 0) AS dot FROM pairs p LEFT JOIN v l ON l.key = p.a LEFT JOIN v r ON r.key = p.b AND r.b = l.b GROUP BY ALL)
SELECT attempt_id, coalesce(round(max(dot) FILTER (kind = 0), 6), 0) AS similarity, coalesce(round(max(dot) FILTER (kind = 1), 6), 0) AS evidence_similarity, coalesce(round(max(dot) FILTER (kind = 2), 6), 0) AS reference_similarity
FROM att LEFT JOIN dots USING (attempt_id) WHERE item_id IN (SELECT doc_id FROM documents) GROUP BY 1""")
def m18s(spark, d):
    """Cosines of answers, references and best evidence, with the item's document as context."""
    docs = S.table(spark, d, "documents").select(F.col("doc_id").alias("item_id"), F.col("text").alias("context"))
    a = attempts(spark, d).join(docs, "item_id").withColumn("question", F.lit("What is said here?"))
    out = G.grade(a.drop("context"), a.select("attempt_id", "context"))
    return out.select("attempt_id", *[F.round(c, 6).alias(c) for c in ("similarity", "evidence_similarity", "reference_similarity")])


@register("m30_prompts", f"""
WITH {_ATTEMPTS} SELECT 'grading' AS kind, attempt_id AS id, 'Question: What is said?' || chr(10) || chr(10) || 'Context:' || chr(10) || d.text || chr(10) || chr(10) || 'Reference answer: ' || reference
  || chr(10) || chr(10) || 'Student''s answer: ' || given AS prompt FROM att JOIN documents d ON d.doc_id = att.item_id
UNION ALL SELECT 'retry', item_id, 'Question: ' || b.text || chr(10) || chr(10) || 'Excerpts:' || chr(10) || d.text || chr(10) || chr(10) || 'Answer in one or two sentences.' FROM benchmark b JOIN documents d ON d.doc_id = b.item_id WHERE item_id % 2 = 0
UNION ALL SELECT 'question', doc_id, 'Asked before:' || chr(10) || CASE WHEN source = 'src1' THEN '- Why?' || chr(10) || '- Who?' ELSE '- none' END || chr(10) || chr(10) || 'Passage:' || chr(10) || '[chunk_id=' || doc_id || ' | source=' || source || ']' || chr(10) || text FROM documents""")
def m30(spark, d):
    docs = S.table(spark, d, "documents")
    texts = docs.select(F.col("doc_id").alias("item_id"), F.col("text").alias("context"))
    a = attempts(spark, d).join(texts, "item_id").withColumn("question", F.lit("What is said?"))
    grading = P.grading_prompts(a.drop("context"), a.select("attempt_id", "context"))
    b = S.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    parsed = A.parse_responses(b.select("query_id", F.when(F.pmod("query_id", F.lit(2)) == 0, "No JSON at all here.").otherwise('{"status":"supported","answer":"Yes indeed.","evidence_ids":[]}').alias("raw_text")))
    retry = P.retry_prompts(b, texts.withColumnRenamed("item_id", "query_id"), parsed)
    recent = spark.createDataFrame([("src1", "Who?", 2), ("src1", "Why?", 1)], "dataset_id string, question string, age int")
    chunks = docs.select(F.col("source").alias("dataset_id"), F.col("doc_id").alias("chunk_id"), F.col("source").alias("source_name"), F.col("text").alias("content"))
    made = P.question_prompts(chunks, recent)
    shown = lambda kind, rows: rows.select(F.lit(kind).alias("kind"), F.col("query_id").cast("long").alias("id"), "prompt")
    return shown("grading", grading).unionByName(shown("retry", retry)).unionByName(shown("question", made))


@register("m15_m18_j15_graded_answers")
def m18(spark, d):
    return _graded(spark, d).select("attempt_id", "score", "feedback", "floor")


@register("m18_graded_with_responses")
def m18b(spark, d):
    given = attempts(spark, d).select("attempt_id", F.pmod("attempt_id", F.lit(11)).alias("score"), F.lit("Model feedback.").alias("feedback"))
    return _graded(spark, d, given).select("attempt_id", "score", "feedback")


@register("m18_identical_answers", f"""
WITH {S.CHUNKS}, {_ATTEMPTS} SELECT attempt_id, 10 AS score, {S.lit(LI.RUBRIC[10])} AS feedback FROM att WHERE attempt_id % 5 < 2
  AND item_id IN (SELECT doc_id FROM src JOIN chunks ON source_name = name WHERE chunk_index = 0)""")
def m18c(spark, d):
    """Attempts on items whose own document is stored, as the SQL has it; the next query has all."""
    stored = S.chunks(spark, d).filter("chunk_index = 0").select(F.substring_index("source_name", "-", -1).cast("long").alias("item_id"))
    return m18d(spark, d).withColumn("item_id", F.expr("attempt_id div 5")).join(stored, "item_id", "left_semi").select("attempt_id", "score", "feedback")


@register("m18_all_identical_answers", f"""
WITH {_ATTEMPTS} SELECT attempt_id, 10 AS score, {S.lit(LI.RUBRIC[10])} AS feedback FROM att WHERE attempt_id % 5 < 2""")
def m18d(spark, d):
    return _graded(spark, d).filter("attempt_id % 5 < 2").select("attempt_id", "score", "feedback")


# line items as measures: every branch of the decision tables gets rows
def _measures(spark, d):
    x = lambda c, k: F.round(F.pmod(F.col(c) * k, F.lit(101)) / 100.0, 2)
    return S.table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.struct(x("l_partkey", 7).alias("precision"), x("l_partkey", 3).alias("recall"),
                                               x("l_suppkey", 11).alias("context_support")).alias("m"),
        x("l_orderkey", 13).alias("ratio"), x("l_orderkey", 5).alias("sim"), x("l_orderkey", 17).alias("ev"))


_MEAS = """meas AS (SELECT l_orderkey, l_linenumber, round(l_partkey * 7 % 101 / 100.0, 2) AS p, round(l_partkey * 3 % 101 / 100.0, 2) AS r, round(l_suppkey * 11 % 101 / 100.0, 2) AS c,
  round(l_orderkey * 13 % 101 / 100.0, 2) AS ratio, round(l_orderkey * 5 % 101 / 100.0, 2) AS sim, round(l_orderkey * 17 % 101 / 100.0, 2) AS ev FROM lineitem)"""


@register("m16_grade_floors", f"""
WITH {_MEAS} SELECT l_orderkey, l_linenumber, CASE WHEN r >= 0.95 AND p >= 0.84 AND c >= 0.72 THEN CASE WHEN ratio >= 0.9 OR sim >= 0.96 THEN 10 ELSE 9 END
  WHEN sim >= 0.95 AND r >= 0.72 AND p >= 0.5 AND c >= 0.5 THEN 9 WHEN r >= 0.72 AND p >= 0.55 AND c >= 0.68 THEN 8 WHEN sim >= 0.9 AND r >= 0.58 AND p >= 0.42 AND c >= 0.45 THEN 8
  WHEN sim >= 0.84 AND r >= 0.48 AND p >= 0.32 AND c >= 0.35 THEN 7 WHEN r >= 0.55 AND c >= 0.4 THEN 6 WHEN r >= 0.4 AND c >= 0.3 THEN 5 ELSE 0 END AS heuristic,
  CASE WHEN s >= 0.96 AND c >= 0.58 THEN CASE WHEN r >= 0.5 OR ratio >= 0.78 THEN 10 ELSE 9 END WHEN s >= 0.96 AND r >= 0.45 THEN CASE WHEN c >= 0.3 THEN 8 ELSE 7 END
  WHEN s >= 0.92 AND c >= 0.5 THEN 9 WHEN s >= 0.88 AND c >= 0.42 THEN CASE WHEN r >= 0.24 OR p >= 0.2 OR ratio >= 0.5 THEN 8 ELSE 7 END WHEN s >= 0.82 AND c >= 0.35 THEN 7
  WHEN s >= 0.76 AND c >= 0.3 THEN 6 WHEN s >= 0.68 AND c >= 0.24 THEN 5 ELSE 0 END AS semantic FROM (SELECT *, greatest(sim, ev) AS s FROM meas)""")
def m16(spark, d):
    m = _measures(spark, d)
    return m.select("l_orderkey", "l_linenumber", G.heuristic_floor(F.col("m"), F.col("ratio"), F.col("sim")).alias("heuristic"),
                    G.semantic_floor(F.col("m"), F.col("ratio"), F.col("sim"), F.col("ev")).alias("semantic"))


@register("m19_similarity_scores", f"""
WITH {_MEAS} SELECT l_orderkey, l_linenumber, round(b, 6) AS blended, CASE WHEN b >= 0.97 THEN 10 WHEN b >= 0.93 THEN 9 WHEN b >= 0.89 THEN 8 WHEN b >= 0.84 THEN 7 WHEN b >= 0.76 THEN 6
  WHEN b >= 0.68 THEN 5 WHEN b >= 0.59 THEN 4 WHEN b >= 0.50 THEN 3 WHEN b >= 0.40 THEN 2 WHEN b > 0 THEN 1 ELSE 0 END AS score
FROM (SELECT *, greatest(CAST(sim AS DOUBLE), CAST(ev AS DOUBLE) / 2, sim * 0.55::DOUBLE + c * 0.25::DOUBLE + r * 0.2::DOUBLE) AS b FROM meas)""")
def m19(spark, d):
    m = _measures(spark, d).withColumn("b", G.blended_similarity(F.col("sim"), F.col("ev") / 2, F.col("m.context_support"), F.col("m.recall")))
    return m.select("l_orderkey", "l_linenumber", F.round("b", 6).alias("blended"), G.similarity_score("b").alias("score"))

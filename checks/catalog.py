"""Relational queries and streams. Customers stand for sessions, orders for corpora, line items for the bridge."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from checks import tables as S
from checks.learning import _KEPT, question_rows
from checks.pages import ASKS, sql_policy
from foliant.functions import text as T
from foliant.operators import catalog as K
from foliant.plans.sizing import spread
from foliant.session import cut
from foliant.sources import text_files as X
from foliant.streaming import jobs as J

QUERIES: dict = {}
ORACLES: dict = {}


def register(name: str, sql: str | None = None):
    def add(run):
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run
    return add


def corpora(spark, d):
    return S.table(spark, d, "orders").select(F.col("o_orderkey").alias("corpus_id"), F.col("o_custkey").alias("session_id"),
                                              F.col("o_orderpriority").alias("dataset_label"), F.col("o_orderdate").alias("created_at"))


def bridge(spark, d):
    return S.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("corpus_id"), F.col("l_partkey").alias("document_id")).distinct()


def documents(spark, d):
    return S.table(spark, d, "part").select(F.col("p_partkey").alias("document_id"), "p_name", "p_size", "p_brand")


def sessions(spark, d):
    return S.table(spark, d, "customer").select(F.col("c_custkey").alias("session_id"), F.col("c_nationkey").alias("user_id"),
                                                (F.col("c_custkey") * 7).alias("active_corpus_id"), (F.col("c_mktsegment") == "BUILDING").alias("is_library"))


def gone(spark, d):
    return documents(spark, d).filter("p_size = 7").select("document_id")


_HIT = "hit AS (SELECT DISTINCT l_orderkey AS corpus_id FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size = 7)"


@register("j01_corpora_of_documents", f"WITH {_HIT} SELECT o_orderkey AS corpus_id FROM orders JOIN hit ON o_orderkey = corpus_id")
def j01(spark, d):
    return K.corpora_of_document(corpora(spark, d), bridge(spark, d), gone(spark, d)).select("corpus_id")


@register("j02_by_ids", "SELECT p_partkey AS document_id, p_name FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def j02(spark, d):
    ids = S.table(spark, d, "lineitem").filter("l_quantity > 45").select(F.col("l_partkey").alias("document_id"))
    return K.by_ids(documents(spark, d), ids, "document_id").select("document_id", "p_name")


@register("j03_active_labels", "SELECT c_custkey AS session_id, o_orderpriority AS active_corpus_label FROM customer LEFT JOIN orders ON o_orderkey = c_custkey * 7")
def j03(spark, d):
    return K.with_active_label(sessions(spark, d), corpora(spark, d)).select("session_id", "active_corpus_label")


@register("j04_active_flags", "SELECT p_partkey AS document_id, p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_orderkey % 10 = 1) AS is_active FROM part")
def j04(spark, d):
    return K.with_active_flag(documents(spark, d), bridge(spark, d).filter("corpus_id % 10 = 1")).select("document_id", "is_active")


@register("j05_complete_requests", """
SELECT request_id, count(*) AS asked, count(p_partkey) AS matched, count(*) = count(p_partkey) AS complete FROM (
  SELECT DISTINCT l_orderkey AS request_id, l_partkey FROM lineitem) LEFT JOIN (SELECT p_partkey FROM part WHERE p_size <> 3) ON p_partkey = l_partkey GROUP BY 1""")
def j05(spark, d):
    return K.requests_complete(bridge(spark, d).withColumnRenamed("corpus_id", "request_id"), documents(spark, d).filter("p_size <> 3"))


def _tables(spark, d):
    q = corpora(spark, d).select((F.col("corpus_id") * 10).alias("question_id"), "corpus_id", "session_id")
    return {"sessions": sessions(spark, d), "corpora": corpora(spark, d), "corpus_documents": bridge(spark, d), "documents": documents(spark, d),
            "questions": q, "attempts": q.select((F.col("question_id") + 1).alias("attempt_id"), "question_id", "session_id")}


@register("j07_document_cascade", f"""
WITH {_HIT}, b AS (SELECT DISTINCT l_orderkey AS corpus_id, l_partkey FROM lineitem)
SELECT 'corpora' AS name, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS s FROM orders WHERE o_orderkey NOT IN (SELECT corpus_id FROM hit)
UNION ALL SELECT 'questions', count(*), CAST(sum(o_orderkey * 10) AS BIGINT) FROM orders WHERE o_orderkey NOT IN (SELECT corpus_id FROM hit)
UNION ALL SELECT 'attempts', count(*), CAST(sum(o_orderkey * 10 + 1) AS BIGINT) FROM orders WHERE o_orderkey NOT IN (SELECT corpus_id FROM hit)
UNION ALL SELECT 'corpus_documents', count(*), CAST(sum(corpus_id) AS BIGINT) FROM b WHERE corpus_id NOT IN (SELECT corpus_id FROM hit)
UNION ALL SELECT 'documents', count(*), CAST(sum(p_partkey) AS BIGINT) FROM part WHERE p_size <> 7
UNION ALL SELECT 'sessions', count(CASE WHEN c_custkey * 7 NOT IN (SELECT corpus_id FROM hit) THEN 1 END), CAST(sum(c_custkey) AS BIGINT) FROM customer""")
def j07(spark, d):
    left = K.delete_documents(_tables(spark, d), gone(spark, d))
    keys = {"corpora": "corpus_id", "questions": "question_id", "attempts": "attempt_id", "corpus_documents": "corpus_id", "documents": "document_id"}
    out = left["sessions"].agg(F.lit("sessions").alias("name"), F.count("active_corpus_id").alias("n"), F.sum("session_id").alias("s"))
    for name, key in keys.items():
        out = out.unionByName(left[name].agg(F.lit(name).alias("name"), F.count("*").alias("n"), F.sum(key).alias("s")))
    return out


@register("j07_session_cascade", """
WITH gone AS (SELECT c_custkey FROM customer WHERE c_acctbal < 0), b AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)
SELECT 'corpora' AS name, count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM gone)
UNION ALL SELECT 'sessions', count(*) FROM customer WHERE c_acctbal >= 0
UNION ALL SELECT 'corpus_documents', count(*) FROM b WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM gone))""")
def j07b(spark, d):
    ids = S.table(spark, d, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("session_id"))
    left = K.delete_sessions(_tables(spark, d), ids)
    out = None
    for name in ("corpora", "sessions", "corpus_documents"):
        part = left[name].agg(F.lit(name).alias("name"), F.count("*").alias("n"))
        out = part if out is None else out.unionByName(part)
    return out


@register("j08_reset_references", f"""
WITH {_HIT} SELECT c_custkey AS session_id, CASE WHEN c_custkey * 7 IN (SELECT corpus_id FROM hit) THEN NULL ELSE c_custkey * 7 END AS active_corpus_id FROM customer""")
def j08(spark, d):
    hit = K.corpora_of_document(corpora(spark, d), bridge(spark, d), gone(spark, d))
    return K.reset_references(sessions(spark, d), hit, "active_corpus_id", "corpus_id").select("session_id", "active_corpus_id")


@register("j20_missing_libraries", """
SELECT '__document_library__:' || n_nationkey AS session_id, n_nationkey AS user_id, 'Document Library' AS title, true AS is_library FROM nation
WHERE n_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 9000)""")
def j20(spark, d):
    users = S.table(spark, d, "nation").select(F.col("n_nationkey").alias("user_id"))
    have = S.table(spark, d, "customer").filter("c_acctbal > 9000").select(F.col("c_nationkey").alias("user_id"), (F.col("c_mktsegment") == "BUILDING").alias("is_library"))
    return K.missing_libraries(users, have)


@register("p22_visible_sessions", "SELECT c_custkey AS session_id FROM customer WHERE c_nationkey = 3 AND c_mktsegment <> 'BUILDING'")
def p22(spark, d):
    return sessions(spark, d).filter((F.col("user_id") == 3) & ~F.col("is_library")).select("session_id")


@register("p23_unexpired", "SELECT event_id FROM events WHERE ts + INTERVAL 7 DAY > TIMESTAMP '2024-01-20 00:00:00'")
def p23(spark, d):
    tokens = S.table(spark, d, "events").select("event_id", (F.col("ts") + F.expr("INTERVAL 7 DAYS")).alias("expires_at"))
    return K.unexpired(tokens, F.lit("2024-01-20 00:00:00").cast("timestamp")).select("event_id")


@register("a10_selection_totals", """
SELECT count(*) FILTER (n > 0) AS ready_count, CAST(sum(coalesce(n, 0)) AS BIGINT) AS chunk_total, CAST(sum(p_size) AS BIGINT) AS byte_total
FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem WHERE l_discount > 0.08 GROUP BY 1) ON l_partkey = p_partkey""")
def a10(spark, d):
    n = S.table(spark, d, "lineitem").filter("l_discount > 0.08").groupBy(F.col("l_partkey").alias("document_id")).agg(F.count("*").alias("chunk_count"))
    return K.selection_totals(documents(spark, d).join(n, "document_id", "left").select(
        (F.coalesce("chunk_count", F.lit(0)) > 0).alias("ready"), "chunk_count", F.col("p_size").cast("long").alias("size_bytes")))


@register("a11_latest_attempts", """
SELECT o_custkey AS question_id, o_orderkey AS attempt_id, o_orderdate AS created_at FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1""")
def a11(spark, d):
    a = S.table(spark, d, "orders").select(F.col("o_custkey").alias("question_id"), F.col("o_orderkey").alias("attempt_id"), F.col("o_orderdate").alias("created_at"))
    return K.latest_attempts(a)


@register("a12_row_count", "SELECT count(*) AS users, count(*) = 0 AS first_user FROM customer")
def a12(spark, d):
    return S.table(spark, d, "customer").agg(F.count("*").alias("users"), (F.count("*") == 0).alias("first_user"))


@register("a16_throughput", """
SELECT user_id AS session_id, tokens, reasoning_tokens, elapsed AS elapsed_seconds, round(tokens / elapsed, 6) AS tokens_per_second FROM (
  SELECT user_id, count(*) FILTER (event_type = 'click') AS tokens, count(*) FILTER (event_type = 'view') AS reasoning_tokens,
    round(greatest(0.001, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6), 3) AS elapsed FROM events GROUP BY 1)""")
def a16(spark, d):
    return K.throughput(stream_events(S.table(spark, d, "events")))


@register("a17_corpus_details", """
SELECT o_orderkey AS corpus_id, o_orderpriority AS dataset_label, l_partkey AS document_id FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) ON l_orderkey = o_orderkey""")
def a17(spark, d):
    return K.corpus_details(corpora(spark, d), bridge(spark, d)).select("corpus_id", "dataset_label", "document_id")


@register("t08_recent_sessions", "SELECT o_orderkey AS session_id, o_orderdate AS updated_at FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 20")
def t08(spark, d):
    s = S.table(spark, d, "orders").select(F.col("o_orderkey").alias("session_id"), F.col("o_orderdate").alias("updated_at"), F.col("o_orderdate").alias("created_at"))
    return K.recent_sessions(s).select("session_id", "updated_at")


@register("t09_ordered_listing", "SELECT conv_id, turn, role FROM conversations ORDER BY conv_id, turn")
def t09(spark, d):
    return S.table(spark, d, "conversations").select("conv_id", "turn", "role").orderBy("conv_id", "turn")


@register("u03_same_paths", """
WITH a AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem), b AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_returnflag <> 'R')
SELECT l_orderkey AS corpus_id, bool_and(b.l_partkey IS NOT NULL) AS same FROM a LEFT JOIN b USING (l_orderkey, l_partkey) GROUP BY 1""")
def u03(spark, d):
    li = S.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("corpus_id"), F.col("l_partkey").alias("path"), "l_returnflag")
    return K.same_paths(li, li.filter("l_returnflag <> 'R'"))


@register("u04_disjoint", """
SELECT a.conv_id, a.turn, NOT list_has_any(string_split(a.text, ' '), string_split(b.text, ' ')) AS apart FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1""")
def u04(spark, d):
    c = S.table(spark, d, "conversations").select("conv_id", "turn", F.split("text", " ").alias("a"))
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("a").alias("b"))
    return c.join(nxt, ["conv_id", "turn"]).select("conv_id", "turn", (~F.arrays_overlap("a", "b")).alias("apart"))


@register("f16_mail_and_names", """
SELECT c_custkey, lower(trim(mail)) AS email, contains(mail, '@') AND NOT starts_with(trim(mail), '@') AS valid, initials FROM (
  SELECT c_custkey, ' ' || replace(c_name, '#', CASE WHEN c_custkey % 5 = 0 THEN '.' ELSE '@' END) || ' ' AS mail,
    upper(substr(c_name, 1, 1)) || upper(substr(c_mktsegment, 1, 1)) AS initials FROM customer)""")
def f16(spark, d):
    mail = F.concat(F.lit(" "), F.replace("c_name", F.lit("#"), F.when(F.pmod("c_custkey", F.lit(5)) == 0, ".").otherwise("@")), F.lit(" "))
    return S.table(spark, d, "customer").select("c_custkey", T.email_norm(mail).alias("email"), T.email_valid(mail).alias("valid"),
                                                T.initials(F.concat_ws(" ", "c_name", F.lower("c_mktsegment"))).alias("initials"))


@register("m26_four_event_kinds", f"""
WITH {sql_policy()},
questions AS (SELECT b.item_id, 'q' || b.item_id AS question_id, b.text AS answer, d.source, d.doc_id FROM benchmark b JOIN documents d ON d.doc_id = b.item_id),
asked_rows AS (SELECT 'user_question' AS event_type, item_id AS k, source AS names, answer AS user_question, NULL AS generated_question, answer AS model_answer, NULL AS user_answer, NULL AS score, NULL AS question_id, NULL AS security_stage, NULL AS categories FROM questions),
made_rows AS (SELECT 'generated_question', item_id, source, NULL, 'What is said in ' || question_id || '?', answer, NULL, NULL, question_id, NULL, NULL FROM questions),
graded_rows AS (SELECT 'graded_answer', item_id, source, NULL, 'What is said in ' || question_id || '?', answer, lower(answer), item_id % 11, question_id, NULL, NULL FROM questions),
blocked_rows AS (SELECT 'security_event', conv_id, '', NULL, NULL, NULL, NULL, NULL, NULL, 'user_query', trim(categories) FROM decided WHERE categories <> '')
SELECT * FROM asked_rows UNION ALL SELECT * FROM made_rows UNION ALL SELECT * FROM graded_rows UNION ALL SELECT * FROM blocked_rows""")
def m26(spark, d):
    """Audit rows of answered, made and graded questions about documents, and of blocked messages, as the log has them when read back."""
    b = S.table(spark, d, "benchmark").select("item_id", F.col("text").alias("answer"))
    docs = S.table(spark, d, "documents").select(F.col("doc_id").alias("item_id"), "source")
    at = F.timestamp_seconds(F.col("item_id"))
    base = b.join(docs, "item_id").select(
        "item_id", "answer", F.array("source").alias("source_names"), F.concat(F.lit("q"), F.col("item_id").cast("string")).alias("question_id"),
        F.col("item_id").cast("string").alias("session_id"), F.lit("d").alias("dataset_id"), F.array().cast("array<string>").alias("evidence_ids"))
    told = base.select("*", F.col("item_id").alias("query_id"), F.col("answer").alias("query"), F.col("item_id").alias("attempt_id"), F.concat(F.lit("What is said in "), F.col("question_id"), F.lit("?")).alias("question"),
                       F.col("answer").alias("model_answer"), F.col("evidence_ids").alias("source_chunk_ids"), at.alias("created_at"), F.lower("answer").alias("user_answer"),
                       F.pmod("item_id", F.lit(11)).cast("int").alias("score"), F.lit("Seen.").alias("feedback"))
    m = S.table(spark, d, "conversations")
    lead = F.element_at(F.array(*[F.lit(a) for a in ASKS]), (F.pmod(F.col("conv_id") * 7 + F.col("turn"), F.lit(len(ASKS))) + 1).cast("int"))
    tagged = J.tagged_messages(m.select(F.col("conv_id").cast("string").alias("session_id"), F.lit(None).cast("string").alias("dataset_id"), F.concat(lead, "text").alias("text"), F.timestamp_seconds("turn").alias("at")), "text")
    rows = [X.asked_rows(told, told.select("query_id", "query", "session_id", "dataset_id"), F.current_timestamp()), X.made_rows(told),
            X.graded_rows(told, told, told, F.current_timestamp()), X.security_rows(tagged, "user_query", F.col("at"), "text")]
    path = scratch(spark) + "/log"
    for part in rows:
        X.append_interactions(part, path)
    log = spark.read.schema(X.INTERACTION_SCHEMA).parquet(path)
    return log.select("event_type", F.col("session_id").cast("long").alias("k"), F.array_join("source_file_names", ",").alias("names"), "user_question", "generated_question", "model_answer",
                      "user_answer", "score", "question_id", "security_stage", F.array_join("security_categories", " ").alias("categories"))


@register("s04_s10_page_rows", """
SELECT source, doc_id AS page, lang AS section, text, CASE WHEN doc_id % 3 = 0 THEN 'Figure ' || doc_id END AS visual_text, doc_id % 3 = 0 AS has_visual_description FROM documents""")
def s04(spark, d):
    """Page rows written as JSON lines and read back."""
    seen = F.pmod("doc_id", F.lit(3)) == 0
    pages = S.table(spark, d, "documents").select("source", F.col("doc_id").cast("int").alias("page"), F.col("lang").alias("section"), "text",
                                                  F.when(seen, F.concat(F.lit("Figure "), F.col("doc_id").cast("string"))).alias("visual_text"), seen.alias("has_visual_description"))
    path = scratch(spark) + "/pages"
    X.write_pages(pages, path)
    return X.read_pages(spark, path).withColumn("page", F.col("page").cast("long"))


@register("s07_m26_interactions", """
SELECT event_type, session_id, score FROM (
  SELECT 'graded_answer' AS event_type, CAST(doc_id AS VARCHAR) AS session_id, quality * 10 AS score FROM labels
  UNION ALL SELECT 'user_question', conv_id || '', NULL FROM conversations WHERE role = 'user')""")
def s07(spark, d):
    graded = S.table(spark, d, "labels").select(F.lit("graded_answer").alias("event_type"), F.col("doc_id").alias("session_id"), (F.col("quality") * 10).alias("score"))
    asked = S.table(spark, d, "conversations").filter("role = 'user'").select(F.lit("user_question").alias("event_type"), F.col("conv_id").alias("session_id"), F.col("text").alias("user_question"))
    return X.interaction_rows(graded, asked).select("event_type", "session_id", "score")


# -- streams: files are processed by availableNow, results land in the shared folder ---------------

def stream_events(df):
    kinds = F.when(F.col("event_type") == "click", "token").when(F.col("event_type") == "view", "reasoning").otherwise(F.col("event_type"))
    return df.select(F.col("user_id").alias("session_id"), F.col("ts").cast("timestamp").alias("ts"), kinds.alias("kind"), "event_id")


def open_stream(spark, d, name):
    """A table as a stream, whether it is one file or a folder of files."""
    schema = S.table(spark, d, name).schema
    return spark.readStream.schema(schema).parquet(f"{d}/{name}.parque[t]")  # a pattern: a stream's plain path must be a folder


def scratch(spark):
    cut(spark.range(1))  # names the folder
    return os.path.join(spark.sparkContext.getCheckpointDir(), "streams-" + uuid.uuid4().hex)


def finished(spark, stream, mode="append"):
    """Run a stream over what is there and read back what it wrote."""
    base = scratch(spark)
    schema = stream.schema

    def write(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{base}/out/all" if mode == "complete" else f"{base}/out/{batch_id}")

    J.run_available(stream, write, f"{base}/state", mode)
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{base}/out")


@register("r01_streamed_ingest", "SELECT sha256, count(*) AS copies FROM (SELECT DISTINCT sha256(text) AS sha256 FROM documents) GROUP BY 1")
def r01(spark, d):
    files = open_stream(spark, d, "documents").select(F.concat("source", F.col("doc_id").cast("string")).alias("name"), F.lit("p").alias("path"), F.col("text").alias("content"))
    base = scratch(spark)
    J.run_available(J.ingest_stream(files), J.write_new_sources(f"{base}/sources"), f"{base}/state")
    return spark.read.parquet(f"{base}/sources").groupBy("sha256").agg(F.count("*").alias("copies"))


@register("r01_streamed_chunks")
def r01b(spark, d):
    base = scratch(spark)
    files = open_stream(spark, d, "documents").select(F.concat("source", F.col("doc_id").cast("string")).alias("name"), F.lit("p").alias("path"), F.col("text").alias("content"))
    J.run_available(J.ingest_stream(files), J.write_new_chunks(f"{base}/chunks"), f"{base}/state")
    return spark.read.parquet(f"{base}/chunks").select("chunk_id", "chunk_index")


@register("r02_streamed_policy", f"WITH {sql_policy()} SELECT conv_id, turn, categories <> '' AS blocked FROM decided")
def r02(spark, d):
    m = open_stream(spark, d, "conversations")
    lead = F.element_at(F.array(*[F.lit(a) for a in ASKS]), (F.pmod(F.col("conv_id") * 7 + F.col("turn"), F.lit(len(ASKS))) + 1).cast("int"))
    tagged = J.tagged_messages(m.withColumn("text", F.concat(lead, "text")), "text")
    return finished(spark, tagged.select("conv_id", "turn", F.col("decision.blocked").alias("blocked")))


@register("r03_streamed_throughput", """
SELECT user_id AS session_id, date_trunc('hour', ts) AS start, count(*) FILTER (event_type = 'click') AS tokens, round(count(*) FILTER (event_type = 'click') / 3600, 9) AS tokens_per_second FROM events GROUP BY 1, 2""")
def r03(spark, d):
    return finished(spark, J.throughput_windows(stream_events(open_stream(spark, d, "events"))), "complete").withColumn("tokens_per_second", F.round("tokens_per_second", 9))


@register("r06_streamed_activity", """
SELECT user_id AS session_id, date_trunc('day', ts) AS start, date_trunc('day', ts) + INTERVAL 1 DAY AS "end", count(*) AS events FROM events GROUP BY ALL""")
def r06(spark, d):
    return finished(spark, J.activity_windows(stream_events(open_stream(spark, d, "events"))), "complete")


@register("r06_sliding_activity", """
SELECT user_id AS session_id, s AS start, s + INTERVAL 1 DAY AS "end", count(*) AS events FROM (
  SELECT user_id, unnest([b, b - INTERVAL 6 HOUR, b - INTERVAL 12 HOUR, b - INTERVAL 18 HOUR]) AS s FROM (SELECT user_id, time_bucket(INTERVAL 6 HOUR, ts) AS b FROM events)) GROUP BY ALL""")
def r06b(spark, d):
    return J.activity_windows(stream_events(S.table(spark, d, "events")), "sliding")


@register("r06_session_activity", """
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
n AS (SELECT user_id, ts, sum(s) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
SELECT user_id AS session_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS events FROM n GROUP BY user_id, k""")
def r06c(spark, d):
    return J.activity_windows(stream_events(S.table(spark, d, "events")), "session")


def answer_events(df):
    """Each conversation as a token stream: every turn a token, some replaced, the last one done."""
    kind = F.when(F.col("turn") == F.col("last"), "done").when(F.pmod(F.col("conv_id") + F.col("turn"), F.lit(6)) == 5, "replace").otherwise("token")
    return df.select(F.col("conv_id").cast("string").alias("session_id"), F.timestamp_seconds(F.col("turn") + 1).alias("ts"), F.col("turn").alias("seq"),
                     kind.alias("kind"), F.col("text"))


@register("r04_assembled_answers", """
WITH e AS (SELECT CAST(conv_id AS VARCHAR) AS session_id, turn AS seq, text, CASE WHEN turn = max(turn) OVER (PARTITION BY conv_id) THEN 'done' WHEN (conv_id + turn) % 6 = 5 THEN 'replace' ELSE 'token' END AS kind FROM conversations),
c AS (SELECT session_id, max(seq) FILTER (kind = 'replace') AS cut_at FROM e GROUP BY 1)
SELECT session_id, coalesce(string_agg(text, '' ORDER BY seq) FILTER (kind <> 'done' AND seq >= coalesce(cut_at, -1)), '') AS answer, count(*) FILTER (kind = 'token') AS tokens FROM e JOIN c USING (session_id) GROUP BY 1""")
def r04(spark, d):
    """A third of the events come one micro-batch after their successors; a last one moves the watermark past all."""
    c = S.table(spark, d, "conversations")
    events = answer_events(c.join(c.groupBy("conv_id").agg(F.max("turn").alias("last")), "conv_id"))
    behind = F.pmod(F.col("seq") + F.col("session_id").cast("long"), F.lit(3)) == 1
    beat = spark.range(1).select(F.lit("").alias("session_id"), F.timestamp_seconds(F.lit(10**8)).alias("ts"), F.lit(0).cast("long").alias("seq"), F.lit("beat").alias("kind"), F.lit("").alias("text"))
    return finished(spark, J.assemble_answers(in_turn(spark, events.filter(~behind), events.filter(behind), beat), late="1 hour"))


def in_turn(spark, *frames):
    """A stream that has each frame as a micro-batch of its own."""
    base = scratch(spark)
    for k, frame in enumerate(frames):
        frame.select(*frames[0].columns).coalesce(1).write.parquet(f"{base}/in/{k}")
    return spark.readStream.schema(frames[0].schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in/*")


_MARK = "mark AS (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 10 MINUTE AS mark FROM events WHERE event_id % 10 <> 0 AND event_id % 3 <> 0)"


@register("r07_late_events", f"""
WITH {_MARK}, kept AS (SELECT user_id, ts, event_type FROM events, mark WHERE event_id % 10 <> 0 OR ts > mark)
SELECT user_id AS session_id, date_trunc('hour', ts) AS start, count(*) FILTER (event_type = 'click') AS tokens FROM kept GROUP BY 1, 2
UNION ALL SELECT NULL, NULL, count(*) FROM events, mark WHERE event_id % 10 = 0 AND ts <= mark""")
def r07(spark, d):
    """Every tenth event comes two micro-batches after most others. Windows of the others and of those still in time, and, without a session, the number of dropped events."""
    events = stream_events(S.table(spark, d, "events"))
    late, first = F.pmod("event_id", F.lit(10)) == 0, F.pmod("event_id", F.lit(3)) != 0
    beat = events.limit(1).withColumn("ts", F.timestamp_seconds(F.lit(4 * 10**9)))
    stream = in_turn(spark, events.filter(~late & first), events.filter(~late & ~first), events.filter(late), beat)
    counter, base, name = J.LateRows(), scratch(spark), "late-" + uuid.uuid4().hex
    spark.streams.addListener(counter)
    windows = J.throughput_windows(J.on_time(stream), late=None)

    def write(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{base}/out/{batch_id}")

    J.run_available(windows, write, f"{base}/state", name=name)
    dropped = counter.of(name)
    spark.streams.removeListener(counter)
    out = spark.read.schema(windows.schema).option("recursiveFileLookup", "true").parquet(f"{base}/out").select("session_id", "start", "tokens")
    return out.unionByName(spark.range(1).select(F.lit(None).cast(windows.schema["session_id"].dataType).alias("session_id"), F.lit(None).cast("timestamp").alias("start"), F.lit(dropped).cast("long").alias("tokens")))


@register("r04_assembled_answers_batch", ORACLES["r04_assembled_answers"])
def r04b(spark, d):
    c = S.table(spark, d, "conversations")
    return J.assembled_batch(answer_events(c.join(c.groupBy("conv_id").agg(F.max("turn").alias("last")), "conv_id")))


@register("r05_streamed_questions", f"WITH RECURSIVE {_KEPT}")
def r05(spark, d):
    """The later half comes when the stream has stopped; it goes on from its checkpoint, with a second micro-batch."""
    base = scratch(spark)
    rows = question_rows(spark, d).withColumn("question_id", F.col("seq").cast("string"))
    half = rows.agg((F.max("seq") / 2).alias("half")).head()[0]
    for part in (rows.filter(F.col("seq") < half), rows.filter(F.col("seq") >= half)):
        spread(part, "seq").write.mode("append").parquet(f"{base}/in")
        J.run_available(spark.readStream.schema(rows.schema).parquet(f"{base}/in"), J.reject_asked(f"{base}/accepted"), f"{base}/state")
    return spark.read.parquet(f"{base}/accepted").select("dataset_id", "seq")

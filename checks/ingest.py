"""Sources, identity, chunking, reuse, manifests."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from checks import tables as S
from foliant.functions import text as T
from foliant.operators import ingest as I
from foliant.operators import vectors as V
from foliant.session import shared_dir
from foliant.sources import text_files as X

QUERIES: dict = {}
ORACLES: dict = {}


def register(name: str, sql: str | None = None):
    def add(run):
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run
    return add


@register("s01_corpus_scan", """
SELECT source || '-' || doc_id AS name, sha256(text) AS sha256, CAST(octet_length(encode(text)) AS BIGINT) AS size_bytes
FROM documents""")
def s01(spark, d):
    docs = S.table(spark, d, "documents").select(
        F.concat("source", F.lit("-"), F.col("doc_id").cast("string")).alias("name"), F.lit("").alias("path"),
        F.col("text").alias("content"))
    return X.with_profile(docs).select("name", "sha256", "size_bytes")


@register("s02_source_profile", """
SELECT doc_id, sha256(text) AS sha256, CAST(length(text) AS BIGINT) AS n_chars FROM documents""")
def s02(spark, d):
    named = S.table(spark, d, "documents").select(F.col("doc_id").alias("name"), F.lit("").alias("path"), F.col("text").alias("content"))
    return X.with_profile(named).select(F.col("name").alias("doc_id"), "sha256", F.length("content").cast("long").alias("n_chars"))


@register("s03_dataset_id", f"""
WITH {S.SOURCES}
SELECT corpus, count(*) AS source_count,
  substr(sha256('[' || string_agg('{{"name": "' || name || '", "sha256": "' || sha256 || '"}}', ', '
         ORDER BY lower(name), sha256, path) || ']'), 1, 16) AS dataset_id
FROM src GROUP BY corpus""")
def s03(spark, d):
    return I.dataset_ids(S.sources(spark, d))


def _entry_sql(keep):
    return f"SELECT corpus, sha256('{{\"name\":\"' || name || '\",\"sha256\":\"' || sha256 || '\"}}') AS digest FROM src WHERE {keep}"


def _key_sql(name, keep):
    """Change keys of corpora whose runs take at most two digits."""
    return f"""{name}_e AS ({_entry_sql(keep)}), {name}_n AS (SELECT corpus, count(*) AS entry_count, greatest(0, CAST(ceil(ln(count(*) / 16.0) / ln(16.0)) AS INTEGER)) AS digits FROM {name}_e GROUP BY 1),
{name}_r AS (SELECT corpus, digits, substr(digest, 1, digits) AS run, sha256(string_agg(digest, '' ORDER BY digest)) AS digest FROM {name}_e JOIN {name}_n USING (corpus) GROUP BY 1, 2, 3),
{name} AS (SELECT corpus, entry_count, CASE WHEN digits = 0 THEN min(digest) ELSE sha256(string_agg(run || digest, '' ORDER BY run || digest)) END AS change_key FROM {name}_r JOIN {name}_n USING (corpus, digits) GROUP BY corpus, entry_count, digits)"""


@register("s03_s15_change_keys", f"WITH {S.SOURCES}, {_key_sql('k', 'true')} SELECT corpus, entry_count, change_key FROM k")
def s03b(spark, d):
    return I.change_keys(S.sources(spark, d).select("corpus", "name", "sha256"), run=16)


@register("s15_changed_by_key", f"""
WITH {S.SOURCES}, gone AS (SELECT corpus, bool_or(doc_id % 97 = 0) AS changed, bool_and(doc_id % 97 = 0) AS empty FROM src GROUP BY 1) SELECT corpus, changed FROM gone""")
def s15b(spark, d):
    s = S.sources(spark, d)
    entries = s.select("corpus", "name", "sha256")
    return I.changed_by_key(entries, s.filter("doc_id % 97 <> 0").select("corpus", "name", "sha256"))


@register("s11_j06_chunk_store", f"""
WITH {S.CHUNKS} SELECT chunk_id, source_name, source_path, source_sha256, chunk_index, content FROM chunks""")
def s11(spark, d):
    """Chunks of two thirds of the sources are stored, twice; then all are asked for, and only the rest is cut."""
    path = f"{shared_dir(spark).rstrip('/')}/chunks-{uuid.uuid4().hex}"
    s = S.sources(spark, d)
    some = s.filter("doc_id % 3 <> 0")
    I.reused_chunks(some, path)
    I.write_chunks(I.fixed_chunks(some.filter("doc_id % 3 = 1")), path)
    return I.reused_chunks(s, path)


@register("f45_flat_content", """
SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN text WHEN 1 THEN text || chr(10) || role ELSE text END AS content FROM conversations""")
def f45(spark, d):
    """Message contents as strings, lists of strings and lists with a text part, an image part and an empty one."""
    c = S.table(spark, d, "conversations")
    part = F.to_json(F.array(F.struct(F.col("text").alias("text"))))
    both = F.to_json(F.array("text", "role"))
    mixed = F.concat(F.lit('[{"image":"x"},'), F.substr(part, F.lit(2), F.length(part) - 2), F.lit(',""]'))
    kind = F.pmod("turn", F.lit(3))
    from foliant.functions.responses import flat_content
    rows = c.withColumn("raw", F.when(kind == 0, F.col("text")).when(kind == 1, both).otherwise(mixed))
    return rows.select("conv_id", "turn", flat_content("raw").alias("content"))


@register("x04_m02_words_as_chunks", r"""
SELECT doc_id, CAST(len(list_filter(regexp_extract_all(text, '[^\n]+'), lambda x: length(trim(x)) >= 40)) AS BIGINT) AS chunks FROM documents WHERE length(text) > 0""")
def x04(spark, d):
    """Another splitter in the chunking slot: lines."""
    named = S.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("name"), F.lit("").alias("path"), F.sha2("text", 256).alias("sha256"), F.col("text").alias("content"))
    made = I.recursive_chunks(named, splitter=lambda text, size, overlap: text.split("\n"))
    counts = made.groupBy(F.col("source_name").cast("long").alias("doc_id")).agg(F.count("*").alias("chunks"))
    docs = S.table(spark, d, "documents").filter("length(text) > 0").select("doc_id")
    return docs.join(counts, "doc_id", "left").withColumn("chunks", F.coalesce("chunks", F.lit(0)).cast("long"))


@register("s06_filtered_listing", """
SELECT o_orderkey, o_custkey, o_orderdate FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey""")
def s06(spark, d):
    return S.table(spark, d, "orders").filter("o_orderstatus = 'F'").select(
        "o_orderkey", "o_custkey", "o_orderdate").orderBy(F.desc("o_orderdate"), "o_orderkey")


@register("s08_session_events", """
SELECT user_id AS session_id, event_type, '{"value":' || CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR) || ',"k":' ||
  json_extract_string(props, '$.k') || '}' AS payload, ts AS created_at FROM events""")
def s08(spark, d):
    return X.session_events(
        S.table(spark, d, "events"), F.col("user_id"), F.col("event_type"), F.col("ts"),
        value=F.round(F.col("value") * 100).cast("long"), k=F.get_json_object("props", "$.k").cast("long"))


@register("s09_page_text", f"""
WITH first AS (SELECT source, min(doc_id) AS p FROM documents GROUP BY source)
SELECT source, doc_id AS page,
  CASE WHEN doc_id = p THEN 'Document: ' || source || chr(10) || repeat('=', 60) || chr(10) || chr(10) ELSE '' END
  || '--- Page ' || doc_id || ' ---' || chr(10) || text AS block
FROM documents JOIN first USING (source)""")
def s09(spark, d):
    return X.page_text_rows(S.table(spark, d, "documents").select("source", F.col("doc_id").alias("page"), "text"))


@register("s12_chunk_status", f"""
WITH {S.CHUNKS}
SELECT path, sha256, coalesce(n > 0, false) AS ready, n AS chunk_count FROM src
LEFT JOIN (SELECT source_sha256 AS sha256, count(*) AS n FROM chunks GROUP BY 1) USING (sha256)""")
def s12(spark, d):
    return I.chunk_status(S.sources(spark, d).select("path", "sha256"), S.chunks(spark, d))


# stored vectors: those of chunks with an even index lost their hash for corpora ending in 7
_STORED = f"""
stored AS (SELECT source_sha256, chunk_id, CASE WHEN corpus LIKE '%7' AND chunk_index > 1 THEN 'stale' ELSE sha256(content) END AS content_sha256
           FROM chunks WHERE corpus <> 'src3')"""


def _stored(spark, d):
    c = S.chunks(spark, d).withColumn("corpus", F.substring_index("source_name", "-", 1)).filter("corpus <> 'src3'")
    return c.select("source_sha256", "chunk_id", F.when(
        F.col("corpus").like("%7") & (F.col("chunk_index") > 1), "stale").otherwise(F.sha2("content", 256)).alias("content_sha256"),
        F.lit("hash-64").alias("embedding_model"))


@register("s13_vector_reuse", f"""
WITH {S.CHUNKS}, {_STORED}
SELECT c.source_sha256, c.source_path, bool_and(s.chunk_id IS NOT NULL) AS reusable, count(*) AS chunk_count
FROM chunks c LEFT JOIN stored s ON c.source_sha256 = s.source_sha256 AND c.chunk_id = s.chunk_id AND sha256(c.content) = s.content_sha256
GROUP BY 1, 2""")
def s13(spark, d):
    return V.vector_plan(S.chunks(spark, d), _stored(spark, d), "hash-64")


@register("s13_missing_vectors", f"""
WITH {S.CHUNKS}, {_STORED},
plan AS (SELECT c.source_sha256, c.source_path, bool_and(s.chunk_id IS NOT NULL) AS reusable
  FROM chunks c LEFT JOIN stored s ON c.source_sha256 = s.source_sha256 AND c.chunk_id = s.chunk_id AND sha256(c.content) = s.content_sha256
  GROUP BY 1, 2)
SELECT chunk_id FROM chunks JOIN plan USING (source_sha256, source_path) WHERE NOT reusable""")
def s13b(spark, d):
    return V.missing_vectors(S.chunks(spark, d), _stored(spark, d), "hash-64").select("chunk_id")


@register("s14_upsert", """
SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN b.doc_id IS NOT NULL THEN b.quality + 10 ELSE length(a.text) END AS payload
FROM documents a FULL OUTER JOIN labels b ON a.doc_id = b.doc_id""")
def s14(spark, d):
    old = S.table(spark, d, "documents").select("doc_id", F.length("text").cast("long").alias("payload"))
    new = S.table(spark, d, "labels").select("doc_id", (F.col("quality") + 10).cast("long").alias("payload"))
    return I.upsert(old, new, "doc_id", ["payload"])


@register("s15_manifest", f"""
WITH {S.CHUNKS}
SELECT s.corpus, 'hash-64' AS embedding_model, 1100 AS chunk_size, 220 AS chunk_overlap, source_count,
  coalesce(chunk_count, 0) AS chunk_count
FROM (SELECT corpus, count(*) AS source_count FROM src GROUP BY 1) s
LEFT JOIN (SELECT corpus, count(*) AS chunk_count FROM chunks GROUP BY 1) c USING (corpus)""")
def s15(spark, d):
    c = S.chunks(spark, d).withColumn("corpus", F.substring_index("source_name", "-", 1))
    return I.manifest_headers(S.sources(spark, d), c, "hash-64")


@register("s15_changed_corpora", f"""
WITH {S.SOURCES},
new AS (SELECT corpus, name, path, sha256 FROM src),
old AS (SELECT corpus, name, path, CASE WHEN length(content) > 9000 AND corpus LIKE '%1' THEN 'other' ELSE sha256 END AS sha256 FROM src)
SELECT corpus, bool_or(n <> 0) AS changed FROM (
  SELECT corpus, name, path, sha256, sum(side) AS n FROM (
    SELECT *, 1 AS side FROM old UNION ALL SELECT *, -1 AS side FROM new) GROUP BY ALL) GROUP BY corpus""")
def s15b(spark, d):
    new = S.sources(spark, d)
    old = new.withColumn("sha256", F.when((F.length("content") > 9000) & F.col("corpus").like("%1"), "other").otherwise(F.col("sha256")))
    cols = ["corpus", "name", "path", "sha256"]
    return I.changed_corpora(old.select(cols), new.select(cols))


_BUCKETS = f"""{S.CHUNKS}, t AS (SELECT chunk_id, source_name, chunk_index, unnest(list_distinct({S.search_tokens('norm')})) AS term FROM (SELECT *, {S.search_norm('content')} AS norm FROM chunks)),
b AS (SELECT chunk_id, source_name, CAST('0x' || substr(md5(term), 1, 4) AS INTEGER) % 64 AS bucket, count(*) AS c FROM t GROUP BY ALL)"""


@register("s16_embedded_chunks", f"WITH {_BUCKETS} SELECT chunk_id, source_name, bucket, round(c / sqrt(sum(c * c) OVER (PARTITION BY chunk_id, source_name)), 6) AS value FROM b")
def s16b(spark, d):
    """Every component of every chunk's vector that isn't 0."""
    e = V.embed(S.chunks(spark, d).select("chunk_id", "source_name", "content"), "content")
    return e.select("chunk_id", "source_name", F.posexplode("embedding").alias("bucket", "value")).filter("value <> 0").withColumn("value", F.round("value", 6))


@register("s16_embedding_slot", f"""
WITH {S.CHUNKS} SELECT chunk_id, CASE WHEN len({S.search_tokens('norm')}) > 0 THEN 1.0::DOUBLE ELSE 0.0 END AS length FROM (SELECT *, {S.search_norm('content')} AS norm FROM chunks)""")
def s16(spark, d):
    e = V.embed(S.chunks(spark, d).select("chunk_id", "content"), "content")
    return e.select("chunk_id", F.round(F.aggregate("embedding", F.lit(0.0), lambda s, v: s + v * v), 6).alias("length"))


@register("x01_own_embedding", f"""
WITH {S.CHUNKS} SELECT chunk_id, source_name, CAST(length(content) AS DOUBLE) AS size, CAST(length(content) - length(replace(content, 'e', '')) AS DOUBLE) AS e_count FROM chunks""")
def x01(spark, d):
    """Another function in the embedding slot: the length of a chunk and how often it holds an e."""
    def measure(batches):
        for b in batches:
            yield b.drop(columns=["text"]).assign(embedding=[[float(len(t)), float(t.count("e"))] for t in b["text"]])

    e = V.embed(S.chunks(spark, d).select("chunk_id", "source_name", "content"), "content", measure)
    return e.select("chunk_id", "source_name", F.col("embedding")[0].alias("size"), F.col("embedding")[1].alias("e_count"))


@register("s18_upload_dedup", """
WITH batch AS (SELECT DISTINCT lang AS user_id, source AS original_name, sha256(text) AS sha256 FROM documents),
stored AS (SELECT DISTINCT lang AS user_id, source AS original_name, sha256(text) AS sha256 FROM documents JOIN labels USING (doc_id))
SELECT * FROM batch ANTI JOIN stored USING (user_id, original_name, sha256)""")
def s18(spark, d):
    docs = S.table(spark, d, "documents").select(
        "doc_id", F.col("lang").alias("user_id"), F.col("source").alias("original_name"),
        F.sha2(F.encode("text", "UTF-8"), 256).alias("sha256"))
    stored = docs.join(S.table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi")
    return I.new_uploads(docs.drop("doc_id"), stored)


_SUFFIX_NAME = "p_name || CASE p_size % 6 WHEN 0 THEN '.TXT' WHEN 1 THEN '.pdf' WHEN 2 THEN '.jpeg' WHEN 3 THEN '.tar.gz' WHEN 4 THEN '' ELSE '.txt' END"


@register("s19_upload_filter", f"""
SELECT p_partkey, name, lower(regexp_extract(name, '\\.[^. ]+$')) IN ('.txt', '.pdf') AS for_corpus,
  lower(regexp_extract(name, '\\.[^. ]+$')) IN ('.txt', '.pdf', '.png', '.jpg', '.jpeg', '.webp', '.bmp', '.gif') AS for_chat
FROM (SELECT p_partkey, {_SUFFIX_NAME} AS name FROM part)""")
def s19(spark, d):
    return S.table(spark, d, "part").select("p_partkey", F.expr(_SUFFIX_NAME).alias("name")).select(
        "p_partkey", "name", I.uploadable("name").alias("for_corpus"), I.uploadable("name", chat=True).alias("for_chat"))


@register("s20_attachment_kind", f"""
SELECT p_partkey, CASE lower(regexp_extract(name, '\\.[^. ]+$')) WHEN '.txt' THEN 'text' WHEN '.pdf' THEN 'pdf' WHEN '.jpeg' THEN 'image' END AS kind
FROM (SELECT p_partkey, {_SUFFIX_NAME} AS name FROM part)""")
def s20(spark, d):
    return S.table(spark, d, "part").select("p_partkey", I.attachment_kind(F.expr(_SUFFIX_NAME)).alias("kind"))


@register("s21_text_excerpt", f"""
SELECT doc_id, CASE WHEN length(s) <= 4000 THEN s ELSE regexp_replace(substr(s, 1, 4000), '\\s+$', '') || '...' END AS excerpt
FROM (SELECT doc_id, {S.strip('text')} AS s FROM documents)""")
def s21(spark, d):
    return S.table(spark, d, "documents").select("doc_id", T.excerpt("text").alias("excerpt"))


@register("s22_restored_selection", f"""
WITH {S.SOURCES},
picked AS (SELECT lang AS selection, source || '-' || doc_id || '.txt' AS path FROM documents
  WHERE lang <> 'en' OR doc_id IN (SELECT doc_id FROM src)),
gaps AS (SELECT selection, count(*) FILTER (WHERE s.path IS NULL) AS n FROM picked LEFT JOIN src s USING (path) GROUP BY 1)
SELECT selection, path FROM picked WHERE selection IN (SELECT selection FROM gaps WHERE n = 0)""")
def s22(spark, d):
    src = S.sources(spark, d)
    docs = S.table(spark, d, "documents").select(
        F.col("lang").alias("selection"), "doc_id",
        F.concat("source", F.lit("-"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"))
    known = src.select("doc_id").withColumn("_k", F.lit(True))
    picked = docs.join(known, "doc_id", "left").filter("selection <> 'en' or _k").select("selection", "path")
    return I.restored_selection(picked, src)


@register("s23_corpus_label", f"""
WITH {S.SOURCES}, l AS (SELECT corpus, string_agg(name, ', ' ORDER BY doc_id, name) AS s FROM src GROUP BY 1)
SELECT corpus, CASE WHEN length(s) <= 80 THEN s ELSE rtrim(substr(s, 1, 77)) || '...' END AS label FROM l""")
def s23(spark, d):
    return I.corpus_labels(S.sources(spark, d), "corpus", "doc_id")


@register("j06_pending_sources", f"""
WITH {S.CHUNKS}
SELECT name, sha256 FROM src WHERE sha256 NOT IN (SELECT source_sha256 FROM chunks WHERE length(corpus) = 4)""")
def j06(spark, d):
    c = S.chunks(spark, d).filter(F.length(F.substring_index("source_name", "-", 1)) == 4)
    return I.pending_sources(S.sources(spark, d), c).select("name", "sha256")


@register("m02_fixed_chunks", f"WITH {S.CHUNKS} SELECT chunk_id, source_name, source_path, source_sha256, chunk_index, content FROM chunks")
def m02(spark, d):
    return S.chunks(spark, d)


@register("m01_recursive_chunks")
def m01(spark, d):
    return I.recursive_chunks(S.sources(spark, d))


@register("p03_nonempty_sources", f"""
SELECT doc_id FROM documents WHERE length({S.strip('text')}) > 0""")
def p03(spark, d):
    return S.table(spark, d, "documents").filter(~T.is_blank("text")).select("doc_id")


@register("p04_chunk_minimum", f"""
WITH {S.CHUNKS} SELECT source_name, count(*) AS kept, min(length(content)) AS shortest FROM chunks GROUP BY 1""")
def p04(spark, d):
    return S.chunks(spark, d).groupBy("source_name").agg(
        F.count("*").alias("kept"), F.min(F.length("content")).cast("long").alias("shortest"))


@register("a07_chunk_counts", f"""
WITH {S.CHUNKS} SELECT corpus, count(*) AS chunk_count, count(DISTINCT source_name) AS source_count FROM chunks GROUP BY 1""")
def a07(spark, d):
    return S.chunks(spark, d).groupBy("source_name").agg(F.count("*").alias("n")).groupBy(
        F.substring_index("source_name", "-", 1).alias("corpus")).agg(
        F.sum("n").alias("chunk_count"), F.count("*").alias("source_count"))

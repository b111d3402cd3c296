"""Text normal forms, lexical and vector candidates, hybrid retrieval, contexts."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from checks import retrieval_sql as R
from checks import tables as S
from foliant.functions import text as T
from foliant.operators import lexical as L
from foliant.operators import retrieve as H
from foliant.operators import vectors as V
from foliant.plans.scans import dense_index, sorted_place, top_rows
from foliant.plans.sizing import bounded_broadcast
from foliant.session import stored

QUERIES: dict = {}
ORACLES: dict = {}


def register(name: str, sql: str | None = None):
    def add(run):
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run
    return add


def _features(queries):
    return L.query_features(L.scoped(queries), L.QUERY)


def mixed_queries(spark, d):
    b = S.table(spark, d, "benchmark")
    name = F.regexp_extract("text", "[A-Z][a-z]+", 0)
    kinds = b.withColumn("kind", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    return kinds.select(
        (F.col("item_id") * 3 + F.col("kind")).alias("query_id"),
        F.when(F.col("kind") == 0, F.col("text"))
        .when(F.col("kind") == 1, F.concat(F.lit('"'), F.replace("text", F.lit('"')), F.lit('"')))
        .otherwise(F.concat(F.lit("Who is "), name, F.lit(" and what is the role of "), name, F.lit(" here?"))).alias("query"))


# -- normal forms ------------------------------------------------------------------------

@register("f01_corpus_clean", f"SELECT doc_id, {S.corpus_clean('text')} AS body FROM documents")
def f01(spark, d):
    return S.table(spark, d, "documents").select("doc_id", T.corpus_clean("text").alias("body"))


@register("f02_squeeze", f"SELECT page_id, {S.sq('html')} AS text FROM pages")
def f02(spark, d):
    return S.table(spark, d, "pages").select("page_id", T.squeeze("html").alias("text"))


@register("f03_question_form", f"SELECT doc_id, {S.question_norm('text')} AS form FROM documents")
def f03(spark, d):
    return S.table(spark, d, "documents").select("doc_id", T.question_norm("text").alias("form"))


@register("f04_search_form", f"SELECT doc_id, {S.search_norm('text')} AS form FROM documents")
def f04(spark, d):
    return S.table(spark, d, "documents").select("doc_id", T.search_norm("text").alias("form"))


@register("f05_search_tokens", f"""
SELECT doc_id, array_to_string({S.search_tokens(S.search_norm('text'))}, ' ') AS tokens FROM documents""")
def f05(spark, d):
    return S.table(spark, d, "documents").select(
        "doc_id", F.array_join(T.search_tokens(T.search_norm("text")), " ").alias("tokens"))


@register("f06_f07_p13_query_shape", f"""
WITH {R.QUERY_SETS['mixed']}, {R.features('f', 'q', 'query_id', 'query', False)}
SELECT query_id, multi_part, description, role, len(phrases) > 0 AS has_quote, array_to_string(phrases, '|') AS phrases,
  (SELECT string_agg(term, ' ' ORDER BY term) FROM f_n WHERE f_n.query_id = f.query_id) AS entities FROM f""")
def p13(spark, d):
    f = L.query_features(mixed_queries(spark, d), ["query_id"])
    return f.select("query_id", "multi_part", "description", "role", "has_quote", F.array_join("phrases", "|").alias("phrases"),
                    F.nullif(F.array_join(F.array_sort("entity"), " "), F.lit("")).alias("entities"))


@register("f08_query_variants", f"""
WITH {R.QUERY_SETS['mixed']}, {R.features('f', 'q', 'query_id', 'query', False)}
SELECT query_id, vno AS variant_no, variant FROM f_v""")
def f08(spark, d):
    f = L.query_features(mixed_queries(spark, d), ["query_id"])
    return f.select("query_id", F.posexplode("variants").alias("variant_no", "variant"))


@register("f09_query_terms", f"""
WITH {R.QUERY_SETS['mixed']}, {R.features('f', 'q', 'query_id', 'query', False)}
SELECT query_id, term, is_direct, is_expanded, is_entity FROM f_t""")
def f09(spark, d):
    f = L.query_features(mixed_queries(spark, d), ["query_id"])
    return L.feature_terms(f, ["query_id"]).drop("in_variants")


@register("f11_support_terms", f"""
SELECT doc_id, array_to_string(list_sort({S.support_terms('text')}), ' ') AS terms FROM documents""")
def f11(spark, d):
    return S.table(spark, d, "documents").select("doc_id", F.array_join(F.array_sort(T.support_terms("text")), " ").alias("terms"))


@register("f13_sentences", f"""
SELECT doc_id, CAST(len({S.sentences('text', 20)}) AS BIGINT) AS n20, CAST(len({S.sentences('text', 40)}) AS BIGINT) AS n40,
  array_to_string({S.sentences('text', 25)}, '|') AS joined FROM documents""")
def f13(spark, d):
    return S.table(spark, d, "documents").select(
        "doc_id", F.size(T.sentences("text", 20)).cast("long").alias("n20"), F.size(T.sentences("text", 40)).cast("long").alias("n40"),
        F.array_join(T.sentences("text", 25), "|").alias("joined"))


@register("f14_quoted_content", rf"""
SELECT page_id, {S.sq("array_to_string(list_filter(list_transform(regexp_extract_all(html, '[\"“”](.*?)[\"“”]', 1), lambda s: " + S.sq("trim(s, ' ,;:-')") + "), lambda s: length(s) > 0), ' ')")} AS quoted FROM pages""")
def f14(spark, d):
    return S.table(spark, d, "pages").select("page_id", T.quoted_content("html").alias("quoted"))


@register("w03_sentence_windows", f"""
WITH w AS (SELECT doc_id, {R.windows_from('ss')} AS wins FROM (SELECT doc_id, {S.sentences('text')} AS ss FROM documents))
SELECT doc_id, array_to_string(list_filter(wins, lambda e, i: list_position(wins, e) = i), '|') AS windows FROM w""")
def w03(spark, d):
    return S.table(spark, d, "documents").select("doc_id", F.array_join(T.sentence_windows("text"), "|").alias("windows"))


@register("u02_u05_token_sets", f"""
WITH p AS (SELECT doc_id, {S.support_terms('text')} AS a, {S.support_terms('source || chr(32) || lang || chr(32) || substr(text, 1, length(text) // 2)')} AS b FROM documents)
SELECT doc_id, CAST(len(list_intersect(a, b)) AS BIGINT) AS both, CAST(len(list_distinct(list_concat(a, b))) AS BIGINT) AS either,
  CAST(len(list_filter(a, lambda x: NOT list_contains(b, x))) AS BIGINT) AS only_left, NOT list_has_any(a, b) AS apart FROM p""")
def u02(spark, d):
    half = F.concat("source", F.lit(" "), "lang", F.lit(" "), F.substr("text", F.lit(1), F.floor(F.length("text") / 2).cast("int")))
    p = S.table(spark, d, "documents").select("doc_id", T.support_terms("text").alias("a"), T.support_terms(half).alias("b"))
    return p.select("doc_id", F.size(F.array_intersect("a", "b")).cast("long").alias("both"),
                    F.size(F.array_union("a", "b")).cast("long").alias("either"),
                    F.size(F.array_except("a", "b")).cast("long").alias("only_left"), (~F.arrays_overlap("a", "b")).alias("apart"))


# -- vectors --------------------------------------------------------------------------------

_PAIR = "FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"


@register("f46_f47_similarity", f"""
SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine,
  round(list_sum(list_transform(range(1, 65), lambda i: (a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE) ** 2)), 6) AS distance,
  round(1 / (1 + list_sum(list_transform(range(1, 65), lambda i: (a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE) ** 2))), 6) AS relevance {_PAIR}""")
def f46(spark, d):
    e = S.table(spark, d, "embeddings")
    pairs = e.select("vec_id", F.col("embedding").alias("a")).join(
        e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b")), "vec_id")
    gap = T.squared_distance("a", "b")
    return pairs.select("vec_id", F.round(T.cosine("a", "b"), 6).alias("cosine"), F.round(gap, 6).alias("distance"),
                        F.round(T.relevance(gap), 6).alias("relevance"))


@register("j09_t01_nearest", """
SELECT query_id, rank, vec_id, distance, round(1 / (1 + distance), 6) AS relevance FROM (
  SELECT query_id, vec_id, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM (
    SELECT a.vec_id AS query_id, b.vec_id, round(2 - 2 * list_inner_product(a.e, b.e) + (list_inner_product(a.e, a.e) - 1) + (list_inner_product(b.e, b.e) - 1), 6) AS distance
    FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings) a, (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings) b)) WHERE rank <= 4""")
def j09(spark, d):
    e = S.table(spark, d, "embeddings")
    q = e.select(F.col("vec_id").alias("query_id"), "embedding")
    return V.nearest(q, ["query_id"], e, ["vec_id"], 4).withColumn("relevance", F.round("relevance", 6))


@register("j09_nearest_in_blocks", """
SELECT query_id, rank, vec_id, distance FROM (
  SELECT query_id, vec_id, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM (
    SELECT a.vec_id AS query_id, b.vec_id, round(2 - 2 * list_inner_product(a.e, b.e) + (list_inner_product(a.e, a.e) - 1) + (list_inner_product(b.e, b.e) - 1), 6) AS distance
    FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings) a, (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings) b)) WHERE rank <= 4""")
def j09b(spark, d):
    e = S.table(spark, d, "embeddings")
    q = e.select(F.col("vec_id").alias("query_id"), "embedding")
    return V.nearest(q, ["query_id"], e, ["vec_id"], 4, broadcast_vectors=0).drop("relevance")


@register("j16_best_similarity", """
SELECT l.doc_id, round(max(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])), 6) AS similarity
FROM labels l JOIN embeddings a ON a.vec_id = l.doc_id JOIN embeddings b ON b.vec_id BETWEEN a.vec_id + 1 AND a.vec_id + 3 GROUP BY 1""")
def j16(spark, d):
    e = S.table(spark, d, "embeddings")
    left = S.table(spark, d, "labels").select("doc_id").join(e.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("a")), "doc_id")
    evidence = left.select("doc_id", "a", F.explode(F.sequence(F.col("doc_id") + 1, F.col("doc_id") + 3)).alias("vec_id"))
    out = V.best_similarity(evidence.join(e.select("vec_id", F.col("embedding").alias("b")), "vec_id"), "doc_id", "a", "b")
    return out.withColumn("similarity", F.round("similarity", 6))


# -- lexical ----------------------------------------------------------------------------------

@register("a01_a02_term_weights", f"""
WITH {R.lexical('mixed')} SELECT term, coalesce(df, 0) AS df, round(weight, 6) AS weight FROM w LEFT JOIN df USING (term)""")
def a01(spark, d):
    index = L.index_of(S.stored_chunks(spark, d))
    f = _features(mixed_queries(spark, d))
    terms = L.feature_terms(f, L.QUERY).select("dataset_id", "term").union(
        L.feature_terms(L.variant_features(f), L.QUERY).select("dataset_id", "term")).distinct()
    return L.term_weights(terms, L.document_frequency(index, terms), index.sizes).select("term", "df", F.round("weight", 6).alias("weight"))


@register("a03_entity_intro", f"WITH {R.lexical('mixed')} SELECT source_name, term, first AS intro_index FROM intro")
def a03(spark, d):
    return L.entity_intro(L.index_of(S.stored_chunks(spark, d)), _features(mixed_queries(spark, d))).drop("dataset_id")


@register("w05_intro_bonus", f"WITH {R.lexical('mixed')} SELECT query_id, source_name, chunk_index, chunk_id, CAST(intro AS DOUBLE) AS intro FROM bonus")
def w05(spark, d):
    f, index = _features(mixed_queries(spark, d)), L.index_of(S.stored_chunks(spark, d))
    bonus = L.intro_bonus(index, f, L.entity_intro(index, f))
    return bonus.join(index.keys("source_name", "chunk_index", "chunk_id"), "chunk_no").drop("chunk_no")


@register("j11_phrase_join", f"WITH {R.lexical('mixed')} SELECT query_id, source_name, chunk_index, chunk_id, ph AS phrases FROM ws_ph")
def j11(spark, d):
    index = L.index_of(S.stored_chunks(spark, d))
    hits = L.phrase_hits(index, _features(mixed_queries(spark, d)))
    return hits.join(index.keys("source_name", "chunk_index", "chunk_id"), "chunk_no").drop("chunk_no")


@register("j10_m03_whole_scores", f"""
WITH {R.lexical('mixed')} SELECT query_id, chunk_id, hits, round(score, 6) AS score FROM ws""")
def m03(spark, d):
    index, features, _ = H.prepare_queries(mixed_queries(spark, d), S.stored_chunks(spark, d))
    # the pairs stay where they are: only the keys are dealt out
    return L.whole_scores(index, features).join(index.keys("chunk_id").hint("shuffle_hash"), "chunk_no").select(
        "query_id", "chunk_id", F.col("hits").cast("int").alias("hits"), F.round("whole", 6).alias("score"))


_LEX = "SELECT query_id, chunk_id, lpos, score, hits, round(whole, 6) AS whole, round(best_window, 6) AS best_window, CAST(intro AS DOUBLE) AS intro FROM lex"


def _lexical(queries, c):
    index, features, _ = H.prepare_queries(queries, c)
    out = L.lexical_candidates(index, features)
    return out.select("query_id", "chunk_id", "lpos", "score", "hits", F.round("whole", 6).alias("whole"),
                      F.round("best_window", 6).alias("best_window"), "intro")


@register("m04_a14_t02_lexical_candidates", f"WITH {R.lexical('plain')} {_LEX}")
def m04(spark, d):
    return _lexical(S.benchmark_queries(spark, d), S.stored_chunks(spark, d))


@register("m04_lexical_candidates_mixed", f"WITH {R.lexical('mixed')} {_LEX}")
def m04b(spark, d):
    return _lexical(mixed_queries(spark, d), S.stored_chunks(spark, d))


@register("a15_max_lexical_score", f"""
WITH {R.lexical('plain')} SELECT query_id, chunk_id, round(score / max(score) OVER (PARTITION BY query_id), 6) AS share FROM lex""")
def a15(spark, d):
    index, features, _ = H.prepare_queries(S.benchmark_queries(spark, d), S.stored_chunks(spark, d))
    out = L.lexical_candidates(index, features)
    return out.select("query_id", "chunk_id", F.round(F.col("score") / F.max("score").over(Window.partitionBy("query_id")), 6).alias("share"))


@register("direct_term_top_chunks", f"""
WITH {R.lexical('plain')}
SELECT query_id, chunk_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (
  SELECT query_id, chunk_id, round(sum(weight), 6) AS score FROM held JOIN f_d USING (term) JOIN w USING (term) GROUP BY ALL)) WHERE rank <= 4""")
def direct_top(spark, d):
    index, features, _ = H.prepare_queries(S.benchmark_queries(spark, d), S.stored_chunks(spark, d))
    terms = features.select("query_id", F.explode("weights").alias("term", "weight"), "direct").filter(
        F.array_contains("direct", F.col("term"))).drop("direct")
    # chunks meet the terms where they are dealt to, and only the best four of each task are shuffled
    held = L.deal(index, index.chunks.select("chunk_id", "tokens"), "chunk_id").select("chunk_id", F.explode("tokens").alias("term")).join(bounded_broadcast(terms), "term")
    scored = held.groupBy("query_id", "chunk_id").agg(F.round(F.sum("weight"), 6).alias("score"))
    return top_rows(scored, ["query_id"], [F.desc("score"), F.col("chunk_id")], 4)


# -- hybrid -----------------------------------------------------------------------------------

@register("t03_candidate_limits", """
SELECT corpus, n, CASE WHEN n >= 180 THEN least(greatest(24, 32), 64) WHEN n >= 80 THEN least(greatest(20, 24), 48)
  WHEN n >= 40 THEN least(greatest(16, 18), 32) WHEN n > 0 THEN least(greatest(12, 12), greatest(n, 12)) ELSE 8 END AS lim
FROM (SELECT c_custkey AS corpus, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1
      UNION ALL SELECT -1 - n_nationkey, count(c_custkey) FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1
      UNION ALL SELECT -1000 - s_suppkey, count(*) FROM supplier JOIN lineitem ON l_suppkey = s_suppkey GROUP BY 1)""")
def t03(spark, d):
    t = lambda n: S.table(spark, d, n)
    a = t("customer").join(t("orders"), F.col("o_custkey") == F.col("c_custkey"), "left").groupBy(
        F.col("c_custkey").alias("corpus")).agg(F.count("o_orderkey").alias("n"))
    b = t("nation").join(t("customer"), F.col("c_nationkey") == F.col("n_nationkey"), "left").groupBy(
        (-1 - F.col("n_nationkey")).cast("long").alias("corpus")).agg(F.count("c_custkey").alias("n"))
    c = t("lineitem").groupBy((-1000 - F.col("l_suppkey")).alias("corpus")).agg(F.count("*").alias("n"))
    return a.unionByName(b).unionByName(c).select("corpus", "n", H.candidate_limit(F.col("n")).cast("long").alias("lim"))


@register("j12_neighbors", f"""
WITH {S.CHUNKS}, seeds AS (SELECT source_name, chunk_index, row_number() OVER (PARTITION BY corpus ORDER BY length(content) DESC, chunk_id) AS seed_no, corpus FROM chunks),
wanted AS (SELECT corpus, source_name, chunk_index + o AS chunk_index, min({{s: seed_no, o: o}}) AS seen FROM seeds, (SELECT unnest([-2, -1, 0, 1, 2]) AS o) GROUP BY ALL)
SELECT corpus, chunk_id, row_number() OVER (PARTITION BY corpus ORDER BY seen) AS place FROM wanted JOIN chunks USING (corpus, source_name, chunk_index)""")
def j12(spark, d):
    # texts are cut once; places need their lengths only
    c = stored(S.chunks(spark, d).select(F.substring_index("source_name", "-", 1).alias("corpus"), "source_name", "chunk_index", "chunk_id",
                                         F.length("content").alias("size")))
    seeds = sorted_place(c, ["corpus"], [F.desc("size"), F.col("chunk_id")], "seed_no").drop("chunk_id", "size")
    return H.neighbors(seeds, c.drop("corpus"), ["corpus"], 2, whole=True).select("corpus", "chunk_id", "place")


def _stages(queries, c):
    index, features, _ = H.prepare_queries(queries, c)
    return index, features, H.vector_candidates(features, V.embed(index.chunks.select(*L.CHUNK, "content", "tokens"), "content"))


@register("j09_vector_candidates", f"""
WITH {R.vector('plain')} SELECT query_id, chunk_id, distance, round(relevance, 6) AS relevance, vpos FROM vec""")
def vec_candidates(spark, d):
    _, _, vec = _stages(S.benchmark_queries(spark, d), S.stored_chunks(spark, d))
    return vec.select("query_id", "chunk_id", "distance", F.round("relevance", 6).alias("relevance"), "vpos")


@register("j13_u01_fused_candidates", f"""
WITH {R.hybrid('plain')} SELECT query_id, chunk_id, round(v, 6) AS v, round(l, 6) AS l, hits FROM fu""")
def j13(spark, d):
    index, features, vec = _stages(S.benchmark_queries(spark, d), S.stored_chunks(spark, d))
    fused = H.fuse(vec, L.lexical_candidates(index, features))
    return fused.select("query_id", "chunk_id", F.round("v", 6).alias("v"), F.round("l", 6).alias("l"), "hits")


@register("w04_ranked_candidates", f"""
WITH {R.hybrid('plain')} SELECT query_id, chunk_id, nearby, combined, relevance, global_rank FROM ra""")
def w04(spark, d):
    index, features, vec = _stages(S.benchmark_queries(spark, d), S.stored_chunks(spark, d))
    fused = H.fuse(vec, L.lexical_candidates(index, features))
    return H.rank_candidates(H.expand(fused, features), index.chunks, features).select(
        "query_id", "chunk_id", "nearby", "combined", "relevance", "global_rank")


_RET = "SELECT query_id, rank, chunk_id, source_name, chunk_index, content, distance, relevance FROM ret"


@register("m05_t04_hybrid_retrieval", f"WITH {R.hybrid('plain')} {_RET}")
def m05(spark, d):
    return H.retrieve(S.benchmark_queries(spark, d), S.stored_chunks(spark, d)).drop("dataset_id")


@register("m05_t05_hybrid_retrieval_mixed", f"WITH {R.hybrid('mixed')} {_RET}")
def m05b(spark, d):
    return H.retrieve(mixed_queries(spark, d), S.stored_chunks(spark, d)).drop("dataset_id")


#: Corpora of very different sizes; each names its sources by their place in it, so that names repeat from corpus to corpus.
CORPORA = ["en", "de", "fr", "es", "none"]


def _of_corpora(spark, d):
    from foliant.operators.ingest import fixed_chunks
    docs = S.table(spark, d, "documents").withColumn("dataset_id", F.coalesce("lang", F.lit("none")))
    placed = dense_index(docs.select("doc_id", "dataset_id", "text"), ["dataset_id"], "doc_id", "place")
    name = F.concat(F.lit("text-"), F.col("place").cast("string"))
    own = placed.select(name.alias("name"), F.concat("dataset_id", F.lit("/"), name).alias("path"),
                        F.sha2(F.concat("dataset_id", F.lit("-"), name), 256).alias("sha256"), F.col("text").alias("content"))
    chunks = fixed_chunks(own).withColumn("dataset_id", F.substring_index("source_path", "/", 1))
    queries = S.table(spark, d, "benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("query"), F.element_at(F.array(*map(F.lit, CORPORA)), (F.col("item_id") % 5 + 1).cast("int")).alias("dataset_id"))
    return queries, stored(L.with_tokens(chunks))


def _corpus_sql(own: str) -> str:
    """The hybrid query over one corpus alone."""
    docs = f"(SELECT doc_id, text, 'text-' || row_number() OVER (ORDER BY doc_id) AS name FROM documents WHERE coalesce(lang, 'none') = '{own}')"
    sources = f"src AS (SELECT sha256('{own}-' || name) AS sha256, name, '{own}/' || name AS path, text AS content, '' AS corpus, doc_id FROM {docs})"
    whole = R.hybrid("plain").replace(S.SOURCES.strip(), sources)
    whole = whole.replace(R.QUERY_SETS["plain"], f"q AS (SELECT item_id AS query_id, text AS query FROM benchmark WHERE item_id % 5 = {CORPORA.index(own)})")
    return f"SELECT '{own}' AS dataset_id, * FROM (WITH {whole} {_RET})"


@register("m05_t04_t05_corpus_retrieval", " UNION ALL ".join(map(_corpus_sql, CORPORA)))
def m05c(spark, d):
    return H.retrieve(*_of_corpora(spark, d))


_BLOCK = "'[Excerpt ' || {n} || ' | chunk_id=' || chunk_id || ' | source=' || source_name || ']' || chr(10) || {t}"


@register("m06_context", f"""
WITH {R.hybrid('plain')} SELECT query_id, string_agg({_BLOCK.format(n='rank', t='content')}, chr(10) || chr(10) ORDER BY rank) AS context FROM ret GROUP BY 1""")
def m06(spark, d):
    return H.build_context(H.retrieve(S.benchmark_queries(spark, d), S.stored_chunks(spark, d)))


@register("m07_w12_focused_context", f"""
WITH {R.focused(R.hybrid('mixed'))} SELECT query_id, string_agg({_BLOCK.format(n='excerpt_no', t='text')}, chr(10) || chr(10) ORDER BY excerpt_no) AS context FROM fx GROUP BY 1""")
def m07(spark, d):
    q = mixed_queries(spark, d)
    from foliant.session import cut
    return H.focused_context(q, cut(H.retrieve(q, S.stored_chunks(spark, d))))


@register("a08_unique_sources", f"""
WITH {R.hybrid('plain')}, s AS (SELECT query_id, list(source_name ORDER BY rank) AS l FROM ret GROUP BY 1)
SELECT query_id, array_to_string(list_filter(l, lambda e, i: list_position(l, e) = i), '|') AS sources FROM s""")
def a08(spark, d):
    r = H.retrieve(S.benchmark_queries(spark, d), S.stored_chunks(spark, d))
    return H.unique_sources(r).select("query_id", F.array_join("source_names", "|").alias("sources"))

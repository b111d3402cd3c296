"""Findings of the fourth round, on small tables."""

import random

from pyspark.sql import functions as F

import __spark_entry__ as registered
from foliant.functions import text as T
from foliant.operators import answer as A
from foliant.operators import lexical as L
from foliant.operators import retrieve as H


def documents(spark, path, texts):
    rows = [(k, text, "en", "src", None if text is None else len(text)) for k, text in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_captions_of_texts_without_words_are_those_of_the_sql(spark, tmp_path):
    d = documents(spark, tmp_path, ["", " \n", "", "\t", None, None, "a  map ", "Of land."])
    got = {r.doc_id: r.caption for r in registered.queries()["f32_caption_echo"](spark, d).collect()}
    assert got == {0: "The image shows ", 1: "A plain lead. The image shows ", 2: "The image shows ", 3: "The image shows ",
                   4: None, 5: None, 6: "The image shows a map", 7: "The image shows Of land."}


def test_short_plain_answers_are_read_but_not_used(spark, tmp_path):
    rows = [(1, "Éaux."), (2, "Answer: Thtion."), (3, "Answer: the river is long"), (4, None), (5, '{"status": "supported"}')]
    got = {r.query_id: (r.answer, r.read) for r in A.parse_responses(spark.createDataFrame(rows, "query_id int, raw_text string")).collect()}
    assert got == {1: ("", "Éaux."), 2: ("", "Thtion."), 3: ("the river is long",) * 2, 4: ("", None), 5: ("", None)}
    d = documents(spark, tmp_path, ["A.", "A.", "A.", "A.", None, None, None, None])
    parsed = registered.queries()["m27_parsed_responses"](spark, d).collect()
    assert {r.query_id: r.answer for r in parsed} == {k: "A." if k < 4 else None for k in range(8)}


def name_chunks(spark):
    rng = random.Random(4)
    words = [f"w{k}x" for k in range(30)]
    text = lambda k: " ".join(["Anna"] * (k % 3 > 0) + [rng.choice(words) for _ in range(25)]) + "."
    rows = [(f"c{k * 37 % 400:03d}", f"s{k // 4}", k % 4, text(k)) for k in range(400)]
    return spark.createDataFrame(rows, "chunk_id string, source_name string, chunk_index int, content string"), rows


def test_chunks_of_equal_scores_leave_the_scan_by_their_ids(spark):
    chunks, rows = name_chunks(spark)
    said = " ".join(rows[7][3].split()[2:14])
    asked = ["Who is Anna and what is the role of Anna here?", f'"{said}"', "w1x w2x w3x Anna", f'Who is "{said[1:-1]}" and "w3x w4x"']
    index, features, _ = H.prepare_queries(spark.createDataFrame(list(enumerate(asked)), "query_id int, query string"), chunks)
    features = L.cut(features.withColumn("limit", F.lit(5)))
    terms, intros = L.cut(L.weighted_terms(features)), L.cut(L.intro_places(index, features))
    pairs = L.candidate_pairs(index, features, terms, L.cut(L.phrase_hits(index, features)), True, intros)
    assert "hashpartitioning(query_id" not in pairs._jdf.queryExecution().executedPlan().toString()
    assert pairs.filter("query_id = 0").count() < 40 < index.chunks.filter(F.array_contains("tokens", "anna")).count()
    best = lambda prune: sorted(map(tuple, L.lexical_candidates(index, features, 5, prune).select("query_id", "chunk_id", "lpos", "score", "hits", "intro").collect()))
    assert best(True) == best(False) and len(best(True)) >= 15


def test_only_texts_with_the_inner_terms_are_searched_for_a_phrase(spark, monkeypatch):
    chunks, rows = name_chunks(spark)
    phrase = " ".join(rows[11][3].split()[3:9])
    asked = [f'"{phrase[1:-1]}"', '"w1x w2x"', '"ab nothere cd"']
    index, features, _ = H.prepare_queries(spark.createDataFrame(list(enumerate(asked)), "query_id int, query string"), chunks)
    norm = {r.chunk_no: r.n for r in index.chunks.select("chunk_no", T.search_norm("content").alias("n")).collect()}
    want = sorted((f.query_id, k, 1) for f in features.collect() for k, n in norm.items() if any(p in n for p in f.phrases))
    assert sorted(map(tuple, L.phrase_hits(index, features).collect())) == want and want
    monkeypatch.setattr(L, "found_in", None)  # a phrase with inner terms needs no scan of all texts
    assert L.phrase_hits(index, features.filter("query_id <> 1")).count() == sum(q != 1 for q, _, _ in want)


def test_direct_term_pairs_are_not_shuffled(spark, tmp_path):
    rows = [(k, " ".join(f"word{(k * 7 + i * i) % 90}" for i in range(60)) + ".") for k in range(60)]
    spark.createDataFrame([(k, t, "en", "src", len(t)) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, " ".join(f"word{k * 11 + i}" for i in range(6))) for k in range(5)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = registered.queries()["direct_term_top_chunks"](spark, str(tmp_path))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(query_id") == 1 and "WindowGroupLimit" in plan and "hashpartitioning(chunk_no" not in plan
    assert {r.query_id: r["count"] for r in got.groupBy("query_id").count().collect()} == dict.fromkeys(range(5), 4)


def test_windows_are_put_together_from_sentences(spark):
    texts = ["One two of it. Three's a crowd; four' 'five of all!  Is it? \u00a0Yes <channel|> it \u212b \u0301is here now. Short. ", "", "no stop here at all but long enough", "x" * 300 + ". " + "y" * 300 + ". End.",
             "One two of it is here now. One two of it is here now. Caf\u00e9 cafe\u0301 \u2460 \ufb01nd it. \u0301Mark first; \u00a8 odd?"]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, content string")
    got = rows.select("k", F.explode(L.window_units("content")).alias("u")).select("k", "u.*").distinct()
    want = rows.select("k", F.explode(T.sentence_windows("content")).alias("w")).select("k", L.unit("w").alias("u")).select("k", "u.*").distinct()
    form = lambda df: sorted((r.k, r.norm, r.question, *r.tokens) for r in df.collect())
    assert form(got) == form(want) and len(form(got)) > 8

"""Findings of the third round, on small tables."""

import hashlib
import json
import random
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

import __spark_entry__ as registered
from foliant.functions import lists
from foliant.functions import pages as P
from foliant.functions import policy as Y
from foliant.functions import text as T
from foliant.operators import answer as A
from foliant.operators import chat as C
from foliant.operators import ingest as I
from foliant.operators import lexical as L
from foliant.operators import questions as Q
from foliant.operators import retrieve as H
from foliant.operators import vectors as V
from foliant.session import shared_dir


def folder_tables(spark, path):
    """Tables as folders of several files."""
    docs = [(k, f"text {k % 4} of a source " * 9, "en", f"src{k % 2}", 9) for k in range(8)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    turns = [(c, t, "user" if t % 2 == 0 else "assistant", f"message {c} {t}") for c in range(3) for t in range(4)]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(3).write.parquet(f"{path}/conversations.parquet")
    return str(path)


def test_tables_that_are_folders_can_be_streamed(spark, tmp_path):
    d, queries = folder_tables(spark, tmp_path), registered.queries()
    assert queries["r01_streamed_ingest"](spark, d).count() == 4
    assert queries["r01_streamed_chunks"](spark, d).count() == 4
    assert queries["r02_streamed_policy"](spark, d).count() == 12


def test_own_pairs_of_a_text_survive_the_round_trip(spark, tmp_path):
    texts = ["Nthe the end", "Eand and. Hand\nand Handa", "éEarly early Earlyé arlyé", "Sthe  the the"]
    rows = [(k, t) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = registered.queries()["f24_drop_caps"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == rows


def test_change_keys_with_more_than_two_digits(spark):
    rows = [("long", f"n{k}") for k in range(3000)] + [("short", f"n{k}") for k in range(100)] + [("one", "x"), (None, "y")]
    got = {r.corpus: r.change_key for r in I.change_keys(spark.createDataFrame(rows, "corpus string, name string"), run=4).collect()}

    def key(names, digits):
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        runs = {}
        for digest in sorted(sha(json.dumps({"name": n}, separators=(",", ":"))) for n in names):
            runs.setdefault(digest[:digits], []).append(digest)
        ends = {r: sha("".join(x)) for r, x in runs.items()}
        return sha("".join(r + x for r, x in sorted(ends.items()))) if digits else ends[""]

    assert got == {"long": key([f"n{k}" for k in range(3000)], 3), "short": key([f"n{k}" for k in range(100)], 2), "one": key(["x"], 0), None: key(["y"], 0)}


def test_similar_sets_are_whole_and_not_broadcast(spark):
    rng = random.Random(4)
    words = [f"w{k}" for k in range(40)]
    sets = {}
    for k in range(300):
        base = set(rng.sample(words, rng.randint(3, 20))) if k % 3 == 0 or not sets else set(rng.choice(list(sets.values())))
        base ^= set(rng.sample(words, rng.randint(0, 2)))
        if base and base not in sets.values():
            sets[k] = base
    rows = [("d", k, sorted(v)) for k, v in sets.items()]
    table = spark.createDataFrame(rows, "dataset_id string, id long, tokens array<string>")
    for other in (table, table.filter("id % 2 = 0")):
        found = Q.similar_sets(table, other)
        got = {(r.l_id, r.r_id) for r in found.collect()}
        ids = {r.id for r in other.collect()}
        assert got == {(a, b) for a in sets for b in ids if len(sets[a] & sets[b]) >= 0.82 * len(sets[a] | sets[b]) - 1e-12}
        assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_rejection_in_batches_keeps_what_one_batch_keeps(spark):
    from foliant.streaming import jobs as J
    rng = random.Random(5)
    words = [f"w{k}" for k in range(12)]
    rows = [(str(k % 2), str(k), k, " ".join(rng.sample(words, rng.randint(5, 7)))) for k in range(120)]
    table = spark.createDataFrame(rows, "dataset_id string, question_id string, seq long, question string")
    path = f"{shared_dir(spark).rstrip('/')}/asked-{uuid.uuid4().hex}"
    write = J.reject_asked(path)
    write(table.filter("seq < 50"), 0)
    write(table.filter("seq >= 50"), 1)
    once = {r.seq for r in Q.keep_first(table).collect()}
    assert {r.seq for r in spark.read.parquet(path).collect()} == once and 0 < len(once) < 120


def test_rejection_builds_no_table_on_the_driver(spark):
    """No join of a micro-batch is a broadcast, however small its sides are."""
    from foliant.streaming import jobs as J
    table = spark.createDataFrame([("d", str(k), k, f"w{k // 3} x{k // 3} y{k // 3} z{k // 3} u{k // 3} v{k}") for k in range(60)],
                                  "dataset_id string, question_id string, seq long, question string")
    write = J.reject_asked(f"{shared_dir(spark).rstrip('/')}/asked-{uuid.uuid4().hex}")
    store, bus = spark._jsparkSession.sharedState().statusStore(), spark.sparkContext._jsc.sc().listenerBus()
    bus.waitUntilEmpty(30_000)
    seen = {store.executionsList().apply(i).executionId() for i in range(store.executionsList().size())}
    write(table.filter("seq < 30"), 0)
    write(table.filter("seq >= 30"), 1)
    bus.waitUntilEmpty(30_000)
    ran = store.executionsList()
    plans = [x.physicalPlanDescription() for x in (ran.apply(i) for i in range(ran.size())) if x.executionId() not in seen]
    assert any("SortMergeJoin" in p for p in plans) and not any("Broadcast" in p for p in plans)


def test_a_first_batch_meets_no_history(spark, monkeypatch):
    from foliant.streaming import jobs as J

    def never(*_):
        raise AssertionError("nothing was accepted yet")

    monkeypatch.setattr(J, "not_asked_before", never)
    path = f"{shared_dir(spark).rstrip('/')}/asked-{uuid.uuid4().hex}"
    J.reject_asked(path)(spark.createDataFrame([("d", "1", 1, "one two"), ("d", "2", 2, "two one"), ("d", "3", 3, "?")], "dataset_id string, question_id string, seq long, question string"), 0)
    assert [r.seq for r in spark.read.parquet(path).collect()] == [1]


def test_streamed_questions_come_in_many_files(spark, tmp_path, monkeypatch):
    """A micro-batch is not written by one task, and both are whole."""
    from checks import catalog
    rng = random.Random(6)
    words = [f"w{k}" for k in range(9)]
    rows = [(k, t, "user" if t % 2 == 0 else "assistant", " ".join(rng.sample(words, rng.randint(4, 7)))) for k in range(40) for t in range(4)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    base = f"{shared_dir(spark).rstrip('/')}/asked-{uuid.uuid4().hex}"
    monkeypatch.setattr(catalog, "scratch", lambda _: base)
    got = {(r.dataset_id, r.seq) for r in catalog.QUERIES["r05_streamed_questions"](spark, str(tmp_path)).collect()}
    whole = {(r.dataset_id, r.seq) for r in Q.keep_first(catalog.question_rows(spark, str(tmp_path))).collect()}
    assert got == whole and len(got) > 5
    files = spark.read.option("recursiveFileLookup", "true").parquet(f"{base}/in").select(F.input_file_name().alias("f"), "seq").groupBy("f").agg(F.max("seq").alias("top")).collect()
    half = max(r.top for r in files) / 2
    assert sum(r.top < half for r in files) > 1 and sum(r.top >= half for r in files) > 1
    assert spark.read.parquet(f"{base}/accepted").select("batch").distinct().count() == 2


def test_chunks_of_a_batch_come_in_bounded_parts(spark):
    """No batch of chunks is much larger than the limit, however many texts come in one."""
    rows = [(f"n{k}", "p", f"h{k}", "a line of words that is long enough to stay\n" * 3000) for k in range(20)] + [("none", "p", "h", None)]
    table = spark.createDataFrame(rows, "name string, path string, sha256 string, content string").coalesce(1)
    parts = list(I.chunk_batches(iter(table.toArrow().to_batches()), lambda text: text.split("\n")))
    sizes = [sum(map(len, part["content"].to_pylist())) for part in parts]
    assert len(parts) > 2 and max(sizes) < I.BATCH_CHARS + 100
    assert I.recursive_chunks(table, splitter=lambda text, size, overlap: text.split("\n")).count() == 20 * 3000
    whole = list(I.recursive_chunks(table).select("source_name", "chunk_index", "content").collect())
    assert [r.content for r in sorted((r for r in whole if r.source_name == "n3"), key=lambda r: r.chunk_index)] == [
        c for c in I.split_recursively(table.collect()[3].content.strip()) if len(c) >= I.MIN_CHUNK_CHARS]


def test_white_space_is_trimmed_without_patterns(spark):
    white = "\t\n\x0b\x0c\r \x85\xa0      　"
    rows = [(f"{white}a{white}b{white}",), (white,), ("",), ("\x1c a​",), (None,)]
    table = spark.createDataFrame(rows, "t string")
    pattern = F.regexp_replace("t", r"(?U)^\s+|\s+$", "")
    ends = F.regexp_replace("t", r"(?U)\s+$", "")
    assert table.filter(~T.strip("t").eqNullSafe(pattern) | ~T.rstrip("t").eqNullSafe(ends)).count() == 0
    assert "regexp" not in table.select(T.strip("t"))._jdf.queryExecution().optimizedPlan().toString().lower()


def test_a_text_of_one_short_word_is_bad_and_words_are_sorted_once(spark):
    rows = [("the " * 13 + "cat " * 12,), ("the " * 13 + "cat dog " * 7,), ("the " * 12 + "cat dog " * 4,), ("the " * 9 + "of " * 10 + "ab " * 2,)]
    table = spark.createDataFrame(rows, "t string")
    assert [r[0] for r in table.select(P.is_bad_extraction("t")).collect()] == [True, False, False, False]
    plan = table.select(P.is_bad_extraction("t").alias("bad"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1 and "aggregate(" not in plan


def test_page_furniture_with_choices_of_any_shape(spark):
    lines = ["Page 12", "a Page 12", "see AP Photo", "AP photo", "go visit www.a.org now", "right", "left or right", "or left"]
    table = spark.createDataFrame([(x,) for x in lines], "t string")
    got = [r[0] for r in table.select(P.is_boilerplate("t")).collect()]
    assert got == [True, False, True, False, True, False, False, False]
    own = [(r"^left|right$", True), (r"^or (left|none)$", False)]
    assert [r[0] for r in table.select(P.is_boilerplate("t", own, [])).collect()] == [False] * 5 + [True, True, True]


def test_a_batch_of_queries_makes_postings_of_its_own_terms_only(spark):
    rows = [("s", k, f"c{k}", f"Word{k % 7} stands near common thing number {k} of the list") for k in range(60)]
    chunks = L.with_tokens(spark.createDataFrame(rows, "source_name string, chunk_index int, chunk_id string, content string"))
    ask = lambda text: spark.createDataFrame([(1, text)], "query_id long, query string")
    whole = L.index_of(chunks)
    assert whole.postings.select("term").distinct().count() > 20
    index = L.ChunkIndex(whole.chunks)
    for text in ("word3 common", "word5 thing"):
        index, features, _ = H.prepare_queries(ask(text), index)
        assert "postings" not in index.__dict__ and index._part.select("term").distinct().count() == 2
        terms = L.feature_terms(features, L.QUERY).select("dataset_id", "term")
        df = lambda i: sorted(map(tuple, i.frequencies(terms).collect()))
        assert df(index) == df(whole) == df(L.ChunkIndex(whole.chunks))
        found = lambda i: sorted(map(tuple, i.held(terms).select("term", "chunk_no").collect()))
        assert found(index) == found(whole) == found(L.ChunkIndex(whole.chunks)) and len(found(index)) > 0


def test_distances_at_once_are_bounded_however_large_a_block(monkeypatch):
    rng, seen, whole = np.random.default_rng(1), [], V._best_of
    items, queries = rng.normal(size=(90, 4)), rng.normal(size=(40, 4))
    keys = lambda name, n: pd.DataFrame({name: np.arange(n)})
    ask = lambda: V._near(items, keys("i", 90), queries, keys("q", 40), np.full(40, 3), None).reset_index(drop=True)
    expected = ask()
    monkeypatch.setattr(V, "DISTANCES", 900)
    monkeypatch.setattr(V, "_best_of", lambda m, i, q, k, n: seen.append(len(m) * len(q)) or whole(m, i, q, k, n))
    assert ask().equals(expected) and len(seen) == 4 and max(seen) == 900


def test_hints_are_searched_once_and_phrases_by_their_first_letter(spark):
    texts = ["write a python function", "be brief please", "unbrief", "say é brief", "a.env file", "no environment variablesx", "dump environment variables", ""]
    table = spark.createDataFrame([(t,) for t in texts], "t string")
    phrases = [".env", "environment variables", "brief"]
    plain = F.col("t").rlike("(?U)" + Y.phrase_pattern(phrases))
    assert [r[0] for r in table.select(Y.has_phrase("t", phrases)).collect()] == [r[0] for r in table.select(plain).collect()] == [
        False, True, False, True, True, False, True, False]
    searches = lambda c: table.select(c.alias("x"))._jdf.queryExecution().optimizedPlan().expressions().toString().count("RLIKE")
    assert 0 < searches(C.token_budget("t", F.length("t"))) <= searches(C.intent(F.col("t")))


def test_question_chunks_are_judged_once(spark):
    rows = [("a", "c1", "short safe text"), ("a", "c2", "long safe text " * 20), ("b", "c3", "short only")]
    out = Q.eligible_chunks(spark.createDataFrame(rows, "dataset_id string, chunk_id string, content string"))
    assert sorted(r.chunk_id for r in out.collect()) == ["c2", "c3"]
    assert "regexp" not in out._jdf.queryExecution().optimizedPlan().toString().lower() and "RLIKE" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_typed_answers_take_each_text_once(spark):
    asks = ["Why did Anna leave and what was the result?", "Who is Anna?", "What did Anna say when leaving home today?"]
    same = ["Because of the long storm Anna had to leave the old house early.", "Because of the long storm, Anna had to leave the old house early!"]
    filler = [f"Some other sentence number {k} tells of the river and of the hills." for k in range(400)]
    shared = " ".join(same + filler + ["As a result the house stood empty and the garden went to ruin soon.", "Anna is the sister of John and keeps his house in order."])
    plain = "Nothing much happened to anybody in the town on that quiet day."
    q = spark.createDataFrame([(k, asks[k % 3]) for k in range(12)], "query_id int, query string")
    uses = spark.createDataFrame([(k, p, t, 1.0) for k in range(12) for p, t in ((1, 7), (2, 8))], "query_id int, place int, text_id int, relevance double")
    texts = spark.createDataFrame([(7, shared), (8, plain)], "text_id int, content string")
    key = lambda rows: sorted((r.query_id, r.branch, r.answer) for r in rows.collect())
    got = key(A.extractive_answers(q, uses, texts))
    assert got == key(A.extractive_answers(q, uses.join(texts, "text_id").drop("text_id")))
    by = {k: (branch, answer) for k, branch, answer in got}
    assert by[0][0] == "reason" and by[0][1].count("long storm") == 1  # the second sentence has another form
    assert set(by) == {k for k in range(12) if k % 3 != 2}
    # a long text sends on its best sentences only, not all of them
    asked = q.select("query_id", F.col("query").alias("question"), A.wants_reason("query").alias("why"), A.wants_treatment("query").alias("ill"), A.wants_identity("query").alias("who"),
                     T.word_set(T.question_norm("query")).alias("asked"), T.support_terms("query").alias("terms"), A.entity_name("query").alias("entity"))
    rows = uses.join(asked, "query_id").join(texts.select("text_id", A.text_sentences("content").alias("sentences")), "text_id")
    assert A._picks(rows, True).count() <= 5 * uses.count()


def test_whole_scores_are_exact_and_pairs_are_not_shuffled(spark):
    rng = random.Random(9)
    words = [f"word{k}" for k in range(60)] + ["of", "the", "who", "Anna", "Bell"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 30))) + rng.choice(["", "?"]) for _ in range(80)] + ["of the", "", "the of"]
    chunks = spark.createDataFrame([(f"s{k % 7}", k, f"c{k:03d}", t) for k, t in enumerate(texts)], "source_name string, chunk_index int, chunk_id string, content string")
    asked = [" ".join(rng.choice(words) for _ in range(5)) for _ in range(12)] + ['"of the" word1', '"word3 word4" and "the who"', "Who is Anna and what is the role of Anna here?", '"of the"']
    index, features, _ = H.prepare_queries(spark.createDataFrame(list(enumerate(asked)), "query_id int, query string"), chunks)
    whole = L.whole_scores(index, features)
    bare = L.whole_scores(index, features.filter("not has_quote"))  # phrase hits have a shuffle of their own
    assert "hashpartitioning(query_id" not in bare._jdf.queryExecution().executedPlan().toString()
    got = {(r.query_id, r.chunk_no): (r.hits, round(r.whole, 6)) for r in whole.collect()}
    said = L.phrase_hits(index, features).withColumnRenamed("phrases", "hits")
    pairs = features.select("query_id").crossJoin(index.chunks.select("chunk_no")).join(said, ["query_id", "chunk_no"], "left").na.fill(0)
    known = {(r.query_id, r.chunk_no): (r.hits, round(r.whole, 6)) for r in L._pair_scores(index, features, pairs).collect()}
    terms = {r.query_id: set(r.direct) | set(r.expanded) | set(r.entity) for r in features.collect()}
    tokens = {r.chunk_no: set(r.tokens) for r in index.chunks.collect()}
    assert got == {k: v for k, v in known.items() if v[0] or terms[k[0]] & tokens[k[1]]}
    assert any(hits for hits, _ in got.values())

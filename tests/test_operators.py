import random

import numpy as np
from pyspark.sql import functions as F

from foliant.functions import lists
from foliant.functions import text as T
from foliant.operators import answer as A
from foliant.operators import chat as C
from foliant.operators import grade as G
from foliant.operators import ingest as I
from foliant.operators import pages as PG
from foliant.operators import questions as Q
from foliant.operators import retrieve as H
from foliant.operators import vectors as V
from foliant.plans import scans
from foliant.sources import text_files as X


def test_blocked_scans_match_plain_loops(spark):
    rng = random.Random(3)
    rows = [(k, i, rng.randint(0, 9), rng.choice([None, f"h{i}"])) for k in ("a", "b") for i in range(50)]
    df = spark.createDataFrame(rows, "k string, i long, v long, h string")
    sums = {(r.k, r.i): r.s for r in scans.running_sum(df, ["k"], "i", F.col("v"), "s", block=7).collect()}
    back = {(r.k, r.i): r.s for r in scans.running_sum(df, ["k"], "i", F.col("v"), "s", block=7, newest_first=True).collect()}
    held = {(r.k, r.i): r.c for r in scans.carry_forward(df, ["k"], "i", "h", "c", block=7).collect()}
    before = {(r.k, r.i): [m.position for m in r.p] for r in scans.preceding_rows(df, ["k"], "i", ["v"], 5, "p", block=7).collect()}
    for k in ("a", "b"):
        own = [r for r in rows if r[0] == k]
        for i in range(50):
            assert sums[k, i] == sum(r[2] for r in own[:i + 1]) and back[k, i] == sum(r[2] for r in own[i:])
            assert held[k, i] == next((r[3] for r in reversed(own[:i + 1]) if r[3]), None)
            assert before[k, i] == list(range(max(0, i - 5), i))


def test_recursive_chunks_cover_the_text():
    rng = random.Random(5)
    text = "".join(rng.choice(["word ", "longer ", "end. ", "new\n", "para\n\n", "why? "]) for _ in range(2000)).strip()
    chunks = I.split_recursively(text)
    assert all(len(c) <= I.CHUNK_SIZE and c in text for c in chunks) and chunks == [c.strip() for c in chunks]
    starts = [text.index(c) for c in chunks]
    assert starts == sorted(starts) and text.startswith(chunks[0]) and text.endswith(chunks[-1])
    assert I.split_recursively("x" * 3000) == ["x" * 3000]


def test_dataset_ids_follow_json_spacing(spark):
    import hashlib
    import json
    rows = [("c", "É.txt", "p2", "b" * 64), ("c", "a\"q.txt", "p1", "a" * 64)]
    got = I.dataset_ids(spark.createDataFrame(rows, "corpus string, name string, path string, sha256 string")).head()
    payload = json.dumps([{"name": 'a"q.txt', "sha256": "a" * 64}, {"name": "É.txt", "sha256": "b" * 64}], sort_keys=True)
    assert got.dataset_id == hashlib.sha256(payload.encode()).hexdigest()[:16] and got.source_count == 2


def test_corpus_scan_reads_text_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("héllo ".encode() + b"\xff\xfe" + "wörld �".encode())
    (tmp_path / "b.md").write_text("no")
    row = X.read_corpus(spark, str(tmp_path)).collect()
    assert len(row) == 1 and row[0].content == "héllo wörld �" and row[0].name == "a.txt"


def test_reading_order_snaps_lines(spark):
    blocks = [("s", 1, 1, 50.0, 101.0, "B b", 0), ("s", 1, 2, 10.0, 99.0, "A a", 0), ("s", 1, 3, 10.0, 140.0, "C c", 0),
              ("s", 1, 4, 0.0, 0.0, "z", 0), ("s", 1, 5, 0.0, 0.0, "image", 1)]
    df = spark.createDataFrame(blocks, "source string, page int, seq int, x0 double, y0 double, text string, block_type int")
    assert PG.reading_order(df).head().text == "A a\n\nB b\n\nC c"


def test_running_headers_need_pages_and_repeats(spark):
    pages = [("s", i, ("Top line\n" if i < 3 else "") + ("Pair\n" if i < 2 else "") + f"text {i}") for i in range(10)]
    pages += [("t", i, "Every page") for i in range(3)]
    got = PG.running_headers(spark.createDataFrame(pages, "source string, page long, text string")).collect()
    assert [(r.source, r.line) for r in got] == [("s", "Top line")]


def test_sections_carry_over_empty_pages(spark):
    pages = [("s", 1, "THE START\nplain words follow on this page."), ("s", 2, "more plain words on this page."),
             ("s", 3, "Page 3"), ("s", 4, "NEXT PART\nlast plain words.")]
    got = PG.section_pages(spark.createDataFrame(pages, "source string, page long, text string")).orderBy("page").collect()
    assert [(r.page, r.section) for r in got] == [(1, "THE START"), (2, "THE START"), (4, "NEXT PART")]


def test_candidate_limits(one):
    for n, limit in ((200, 32), (100, 24), (50, 18), (10, 12), (0, 8)):
        assert one(H.candidate_limit(F.lit(n))) == limit == H.candidate_limit_value(n)


def test_neighbors_keep_seed_order(spark):
    chunks = spark.createDataFrame([(f"c{i}", "s", i, "x") for i in range(10)], "chunk_id string, source_name string, chunk_index int, content string")
    seeds = spark.createDataFrame([(1, "s", 5, 1), (1, "s", 6, 2)], "query_id int, source_name string, chunk_index int, seed_no int")
    got = H.neighbors(seeds, chunks, ["query_id"], 1).orderBy("place").collect()
    assert [r.chunk_index for r in got] == [4, 5, 6, 7]


def test_nearest_is_exact_both_ways(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, embedding array<double>")
    q = df.withColumnRenamed("id", "query_id")
    matrix = np.array([r[1] for r in rows])
    for bound in (1000, 0):
        got = V.nearest(q, ["query_id"], df, ["id"], 3, broadcast_vectors=bound).collect()
        best = {(r.query_id, r["rank"]): r.id for r in got}
        for i in range(0, 300, 37):
            gaps = np.round(((matrix - matrix[i]) ** 2).sum(1), 6)
            assert [best[i, k] for k in (1, 2, 3)] == np.lexsort((np.arange(300), gaps))[:3].tolist()


def test_pruning_never_changes_candidates(spark):
    from foliant.operators import lexical as L
    rng = random.Random(9)
    words = [f"w{i}x" for i in range(60)]
    text = lambda: " ".join(rng.choice(words) + rng.choice(["", ".", "?", ";"]) for _ in range(90))
    chunks = spark.createDataFrame([(f"c{i:03d}", f"s{i // 4}", i % 4, text()) for i in range(80)],
                                   "chunk_id string, source_name string, chunk_index int, content string")
    queries = spark.createDataFrame([(i, " ".join(rng.sample(words, 6))) for i in range(6)] + [(9, 'what "w1x w2x w3x" and w4x')],
                                    "query_id int, query string")
    index, features, _ = H.prepare_queries(queries, chunks)
    rows = lambda prune: sorted(map(tuple, L.lexical_candidates(index, features, 5, prune).select(
        "query_id", "chunk_id", "lpos", "score", "hits").collect()))
    assert rows(True) == rows(False) and len(rows(True)) > 20


def test_hybrid_plan_has_no_cross_join(spark):
    chunks = spark.createDataFrame([(f"c{i}", "s", i, f"alpha beta gamma {i} and delta words here for everyone") for i in range(8)],
                                   "chunk_id string, source_name string, chunk_index int, content string")
    queries = spark.createDataFrame([(1, "alpha beta")], "query_id int, query string")
    out = H.retrieve(queries, chunks)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert out.count() == 6


def test_top_rows_limit_below_the_shuffle(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("k"), "id")
    plan = scans.top_rows(df, ["k"], [F.col("id")], 2)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_turns_and_budget(spark):
    rows = [(1, i, r, "x" * n) for i, (r, n) in enumerate([("system", 5), ("user", 100), ("assistant", 4000), ("assistant", 300), ("user", 10)])]
    df = spark.createDataFrame(rows, "conv_id int, turn long, role string, content string")
    assert [r.turn_no for r in C.turn_numbers(df).orderBy("turn").collect()] == [1, 1, 1, 2]
    tail = spark.createDataFrame([(1, 1, 100), (1, 2, 4000), (1, 3, 300)], "conv_id int, turn long, n long")
    assert [r.turn for r in C.budgeted_tail(tail, F.col("n")).collect()] == [3]
    big = spark.createDataFrame([(1, 1, 5), (1, 2, 5000)], "conv_id int, turn long, n long")
    assert [r.turn for r in C.budgeted_tail(big, F.col("n")).collect()] == [2]


def test_recall_answer_quotes_history(spark):
    m = "struct<role:string,content:string,names:array<string>>"
    df = spark.createDataFrame([("remember what i asked before", [("user", "Tell me of rivers", [])], "I do not have memory of it")],
                               f"content string, selected array<{m}>, answer string")
    got = C.final_answers(df).head()
    assert got.final_answer == 'I can see this earlier message in the current chat history: "Tell me of rivers"' and not got.blocked


def test_greedy_duplicates_equal_the_sequential_result(spark):
    rng = random.Random(11)
    words = [f"t{i}" for i in range(14)]
    base = [rng.sample(words, 11) for _ in range(6)]
    texts = []
    for _ in range(60):
        picked = list(rng.choice(base))
        for _ in range(rng.randint(0, 2)):
            picked[rng.randrange(len(picked))] = rng.choice(words)
        texts.append(" ".join(picked))
    kept = []
    for seq, t in enumerate(texts):
        own = set(t.split())
        if all(len(own & set(texts[k].split())) / len(own | set(texts[k].split())) < 0.82 for k in kept):
            kept.append(seq)
    df = spark.createDataFrame([("d", i, t) for i, t in enumerate(texts)], "dataset_id string, seq long, question string")
    assert sorted(r.seq for r in Q.keep_first(df).collect()) == kept


def test_speech_question(spark):
    text = 'It rained. asked Anna Bell, while looking up, "where is the old boat now" and left.'
    reply = '"Where is the old boat now" he said. "It sank last winter" replied Tom, "in the great storm".'
    df = spark.createDataFrame([("c1", text), ("c2", reply), ("c3", "no speech")], "chunk_id string, content string")
    got = {r.chunk_id: (r.question, r.model_answer) for r in Q.speech_questions(df).collect()}
    assert got["c1"] == ("What did Anna Bell ask while looking up?", 'Anna Bell asked, "where is the old boat now"')
    assert got["c2"] == ('What did Tom say after hearing "Where is the old boat now"?', 'Tom replied, "It sank last winter in the great storm"')
    assert set(got) == {"c1", "c2"}


def test_grades(spark):
    ref = "The river crosses the green valley near the town"
    rows = [(1, "THE RIVER crosses the green valley near the town", 0.0), (2, "", 0.0), (3, "Nothing of that kind happened", 0.0),
            (4, "river crosses valley", 0.0)]
    df = spark.createDataFrame([(i, "What crosses the valley?", ref, a, s) for i, a, s in rows],
                               "attempt_id int, question string, model_answer string, user_answer string, similarity double")
    ctx = spark.createDataFrame([(i, f"[Excerpt 1 | chunk_id=a | source=b]\n{ref}.") for i in range(1, 5)], "attempt_id int, context string")
    got = {r.attempt_id: (r.score, r.feedback) for r in G.grade(df, ctx).collect()}
    assert got[1] == (10, lists.RUBRIC[10]) and got[2] == (0, lists.NO_ANSWER_FEEDBACK) and got[3][0] == 0
    # three of six reference words and nothing unsupported: a supported answer in fewer words
    assert got[4][0] == 9


def test_similarity_bands(one):
    assert one(G.similarity_score(F.lit(0.76))) == 6 and one(G.similarity_score(F.lit(0.0))) == 0


def test_typed_answers(spark):
    q = spark.createDataFrame([(1, "Who is Jennie?"), (2, "What did Anna say when leaving home?")], "query_id int, query string")
    e = spark.createDataFrame([
        (1, 1, "Jennie is the sister of my old friend John. She is a perfect and enthusiastic housekeeper who sees to everything.", 1.0),
        (2, 1, 'When leaving home Anna said to them, "I will come back soon".', 1.0)], "query_id int, place int, content string, relevance double")
    got = {r.query_id: (r.branch, r.answer) for r in A.extractive_answers(q, e).collect()}
    assert got[1][0] == "identity" and "Jennie is a perfect" in got[1][1]
    assert got[2] == ("speech", 'Anna said, "I will come back soon"')


def test_parse_paths(spark):
    rows = [(1, '```json\n{"status": "supported", "answer": "a b"}\n```'), (2, '{"status": "supported", "answer": "x", "evidence_ids": ["chunk_id=abcdefabcdef-0001"'),
            (3, '{"status": "supported", "answer": "open string'), (4, "Answer: the plain text")]
    got = {r.query_id: r for r in A.parse_responses(spark.createDataFrame(rows, "query_id int, raw_text string")).collect()}
    assert [got[i].parse_path for i in (1, 2, 3, 4)] == ["json", "repaired", "partial", "plain"]
    assert got[2].evidence_ids == ["abcdefabcdef-0001"] and got[4].answer == "the plain text"


def test_replacement_starts_the_answer_over(spark):
    from foliant.streaming.jobs import assembled_batch
    rows = [("s", i, k, t) for i, (k, t) in enumerate([("token", "a"), ("token", "b"), ("replace", "Z"), ("done", "")])]
    assert assembled_batch(spark.createDataFrame(rows, "session_id string, seq long, kind string, text string")).head().answer == "Z"


def test_interaction_rows_append(spark, tmp_path):
    part = spark.createDataFrame([("graded_answer", "s", 7)], "event_type string, session_id string, score int")
    for _ in range(2):
        X.append_interactions(part, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2


def test_quote_words_match_python(one):
    assert one(T.quoted_content(F.lit('He said, “come in,” and "sit".'))) == "come in sit"


def test_streamed_sources_are_written_once(spark, tmp_path):
    from foliant.sources.text_files import with_profile
    from foliant.streaming import jobs as J
    write = J.write_new_sources(str(tmp_path / "sources"))
    batch = lambda *texts: with_profile(spark.createDataFrame([(str(i), "p", t) for i, t in enumerate(texts)], "name string, path string, content string")).drop("modified_at")
    for number, texts in ((0, ["a", "b", "b"]), (1, ["b", "c"]), (1, ["b", "c"]), (2, ["a", "c"])):
        write(batch(*texts), number)
    got = spark.read.parquet(str(tmp_path / "sources")).select("content", "batch").collect()
    assert sorted(map(tuple, got)) == [("a", 0), ("b", 0), ("c", 1)]


def test_equal_distances_keep_k_rows(spark):
    from foliant.operators.vectors import nearest
    items = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(500)], "item long, embedding array<double>")
    queries = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0])], "query long, embedding array<double>")
    for few in (10, 0):
        got = nearest(queries, ["query"], items, ["item"], 4, broadcast_vectors=few).select("query", "item").collect()
        assert sorted(map(tuple, got)) == [(q, i) for q in (1, 2) for i in range(4)]


def test_model_scores_that_are_no_numbers(spark):
    from foliant.operators.grade import _whole_score
    rows = spark.createDataFrame([("7.5",), ("high",), (None,), ("12",), ("",), ("99999999999",)], "score string")
    assert [r[0] for r in rows.select(_whole_score("score")).collect()] == [7, None, 0, 12, None, None]


def test_every_attempt_is_graded_against_its_whole_document(spark, tmp_path):
    from checks import learning, tables
    late = "The harbour master counted seventeen barrels of salted herring that morning."
    long = "Nothing of interest was seen along the northern road today. " * 120 + late
    docs = [(0, long, "en", "web"), (1, long, "en", "web"), (2, "too short", "en", "web")]
    d = str(tmp_path)
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(k, late) for k in range(4)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    c = tables.stored_chunks(spark, d)
    ids = {r["item_id"]: r["source_chunk_ids"] for r in learning.item_chunks(spark, d, c).collect()}
    assert set(ids) == {0, 1} and ids[0] == ids[1] and len(ids[0]) == c.count() > 5
    attempts = learning.attempts(spark, d).join(learning.item_chunks(spark, d, c), "item_id", "left")
    contexts = {r["attempt_id"]: r["context"] for r in G.grading_contexts(attempts, c).collect()}
    assert set(contexts) == set(range(20)) and all(late in x for x in contexts.values())
    assert all(contexts[k].count("chunk_id=") == len(ids[0]) for k in range(10)) and len({contexts[k] for k in range(10, 20)}) == 1
    assert sorted(r["attempt_id"] for r in learning.m18(spark, d).collect()) == list(range(20))
    assert sorted(r["attempt_id"] for r in learning.m18d(spark, d).collect()) == [0, 1, 5, 6, 10, 11, 15, 16]

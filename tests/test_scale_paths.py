"""Paths that keep work bounded: postings, corpora, pivots, automata, stores, streams."""

import random
import time
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.operators import grade as G
from foliant.operators import ingest as I
from foliant.operators import lexical as L
from foliant.operators import phrases as P
from foliant.operators import retrieve as H
from foliant.operators import vectors as V
from foliant.plans.scans import sorted_place
from foliant.session import shared_dir
from foliant.streaming import jobs as J

CHUNKS = "dataset_id string, chunk_id string, source_name string, chunk_index int, content string"


def folder(spark, name):
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def corpora(spark, sizes, seed=5):
    rng = random.Random(seed)
    words = [f"w{i}x" for i in range(40)]
    text = lambda: " ".join(rng.choice(words) + rng.choice(["", "", ".", "?"]) for _ in range(60))
    rows = [(name, f"c{k:03d}", f"s{k // 3}", k % 3, text()) for name, n in sizes.items() for k in range(n)]
    return rows, words, rng


def test_each_corpus_is_searched_as_if_it_were_alone(spark):
    rows, words, rng = corpora(spark, {"big": 90, "small": 9, "other": 45})
    queries = [(i, name, " ".join(rng.sample(words, 6))) for i, name in enumerate(["big", "small", "other", "none", "big"])]
    columns = ["query_id", "rank", "chunk_id", "source_name", "chunk_index", "distance", "relevance"]
    found = H.retrieve(spark.createDataFrame(queries, "query_id int, dataset_id string, query string"), spark.createDataFrame(rows, CHUNKS))
    got = {name: sorted(tuple(r) for r in found.filter(F.col("dataset_id") == name).select(*columns).collect()) for name in ("big", "small", "other", "none")}
    assert got["none"] == []
    for name in ("big", "small", "other"):
        own = spark.createDataFrame([r[1:] for r in rows if r[0] == name], CHUNKS.split(", ", 1)[1])
        asked = spark.createDataFrame([(i, q) for i, c, q in queries if c == name], "query_id int, query string")
        assert got[name] == sorted(tuple(r) for r in H.retrieve(asked, own).select(*columns).collect())


def test_few_pairs_are_scored_exactly(spark):
    """Chunks that share only common words with a query aren't looked at again once the rare ones have set a floor."""
    rng = random.Random(3)
    common, rare = [f"c{i}x" for i in range(12)], [f"r{i}x" for i in range(300)]
    chunks = [("", f"c{k:04d}", f"s{k}", 0, " ".join(rng.sample(common, 9) + rng.sample(rare, 6))) for k in range(400)]
    queries = [(i, " ".join(rng.sample(common, 4) + chunks[i * 7][4].split()[9:15])) for i in range(8)]
    index, features, _ = H.prepare_queries(spark.createDataFrame(queries, "query_id int, query string"), spark.createDataFrame(chunks, CHUNKS))
    terms = L.cut(L.weighted_terms(features.withColumn("limit", F.lit(3))))
    features = features.withColumn("limit", F.lit(3))
    every = L.candidate_pairs(index, features, terms, prune=False).count()
    some = L.candidate_pairs(index, features, terms)
    assert some.count() < every / 4
    best = lambda prune: sorted(map(tuple, L.lexical_candidates(index, features, 3, prune).select("query_id", "chunk_id", "lpos", "score", "hits").collect()))
    assert best(True) == best(False)


def test_postings_hold_every_token_once(spark):
    rows, _, _ = corpora(spark, {"a": 7, "b": 5})
    index = L.index_of(spark.createDataFrame(rows, CHUNKS))
    posted = index.postings.select("dataset_id", "term", F.explode("chunk_nos").alias("chunk_no"))
    held = index.chunks.select("dataset_id", F.explode("tokens").alias("term"), "chunk_no")
    assert posted.exceptAll(held).count() == held.exceptAll(posted).count() == 0 and posted.count() == posted.distinct().count()


@pytest.mark.parametrize("pivot_block", [16, 100])
def test_pivots_rule_out_blocks_but_no_neighbor(spark, monkeypatch, pivot_block):
    monkeypatch.setattr(V, "PIVOT_BLOCK", pivot_block)
    rng = np.random.default_rng(2)
    centers = rng.normal(size=(12, 4)) * 30
    points = [(f"d{i % 3}", i, (centers[i % 12] + rng.normal(size=4)).tolist()) for i in range(600)] + [("d9", 1000, [0.0] * 4), ("d9", 1001, [0.0] * 4)]
    items = spark.createDataFrame(points, "dataset_id string, id long, embedding array<double>")
    queries = items.filter("id % 5 = 0 or id > 600").select("dataset_id", F.col("id").alias("query_id"), (F.col("id") % 4 + 1).cast("int").alias("limit"), "embedding")
    get = lambda bound: sorted(map(tuple, V.nearest(queries, ["dataset_id", "query_id"], items, ["dataset_id", "id"], F.col("limit"), broadcast_vectors=bound, within="dataset_id")
                                   .select("dataset_id", "query_id", "rank", "id", "distance").collect()))
    assert get(0) == get(10_000)
    want = []
    for name, q, limit, v in queries.collect():
        near = sorted((round(max(0.0, float(sum((a - b) ** 2 for a, b in zip(v, w, strict=True)))), 5), i) for c, i, w in points if c == name)
        want += [(name, q, k + 1, near[k][1]) for k in range(min(limit, len(near)))]
    assert [r[:4] for r in get(0)] == sorted(want)


def test_phrases_in_one_scan(spark, monkeypatch):
    rng = random.Random(1)
    phrases = [("a", p) for p in ["ab", "bc d", "abc", "d", "é x", "zz"]] + [("b", "ab"), ("b", "")]
    texts = [(rng.choice("ab"), k, "".join(rng.choice("abcd é xz") for _ in range(rng.randrange(0, 40)))) for k in range(120)] + [("a", 500, None)]
    p, t = spark.createDataFrame(phrases, "c string, phrase string"), spark.createDataFrame(texts, "c string, k int, body string")
    want = sorted((c, k, x) for c, k, body in texts for d, x in phrases if c == d and x and body and x in body)
    for chars in (1 << 20, 3):
        monkeypatch.setattr(P, "AUTOMATON_CHARS", chars)
        assert sorted(map(tuple, P.found_in(p, t, ["c", "k"], "body", "c").collect())) == want
    assert P.found_in(p.limit(0), t, ["c", "k"], "body", "c").count() == 0


def test_compatibility_forms_of_all_characters_in_one_text(spark, one):
    import unicodedata
    chars = [chr(c) for c in (*range(0x20, 0x250), *range(0x2000, 0x2200), *range(0xFB00, 0xFB07), *range(0xFF01, 0xFF60), 0x1D400, 0x1F100)]
    got = spark.createDataFrame([(k, f"-{c}-") for k, c in enumerate(chars)], "k int, c string").select("k", T.compat_form("c").alias("f")).collect()
    for k, form in got:
        want = unicodedata.normalize("NFKC", f"-{chars[k]}-")
        ascii_only = lambda s: "".join(x for x in s if ord(x) < 128 and (x.isalnum() or x in " ?<>|'"))  # what search forms look at
        if any(ord(x) < 128 for x in unicodedata.normalize("NFKC", chars[k])):
            assert ascii_only(form) == ascii_only(want), chars[k]
    assert one(T.compat_form(F.lit("café naïve"))) == "café naïve"


def test_long_texts_are_cut_in_linear_time(spark):
    text = "Ein längerer Text über 😀 vieles. " * 60_000
    rows = spark.createDataFrame([("n", "p", "0" * 64, text)], "name string, path string, sha256 string, content string")
    start = time.time()
    chunks = {r.chunk_index: r.content for r in I.fixed_chunks(rows).select("chunk_index", "content").collect()}
    assert time.time() - start < 60
    body = text.strip()
    assert all(chunks[k] == body[k * 880:k * 880 + 1100].strip() for k in (0, 1, 777, len(chunks) - 1))


# grading

ATTEMPTS = "attempt_id int, question string, model_answer string, user_answer string, source_chunk_ids array<string>"


def graded_rows(spark):
    text = "The red fox lives near the old stone bridge over the river. It hunts at night and sleeps in the day. Nobody in the village has ever seen it."
    chunks = spark.createDataFrame([("a0", "s", 0, text), ("b0", "t", 0, "Ships of the northern fleet sail in spring when the ice is gone from the bay.")], "chunk_id string, source_name string, chunk_index int, content string")
    question, reference = "Where does the red fox live?", "The red fox lives near the old stone bridge."
    rows = [(1, question, reference, "near the old stone bridge lives the red fox", ["a0"]), (2, question, reference, "near the old stone bridge lives the red fox", None),
            (3, question, reference, "In a castle of glass", []), (4, question, reference, "", ["a0"]), (5, question, reference, None, ["gone"])]
    return spark.createDataFrame(rows, ATTEMPTS), chunks


def test_attempts_without_chunks_get_retrieved_contexts(spark):
    attempts, chunks = graded_rows(spark)
    contexts = {r.attempt_id: r.context for r in G.grading_contexts(attempts, chunks).collect()}
    assert contexts[1].count("[Excerpt") == 1 and "fox" in contexts[1]
    assert set(contexts) == {1, 2, 3, 4, 5} and contexts[2] == contexts[3] == contexts[5] and "fox" in contexts[2]


def test_similarities_raise_floors(spark):
    attempts, chunks = graded_rows(spark)
    contexts = G.grading_contexts(attempts, chunks)
    low = {r.attempt_id: r for r in G.grade(attempts, contexts, embedded=False).collect()}
    high = {r.attempt_id: r for r in G.grade(attempts, contexts).collect()}
    assert low[1].similarity == 0 and high[1].similarity > 0.99
    assert all(high[k].floor >= low[k].floor for k in low) and high[4].score == high[5].score == 0
    given = attempts.withColumns({"similarity": F.lit(0.97), "evidence_similarity": F.lit(0.97), "reference_similarity": F.lit(0.0)})
    taken = {r.attempt_id: r for r in G.grade(given, contexts).collect()}
    assert taken[3].similarity == 0.97
    assert sum(taken[k].floor for k in taken) >= sum(low[k].floor for k in low)


def test_a_custom_embedding_is_run_once_per_text(spark):
    attempts, chunks = graded_rows(spark)

    def lengths(batches):
        for batch in batches:
            assert batch["hash"].is_unique
            yield batch.assign(embedding=[[float(len(x)), 1.0] for x in batch["text"]])

    got = {r.attempt_id: r.similarity for r in G.grade(attempts, G.grading_contexts(attempts, chunks), embed_fn=lengths).collect()}
    a, b = len("near the old stone bridge lives the red fox"), len("The red fox lives near the old stone bridge.")
    assert abs(got[1] - (a * b + 1) / np.sqrt((a * a + 1) * (b * b + 1))) < 1e-9


def test_ratios_below_their_bound_are_left_out():
    import pandas as pd
    from difflib import SequenceMatcher
    a, b = "the quick brown fox jumps", "the quick brown fox jumped over"
    exact = SequenceMatcher(None, a, b).ratio()
    got = G._ratios(pd.Series([[a, a, a, "", a]]), pd.Series([[b, b, "zzzz", a, a]]))[0]
    assert got == [exact, exact if exact >= G.LEAST_EVIDENCE_RATIO else 0.0, 0.0, 0.0, 1.0]


# stores and change keys

def sources_of(spark, *names, size=3000):
    rows = [(n, f"/{n}", "%064x" % (hash(n) % 2**200), f"{n} " + "some words of text here. " * (size // 25)) for n in names]
    return spark.createDataFrame(rows, "name string, path string, sha256 string, content string")


def test_a_source_that_is_written_twice_stays_once(spark):
    path, s = folder(spark, "store"), sources_of(spark, "a", "b", "c")
    first = I.reused_chunks(s, path).collect()
    I.write_chunks(I.fixed_chunks(s.limit(2)), path)
    I.write_chunks(I.fixed_chunks(s), path, size=500)
    assert sorted(I.reused_chunks(s, path).collect()) == sorted(first)
    cut_again = []

    def watched(sources, size, overlap):
        cut_again.append(sources.count())
        return I.fixed_chunks(sources, size, overlap)

    more = I.reused_chunks(s.unionByName(sources_of(spark, "d")), path, watched).collect()
    assert cut_again == [1] and len(more) > len(first)


def test_change_keys_of_any_run_length(spark):
    rows = [("big", f"n{k}", k) for k in range(700)] + [("small", "x", 1), (None, "y", None), (None, "y", None)]
    table = spark.createDataFrame(rows, "corpus string, name string, size int")
    for run in (1, 3, 1024):
        keys = lambda df, run=run: {r.corpus: (r.entry_count, r.change_key) for r in I.change_keys(df, run=run).collect()}
        base = keys(table)
        assert {c: n for c, (n, _) in base.items()} == {"big": 700, "small": 1, None: 2}
        assert keys(table.orderBy(F.rand(1)).repartition(7)) == base
        changed = keys(table.withColumn("size", F.when(F.col("name") == "n77", -1).otherwise(F.col("size"))))
        assert changed["big"] != base["big"] and changed["small"] == base["small"] and changed[None] == base[None]
    assert I.change_keys(table.limit(0)).count() == 0


# streams

EVENTS = "session_id string, ts timestamp, seq long, kind string, text string"


def in_turn(spark, *batches):
    path = folder(spark, "in")
    for k, rows in enumerate(batches):
        rows = [(s, seconds, seq, kind, text) for s, seconds, seq, kind, text in rows]
        frame = spark.createDataFrame(rows, "session_id string, s long, seq long, kind string, text string")
        frame.select("session_id", F.timestamp_seconds("s").alias("ts"), "seq", "kind", "text").coalesce(1).write.parquet(f"{path}/{k}")
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(f"{path}/*")


def answers_of(spark, stream):
    out = folder(spark, "out")
    J.run_available(stream, lambda b, i: b.write.mode("overwrite").parquet(f"{out}/{i}"), folder(spark, "state"))
    return sorted(map(tuple, spark.read.schema(J.ANSWER).option("recursiveFileLookup", "true").parquet(out).collect()))


def test_answers_in_event_order_and_given_up_sessions(spark):
    hour = 3600
    stream = in_turn(
        spark,
        [("a", 10, 2, "token", "C"), ("a", 10, 1, "token", "B"), ("b", 11, 0, "token", "lost"), ("c", 12, 0, "token", "x")],
        [("a", 5, 0, "token", "A"), ("a", 20, 3, "done", ""), ("a", 30, 4, "token", "2"), ("a", 31, 5, "done", ""), ("c", 13, 1, "error", ""), ("c", 14, 2, "replace", None), ("c", 15, 3, "done", "")],
        [("-", 5 * hour, 0, "beat", "")],
        [("b", 6 * hour, 1, "token", "new"), ("b", 6 * hour, 2, "done", "")],
        [("-", 12 * hour, 0, "beat", "")])
    assert answers_of(spark, J.assemble_answers(stream, idle="1 hour", late="30 minutes")) == [("a", "2", 1), ("a", "ABC", 3), ("b", "new", 1), ("c", "", 0)]


def test_a_batch_reads_only_the_buckets_of_its_keys(spark):
    path = folder(spark, "seen")
    rows = spark.createDataFrame([(f"n{k}", "p", "x", f"h{k}", 1) for k in range(300)], "name string, path string, content string, sha256 string, size_bytes int")
    write = J.write_new_sources(path)
    write(rows, 0)
    write(rows, 0)
    one = rows.filter("name in ('n7', 'n8')").unionByName(rows.limit(1).withColumn("sha256", F.lit("new")))
    held = J.of_other_batches(one, 1, path, "sha256", "sha256 string")
    plan = held._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan and held.count() < 60
    write(one, 1)
    assert spark.read.parquet(path).count() == 301


def test_sorted_places_of_a_hot_key_are_dense(spark):
    rng = random.Random(9)
    rows = [("hot" if i % 3 else [None, "a", "b"][i // 3 % 3], rng.randrange(40), i) for i in range(900)]
    df = spark.createDataFrame(rows, "k string, size int, id long")
    got = {r.id: r.place for r in sorted_place(df, ["k"], [F.desc("size"), F.col("id")]).collect()}
    for key in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == key), key=lambda r: (-r[1], r[2]))
        assert [got[r[2]] for r in mine] == list(range(1, len(mine) + 1))
    tied = sorted_place(df, ["k"], [F.col("size") * 0], "n").filter("k = 'hot'")
    assert sorted(r.n for r in tied.collect()) == list(range(1, 601))
    assert sorted_place(df.limit(0), ["k"], [F.col("id")]).count() == 0


def test_neighbors_of_whole_corpora_are_placed_as_those_of_lists(spark):
    chunks = spark.createDataFrame(
        [(f"{s}{i}", s, i, "x") for s, n in (("s", 50), ("t", 3)) for i in range(n)],
        "chunk_id string, source_name string, chunk_index int, content string")
    seeds = chunks.select(F.lit(1).alias("query_id"), "source_name", "chunk_index", F.xxhash64("chunk_id").alias("seed_no"))
    few, many = ({r.chunk_id: r.place for r in H.neighbors(seeds, chunks, ["query_id"], 2, whole=w).collect()} for w in (False, True))
    assert few == many and len(many) == 53

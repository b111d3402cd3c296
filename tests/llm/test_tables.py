"""Operators over pages, vectors and conversations, and the pipeline."""

import hashlib
import html
import os
import random
import sys

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from foliant.llm import chat, html_text, mtree, warc  # noqa: E402

# archive


def test_archive_round_trip(spark):
    big, small = "é" * 700, "tiny"
    data = [(1, "u1", big), (5, "u5", big), (3, None, big), (3, None, big), (7, "u7", small), (8, "u8", small), (9, "u9", None), (None, "n", big), (None, "m", "only" * 400), (10, "a\r\nWARC-Type: x", "q" * 1000)]
    pages = spark.createDataFrame([(*r, "x", 1) for r in data], "page_id long, url string, html string, digest string, payload long")
    folder = warc.write(pages)
    back = warc.read(spark, folder).collect()
    assert len(back) == len(data) and all(r["verified"] for r in back)
    got = sorted((str(r["page_id"]), r["record_type"], r["refers_to"], bytes(r["payload"])) for r in back)
    kind = lambda i, h: "revisit" if h == big and i != 5 else "response"
    assert got == sorted((str(i), kind(i, h), "5" if kind(i, h) == "revisit" else None, (h or "").encode()) for i, _, h in data)
    for r in back:
        assert r["payload_digest"] == hashlib.sha1(r["payload"]).hexdigest()
        body = b"" if r["record_type"] == "revisit" else bytes(r["payload"])
        assert bytes(r["record"]) == bytes(r["header"]) + body + b"\r\n\r\n"
        assert f"\r\nContent-Length: {len(body)}\r\n\r\n".encode() in bytes(r["record"])
    assert spark.read.parquet(f"{folder}/payloads").count() == 5
    assert warc.read(spark, warc.write(pages.limit(0))).count() == 0


def test_exported_files_hold_the_records(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "<p>a\r\n\r\nb</p>"), (2, "v", "")], "page_id long, url string, html string")
    folder = warc.write(pages)
    warc.export(spark, folder, str(tmp_path / "out"))
    whole = b"".join(sorted(p.read_bytes() for p in (tmp_path / "out").glob("part-*")))
    records = [bytes(r["record"]) for r in warc.read(spark, folder).collect()]
    assert len(whole) == sum(map(len, records)) and all(r in whole for r in records)


def test_a_lost_payload_is_reported(spark):
    pages = spark.createDataFrame([(1, "u", "x" * 2000)], "page_id long, url string, html string")
    folder = warc.write(pages)
    spark.read.parquet(f"{folder}/payloads").limit(0).write.parquet(f"{folder}-b/payloads")
    spark.read.parquet(f"{folder}/records").write.parquet(f"{folder}-b/records")
    got = warc.read(spark, f"{folder}-b").head()
    assert got["payload"] is None and not got["verified"]


# top-k

def by_force(x, ids, k=5, every=3):
    out = []
    for a in range(len(ids)):
        if ids[a] % every == 0:
            scored = sorted(((-int(x[a] @ x[b]), int(ids[b])) for b in range(len(ids)) if ids[b] != ids[a]))[:k]
            out += [(int(ids[a]), r + 1, i, -s) for r, (s, i) in enumerate(scored)]
    return sorted(out)


@pytest.mark.parametrize("shard, page, queries", [(8192, 256, 1024), (60, 8, 20)])
def test_top_k_matches_brute_force(spark, monkeypatch, shard, page, queries):
    for name, v in (("SHARD", shard), ("PAGE", page), ("QUERIES", queries)):
        monkeypatch.setattr(mtree, name, v)
    rng = np.random.default_rng(1)
    vectors = (rng.normal(size=(10, 6))[rng.integers(0, 10, 300)] + 0.1 * rng.normal(size=(300, 6))).astype(np.float32)
    vectors[100:180] = vectors[100]  # ties
    vectors[:5] = 0
    rows = [(i, v.tolist(), 1, 2) for i, v in enumerate(vectors)]
    odd = [(900, None, 1, 2), (903, [], 1, 2), (906, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1, 2), (909, [float("nan")] * 6, 1, 2), (912, [float("inf")] * 6, 1, 2), (None, [1.0] * 6, 1, 2)]
    frame = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, score long, dims long").repartition(3)
    got = mtree.top_k(frame, frame["vec_id"] % 3 == 0).collect()
    x = np.floor(vectors.astype(float) * 256).astype(int)
    assert sorted(map(tuple, got)) == by_force(x, np.arange(300))


def test_top_k_of_few_vectors(spark):
    frame = spark.createDataFrame([(0, [1.0, 0.0]), (3, [0.5, 0.5]), (3, [0.5, 0.5])], "vec_id long, embedding array<double>")
    assert sorted(map(tuple, mtree.top_k(frame, frame["vec_id"] % 3 == 0).collect())) == [(0, 1, 3, 256 * 128), (0, 2, 3, 256 * 128), (3, 1, 0, 256 * 128)]
    assert mtree.top_k(frame.limit(0), frame["vec_id"] % 3 == 0).count() == 0


def test_bounds_save_distances():
    rng = np.random.default_rng(2)
    x = np.concatenate([c + rng.integers(-3, 4, (500, 8)) for c in rng.integers(-200, 200, (12, 8))])
    longest = float((x * x).sum(axis=1).max())
    pages = {p[0]: p for p in mtree.build(np.arange(len(x)), x, longest)}
    tree = mtree.Tree(pages, longest)
    for q in range(0, len(x), 500):
        got = tree.search(x[q], q, 5, None)
        assert got == sorted(((int(x[q] @ y), i) for i, y in enumerate(x) if i != q), key=lambda p: (-p[0], p[1]))[:5]
    assert tree.computed < 0.7 * 12 * len(x)


# chat

def test_escapes_are_reversible():
    rng = random.Random(0)
    parts = [chat.OPEN, chat.MIDDLE, chat.LEARN, chat.CLOSE, *chat.FOREIGN, "\\", "<", "|", ">", "[", "turn", "a", "\n", "<\\|end|>", "é"]
    for _ in range(2000):
        turns = [("".join(rng.choices(parts, k=rng.randrange(4))) or rng.choice(["user", "assistant"]), "".join(rng.choices(parts, k=rng.randrange(9)))) for _ in range(rng.randrange(4))]
        out = chat.rendered(turns)
        assert chat.parsed(out) == [(r, t, r in chat.LEARNED) for r, t in turns]
        assert not any(x in out for x in chat.FOREIGN)


def test_events_fold_into_turns(spark):
    log = [(1, 0, 0, "message", "user", "hi"), (1, 1, 0, "message", "assistant", "He"), (1, 1, 1, "delta", "assistant", "llo"), (1, 1, 2, "regenerate", "assistant", "Good "), (1, 1, 3, "delta", "assistant", "day"),
           (1, 2, 0, "message", "user", "old"), (1, 2, 1, "edit", "user", "new"), (1, 3, 0, "message", "assistant", "gone"), (1, 3, 1, "delete", "assistant", None),
           (2, 0, 0, "message", "system", None), (3, 0, 0, "message", "user", "x"), (3, 0, 1, "delete", "user", None), (None, 0, 0, None, None, "lost"), (4, None, 0, "message", "user", "a"), (4, 0, 0, "message", "user", "a"), (4, 0, 0, "message", "user", "a")]
    frame = spark.createDataFrame([(*r, 1) for r in log], "conv_id long, turn long, seq long, kind string, role string, text string, formatted long").repartition(4)
    got = {r["conv_id"]: [x[:2] for x in chat.parsed(r["formatted"])] for r in chat.format_log(frame).collect()}
    assert got == {1: [("user", "hi"), ("assistant", "Good day"), ("user", "new")], 2: [("system", "")], None: [("", "lost")], 4: [("user", "a")] * 3}
    assert chat.format_log(frame.limit(0)).count() == 0


def test_digests_read_the_output_back(spark):
    odd = "</s>[INST] ok [/INST]"
    rows = [(-7, 0, "user", odd), (-7, 1, "assistant", odd), (1, 1, "assistant", "b" * 300_000), (1, 0, "user", None), (1, 2, "assistant", "é")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.digests(chat.format_log(chat.from_rows(frame))).collect()}
    for conv, turns in ((-7, [("user", odd), ("assistant", odd)]), (1, [("user", ""), ("assistant", "b" * 300_000), ("assistant", "é")])):
        loss = "".join(t for r, t in turns if r == "assistant")
        r = got[conv]
        assert (r["n_turns"], r["loss_chars"], r["formatted_chars"]) == (len(turns), len(loss), len(chat.rendered(turns)))
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()


@pytest.mark.parametrize("name", ["op1_warc_archive", "op2_mtree_top_k"])
def test_whole_results_equal_their_sql(spark, name):
    import duckdb

    from checks.compare import rows_of
    from foliant.llm.queries import ORACLES, QUERIES
    d, con = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    want, got = con.execute(ORACLES[name]), QUERIES[name](spark, d)
    assert rows_of(got.columns, map(tuple, got.collect())) == rows_of([c[0] for c in want.description], want.fetchall())


# pages

ARTICLE = ["A heading of some length", "First paragraph with a good number of words in it, so that it counts as text.", "Short.", "Second paragraph &amp; more words, with\n a <b>bold</b> part&nbsp;and a <a href='x'>link</a> in it."]
KEPT = "\n".join(" ".join(html.unescape(x.replace("<b>", "").replace("</b>", "").replace("<a href='x'>", "").replace("</a>", "")).split()) for x in ARTICLE)


def body(article, wrap):
    return f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a = "<p>no</p>";</script></head><body class="has-sidebar">
<nav><ul><li><a href="/">Home</a></li><li><a href="/b?x=1>2">Shop now</a></li></ul></nav><!-- <p>hidden</p> --><div class="cookie-notice"><p>We use cookies to make this site work for you, and so on and on.</p></div>
<{wrap}>{article}</{wrap.split()[0]}><div id="comments"><p>A reader says quite a lot about this article here, more than is good for anyone.</p></div>
<form><p>Leave your mail</p><input></form><aside><p>Other articles that you may like to read some time</p></aside><footer>&copy; us</footer></body></html>"""


@pytest.mark.parametrize("wrap", ["article", "main", "div class='content'"])
def test_articles_are_found(wrap):
    inner = f"<h1>{ARTICLE[0]}</h1>" + "".join(f"<p>{x}" + "</p>" * (k % 2) for k, x in enumerate(ARTICLE[1:]))
    assert html_text.main_text(body(inner, wrap)) == KEPT
    assert html_text.main_text(body(inner.replace("<p>Short.", "<p class='ad'>Buy this thing now.</p><p>Short."), wrap)) == KEPT
    assert html_text.main_text(body(inner.replace("<p>Short.", "<div class='ad'><p>Buy this.</p></div><p>Short."), wrap)) == KEPT


def test_lengths_choose_the_block_beside_an_article():
    long = [f"Paragraph {k} of the main text, which goes on for a good number of words so that it counts as text." for k in range(4)]
    main = "".join(f"<p>{x}</p>" for x in long)
    for tag in ("div", "section"):
        assert html_text.main_text(f"<body><{tag}>{main}</{tag}><p><a href='x'>More</a></p><p><a href='x'>All</a></p><p><a href='x'>Top</a></p><article><h3>Next story</h3></article></body>") == "\n".join(long)
        quoted = html_text.main_text(f"<body><{tag}>{main}<article><p>A post.</p></article><p>The end.</p></{tag}></body>")
        assert quoted == "\n".join([*long, "A post.", "The end."])
    # an article that holds most of the text: scraps beside it don't join it, longer text stands by itself, a last short line stays
    ad = "<div class='ad'><p>Buy</p><p>this</p><p>now</p><p>today</p></div>"
    page = f"<body><div>Site name</div><article>{main}{ad}<p>The end.</p></article><div>Print</div></body>"
    assert html_text.main_text(page) == "\n".join([*long, "The end."])
    assert html_text.main_text(page.replace("<div>Print</div>", f"<div><p>{long[0]}</p></div>")) == "\n".join([*long, "The end.", long[0]])


@pytest.mark.parametrize("ahead", [
    "<datalist id='d'><option value='a'><option value='b'></datalist>", "<div><option value='a'></div>", "<svg class='i' viewBox='0 0 1 1'/>", "<svg><title/><style/><path d='M0'/></svg>", "<svg><path d='M0'></p>", "<math/>",
    "<video-player src='x'></video-player>", "<select-menu></select-menu>", "<audio src='x'>", "<object data='x'>", "<noscript><p>Turn scripts on, please, for all that there is to see on this long page of ours.</p></noscript>",
    "<svg><svg></svg><text>no</text></svg>", "<select><option>One<option>Two</select>", "<script-x></script-x><script>if (a</b) '</p>'</script >", "<datalist><select><option>One</select><option>Two</datalist>"])
def test_elements_without_an_end_tag_lose_no_text(ahead):
    first, second = (f"The {x} paragraph of the text, with a good number of words in it, so that it counts as text." for x in ("first", "second"))
    page = f"<body>{ahead}<article><p>{first}</p><p>And <svg/>so on <math><mi>x</mi><mo>=</mo><mn>1</mn></math> <svg><text>no</text></svg>it goes.</p><p>{second}</p></article></body>"
    assert html_text.main_text(page) == f"{first}\nAnd so on x=1 it goes.\n{second}"


def test_raw_text_runs_to_the_end_of_the_page():
    for name in ("script", "style", "textarea", "title", "iframe"):
        assert html_text.main_text(f"<article><p>Some text.</p><{name}><p>no</p>") == "Some text."
    many = "<object><video><svg>" * 20_000
    assert html_text.main_text(f"<article>{many}<p>Some text.</p></article>") == "Some text."


def test_odd_pages(spark):
    long = "<p>word</p>" * 50_000
    pages = [(1, "u", None), (2, None, ""), (3, "u", "no markup at all"), (4, "u", "<p>a < b and c > d <"), (5, "u", "<article><p>cut off in the mid"), (6, "u", f"<main>{long}</main>"), (6, "u", f"<main>{long}</main>"), (None, "u", "<nav>x</nav>")]
    frame = spark.createDataFrame([(*p, "x", 3) for p in pages], "page_id long, url string, html string, text string, n_chars int")
    got = sorted((str(r["page_id"]), r["text"], r["n_chars"]) for r in html_text.extract(frame).collect())
    want = [("1", ""), ("2", ""), ("3", "no markup at all"), ("4", "a < b and c > d"), ("5", "cut off in the mid"), ("6", "\n".join(["word"] * 50_000)), ("6", "\n".join(["word"] * 50_000)), ("None", "")]
    assert [(a, b) for a, b, _ in got][:3] == want[:3] and got[4:] == [(a, b, len(b)) for a, b in want[4:]]
    assert html_text.extract(frame.limit(0)).count() == 0


# pipeline

DOCS = "doc_id long, text string, lang string, source string, n_chars long, extra string, id long"


def test_stages_take_effect(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(4)
    words = "the of and to in is that it for was on are as with his they at be this from have or by one had not but what all were when we there can an your which their said if do will each about how up out them then she many some so these would other into has more her two like him see time could no make than first been its who now people my made over did down only way find use may water long little very after words called just where most know".split()
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    item = prose(40)
    texts = [prose(60) for _ in range(20)]
    texts += [texts[0], texts[1] + " more", f"{prose(30)} {item} {prose(30)}", f"{prose(40)} token = 0123456789abcdef0123456789abcdef {prose(10)}", None, "", "12 34", prose(30_000)]
    rows = [(i, t, "en", None, len(t or ""), "x", 1) for i, t in enumerate(texts)] + [(5, texts[5], "en", None, 1, "y", 2), (None, prose(50), None, None, None, None, None)]
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = {}
    for name, stage in pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = sorted(r["doc_id"] for r in docs.select("doc_id").collect() if r["doc_id"] is not None)
        if name != "pack":
            assert docs.columns == pipeline.COLUMNS
    usual = [i for i in range(28) if i not in (24, 25, 26)]
    assert seen["language"] == sorted([*usual, 5])
    assert seen["near_duplicates"] == [i for i in usual if i not in (20, 21)]
    assert seen["decontaminate"] == seen["secrets"] == [i for i in usual if i not in (20, 21, 22)]
    clean = {r["doc_id"]: r for r in spark.read.parquet(str(tmp_path / "secrets")).collect()}
    assert "[SECRET]" in clean[23]["text"] and "0123" not in clean[23]["text"] and clean[23]["n_chars"] == len(clean[23]["text"])
    assert all(clean[i]["text"] == texts[i] for i in seen["secrets"] if i != 23) and None in clean
    assert sorted(set(seen["pack"])) == seen["secrets"]
    assert pipeline.run(spark, str(tmp_path)).count() == spark.read.parquet(str(tmp_path / "pack")).count()


def test_empty_corpus(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    spark.createDataFrame([], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert pipeline.run(spark, str(tmp_path)).count() == 0


def test_huge_components_take_no_part(spark):
    frame = spark.createDataFrame([(0, [1.0, 2.0]), (3, [1e8, 0.0]), (5, [3e38, 1.0]), (6, [2.0, 1.0])], "vec_id long, embedding array<float>")
    got = mtree.top_k(frame, frame["vec_id"] % 3 == 0).collect()
    assert sorted(map(tuple, got)) == [(0, 1, 6, 4 * 256 * 256), (6, 1, 0, 4 * 256 * 256)]


def test_events_of_other_kinds_and_roles(spark):
    log = spark.createDataFrame([
        (1, 0, 0, "message", "user", "Hi"), (1, 1, 0, "message", "assistant", "Hel"), (1, 1, 1, "delta", "user", "lo"), (1, 1, 2, "rating", "assistant", "thumbs up"),
        (1, 2, 0, "rating", "user", "no turn"), (2, 0, 0, "delta", "assistant", "no start")], "conv_id long, turn long, seq long, kind string, role string, text string")
    got = {r["conv_id"]: [x[:2] for x in chat.parsed(r["formatted"])] for r in chat.format_log(log).collect()}
    assert got == {1: [("user", "Hi"), ("assistant", "Hello")], 2: [("assistant", "no start")]}


def test_long_blocks_of_links_or_named_like_menus_are_text():
    long = "A long paragraph of plain text that goes on for more than eighty characters without any link in it."
    page = f"<body>{{}}<p>{long}</p><div><a href='x'>A paragraph that is one link</a></div><p>{long}</p>{{}}</body>"
    for before, after in (("", ""), ("<article>", "</article>")):
        assert html_text.main_text(page.format(before, after)) == f"{long}\nA paragraph that is one link\n{long}"
    for name, kept in (("related-work", True), ("share-of-voice", True), ("comments", False), ("cookie-notice", False)):
        text = html_text.main_text(f"<article><p>{long}</p><div class='{name}'><p>Short one.</p><p>{long} Own.</p></div></article>")
        assert ("Own." in text) is kept and "Short one." not in text


def test_deep_nesting_takes_linear_time():
    import time
    start = time.time()
    assert html_text.main_text("<div>" * 40_000 + "</li>" * 40_000 + "<p>Some text that is here.</p>") == "Some text that is here."
    assert time.time() - start < 10


def main_text_by_force(lines):
    """The rule on (length, is link) lines without elements of their own: windows of three lines, in and out."""
    weights = [0 if link else n for n, link in lines]
    sums = [sum(weights[k:k + 3]) for k in range(len(lines))]
    least, kept, inside = min(80, max(sums, default=0)) or 80, [], False
    for k, total in enumerate(sums):
        inside = (weights[k] > 0 and total >= least) if not inside else total > 0
        if inside:
            kept.append(k)
    return kept


def test_blocks_between_surge_and_dive_match_brute_force():
    rng = np.random.default_rng(11)
    for _ in range(300):
        lines = [(int(rng.integers(1, 70)), bool(rng.random() < 0.4)) for _ in range(int(rng.integers(0, 14)))]
        texts = ["ab"[k % 2] * n for k, (n, _) in enumerate(lines)]
        page = "".join(f"<p><a href='x'>{t}</a></p>" if link else f"<p>{t}</p>" for t, (_, link) in zip(texts, lines, strict=True))
        assert html_text.main_text(f"<html><body>{page}</body></html>").split("\n") == ([texts[k] for k in main_text_by_force(lines)] or [""])

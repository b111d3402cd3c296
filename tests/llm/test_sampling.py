"""Importance resampling, quality scores and Merkle manifests, against brute force and on odd rows."""

import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from foliant.llm import importance, merkle, quality, wordgrams

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, rank string, tree string, pos long, n long"
ODD = [None, "", " \n\t\n", "A", "ünï Cödé\nñ Ñ", "...", "a\nb\nc\nd e f", "x" * 100 + "\n" + "X" * 100]


def docs_of(spark, rows):
    """rows: (doc_id, text, lang, source, n_chars); other columns clash with names of the operators."""
    return spark.createDataFrame([(*r, "s", "r", "t", -1, -1) for r in rows], DOCS)


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


# importance resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def resampled_by_force(docs, target, orders, buckets, least, percent):
    def bag(text):
        words = WORD.findall(lower(text or ""))
        return len(words), [zlib.crc32(" ".join(words[i:i + k]).encode()) % buckets for k in range(orders[0], orders[1] + 1) for i in range(len(words) - k + 1)]

    bags = [bag(text) for _, text in docs]
    s, t = np.zeros(buckets), np.zeros(buckets)
    for _, own in bags:
        np.add.at(s, own, 1)
    for text in target:
        np.add.at(t, bag(text)[1], 1)
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.sum() + buckets) / ((s[b] + 1) * (t.sum() + buckets)))) for b in range(buckets)]
    rows = []
    for (i, _), (n, own) in zip(docs, bags, strict=True):
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in own)
        rows.append([i, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    fit = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(fit[:len(fit) * percent // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in rows), key=str)


@pytest.mark.parametrize("orders", [(1, 1), (1, 3), (2, 2)])
def test_resampling_matches_brute_force(spark, orders):
    rng = np.random.default_rng(3)
    lines = [" ".join(f"W{rng.integers(30)}" for _ in range(rng.integers(0, 9))) for _ in range(25)]
    texts = ODD + ["\n".join(lines[k] for k in rng.integers(25, size=rng.integers(1, 12))) for _ in range(80)] + [" ".join(["again"] * 30_000)] + ["same line here\n" * 9] * 3
    ids = [None, *range(len(texts) - 2), 5]
    target = [None, "", "w1 w2 w3\nw4 W5", "same line here"]
    got = importance.resample(docs_of(spark, [(i, t, None, None, None) for i, t in zip(ids, texts, strict=True)]), spark.createDataFrame([(t,) for t in target], "text string"), orders=orders, buckets=97, least_words=5, percent=30)
    assert sorted((tuple(r) for r in got.collect()), key=str) == resampled_by_force(list(zip(ids, texts, strict=True)), target, orders, 97, 5, 30)


def test_resampling_of_empty_tables(spark):
    nothing, some = docs_of(spark, []), docs_of(spark, [(1, "a b c " * 9, None, None, None)])
    assert importance.resample(nothing, nothing).count() == 0
    assert importance.resample(nothing, some).count() == 0
    assert [r["n_features"] for r in importance.resample(some, nothing).collect()] == [27]


def test_ties_go_to_the_smaller_id_and_repeats_are_drawn_on_their_own(spark):
    text = " ".join(f"w{k}" for k in range(25))
    got = importance.resample(docs_of(spark, [(7, text, None, None, None)] * 20), docs_of(spark, []))
    assert sorted((r["rank"] or 0) for r in got.collect()) == [0] * 18 + [1, 2]


def test_crcs_of_slices():
    data = np.frombuffer(("abc" * 100).encode(), np.uint8)
    starts, ends = np.array([0, 5, 5, 1, 0]), np.array([3, 5, 6, 299, 48])
    assert wordgrams.crcs(data, starts, ends).tolist() == [zlib.crc32(data[a:b].tobytes()) for a, b in zip(starts, ends, strict=True)]


# quality

def good_and_bad(rng, n):
    words = [f"{a}{b}" for a in ("ta", "ne", "ri", "so") for b in ("lo", "mi", "da", "en", "us")]
    plain = lambda: " ".join(rng.choice(words, 40)).capitalize() + "."
    return [(plain(), 1) if rng.random() < 0.7 else (" | ".join(rng.choice(words, 25)) + " !!! " * int(rng.integers(1, 9)), 0) for _ in range(n)]


def test_held_out_texts_are_told_apart_without_bad_labels(spark):
    pairs = good_and_bad(np.random.default_rng(1), 2000)
    docs = docs_of(spark, [(i, t, None, None, None) for i, (t, _) in enumerate(pairs)])
    labels = spark.createDataFrame([(i, q) for i, (_, q) in enumerate(pairs) if q == 1 and i % 2], "doc_id long, quality int")
    _, prior = quality.train(docs, labels)
    assert abs(prior - 0.7) < 0.1
    got = quality.assess(docs, labels).collect()
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got) and len(held) > 100
    assert np.mean([r["predicted"] == pairs[r["doc_id"]][1] for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got)


def test_labels_of_held_out_documents_change_nothing(spark):
    pairs = good_and_bad(np.random.default_rng(2), 200)
    docs = docs_of(spark, [(i, t, None, None, None) for i, (t, _) in enumerate(pairs)])
    own = [(i, q) for i, (_, q) in enumerate(pairs)]
    out = {r["i"] for r in spark.range(200).select(F.col("id").alias("i")).filter(quality.held_out(F.col("id"))).collect()}
    one = quality.train(docs, spark.createDataFrame(own, "doc_id long, quality int"), sample=50)[0]
    other = quality.train(docs, spark.createDataFrame([(i, 1 - q if i in out else q) for i, q in own], "doc_id long, quality int"), sample=50)[0]
    assert (one == other).all()


def test_quality_of_odd_rows(spark):
    rows = [(i, t, None, None, None) for i, t in enumerate(ODD)] + [(None, "some words", None, None, None), (3, "A", None, None, None)]
    labels = spark.createDataFrame([(1, None), (None, 1), (3, 1), (3, 0), (6, 1), (6, 1), (4, 1)], "doc_id long, quality int")
    got = quality.assess(docs_of(spark, rows), labels).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    assert len({r["score"] for r in got if r["doc_id"] == 3}) == 1
    assert [r["score"] for r in quality.assess(docs_of(spark, rows[:1]), labels.limit(0)).collect()] == [0.5]
    assert quality.assess(docs_of(spark, []), labels).count() == 0


def test_long_texts_are_counted_in_blocks_and_rows_apart():
    long = "many words | here " * 60_000
    both = quality.features(pa.array(["One.", long, None, "two | 2"]))
    alone = np.vstack([quality.features(pa.array([t], pa.string())) for t in ["One.", long, None, "two | 2"]])
    assert np.allclose(both, alone) and np.isfinite(both).all()


def test_risk_gradient_is_the_slope_of_the_risk():
    rng = np.random.default_rng(4)
    p, u, prior = rng.normal(size=5), rng.normal(size=7), 0.4
    loss = lambda z: np.logaddexp(0, -z).mean()
    bad = loss(-u) - prior * loss(-p)
    assert bad > 0
    risk = lambda p, u: prior * loss(p) + loss(-u) - prior * loss(-p)
    d_p, d_u = quality._risk_gradient(p, u, prior)
    e = 1e-6
    assert np.allclose(d_p, [(risk(p + e * k, u) - risk(p - e * k, u)) / 2 / e for k in np.eye(5)])
    assert np.allclose(d_u, [(risk(p, u + e * k) - risk(p, u - e * k)) / 2 / e for k in np.eye(7)])


# Merkle manifest

def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row, text):
    i, _, lang, source, n = row
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, source, lang, n, text)))


def tree_by_force(digests, width):
    proofs, cover = [[] for _ in digests], [[k] for k in range(len(digests))]
    while len(digests) > 1:
        above, covers = [], []
        for a in range(0, len(digests), width):
            run = digests[a:a + width]
            for k in range(len(run)):
                for leaf in cover[a + k]:
                    proofs[leaf].append(("".join(run[:k]), "".join(run[k + 1:])))
            above.append(sha("".join(run)))
            covers.append(sum(cover[a:a + width], []))
        digests, cover = above, covers
    return digests[0], proofs


def manifest_by_force(rows, width=16):
    sources = {}
    for row in rows:
        sources.setdefault(row[3], []).append(row)
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for source in order:
        own = sorted(sources[source], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r, r[1])))
        trees.append((own, *tree_by_force([leaf_of(r, r[1]) for r in own], width)))
    root, above = tree_by_force([t[1] for t in trees], width)
    out = []
    for (own, subroot, proofs), upper in zip(trees, above, strict=True):
        for row, proof in zip(own, proofs, strict=True):
            leaf = leaf_of(row, row[1])
            hit = row[0] is not None and row[1] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0
            value = leaf_of(row, lower(row[1])) if hit else leaf
            for left, right in proof + upper:
                value = sha(left + value + right)
            out.append((row[0], leaf, subroot, root, sha("".join(a + b for a, b in proof + upper)), value, value == root))
    return sorted(out, key=str)


@pytest.mark.parametrize("levels", [1, 2, 3])
def test_manifest_matches_brute_force(spark, levels):
    sizes = {None: 3, "": 1, "b": 17, "ß": 256, "hot": 300, "Z": 16, "one": 1, "c": 257}
    rows, i = [], 0
    for source, n in sizes.items():
        for k in range(n):
            rows.append((i, [None, "", f"Text {k} É", "lower"][k % 4], [None, "en"][k % 2], source, [None, k][k % 3 > 0]))
            i += 1
    rows += [(None, "A", "en", "b", 1), (None, "B", "en", "b", 1), (40, "Again", None, "hot", 2), (40, "Again", None, "hot", 2), (5, "x" * 300_000, None, "hot", 1)]
    got = sorted((tuple(r) for r in merkle.manifest(docs_of(spark, rows).repartition(5), levels=levels).collect()), key=str)
    assert got == manifest_by_force(rows)
    assert {r[6] for r in got} == {True, False}


def test_manifest_of_many_sources_and_a_narrow_tree(spark):
    rows = [(k, f"T{k}", "en", f"s{k % 90}", k) for k in range(200)]
    for width, levels in ((16, 1), (2, 2)):
        got = sorted((tuple(r) for r in merkle.manifest(docs_of(spark, rows), width=width, levels=levels).collect()), key=str)
        assert got == manifest_by_force(rows, width)


def test_manifest_of_few_rows(spark):
    assert merkle.manifest(docs_of(spark, [])).count() == 0
    for rows in ([(0, "T", None, None, None)], [(0, "T", None, None, None), (1, "T", None, "a", None)]):
        assert sorted((tuple(r) for r in merkle.manifest(docs_of(spark, rows)).collect()), key=str) == manifest_by_force(rows)


def test_witnesses_grow_with_their_runs():
    appended = merkle.Appender(2, 2, alone=False)
    values = [merkle.digest(bytes([k])) for k in range(3)]
    appended.append(values[0])
    assert appended.witnesses == [[]]
    appended.append(values[1])
    assert [len(w) for w in appended.witnesses] == [2, 2] and appended.witnesses[0] == [b"", values[1].hex().encode()]
    appended.append(values[2])
    root = appended.root()
    assert [len(w) for w in appended.witnesses] == [4, 4, 4]
    pair = merkle.digest(values[0].hex().encode() + values[1].hex().encode())
    lone = merkle.digest(values[2].hex().encode())
    assert root == merkle.digest(pair.hex().encode() + lone.hex().encode())

"""Many phrases in many texts, in one scan of each text."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of phrases in one automaton; more phrases go to further automata, each with its own scan.
AUTOMATON_CHARS = 8 << 20


def _automaton(rows: list[tuple]) -> ahocorasick.Automaton:
    """Of (corpus, phrase) rows; a phrase's value is the corpora that ask for it."""
    asked: dict[str, list] = {}
    for corpus, phrase in rows:
        asked.setdefault(phrase, []).append(corpus)
    out = ahocorasick.Automaton()
    for phrase, corpora in asked.items():
        out.add_word(phrase, (phrase, frozenset(corpora)))
    out.make_automaton()
    return out


def found_in(phrases: DataFrame, texts: DataFrame, keys: list[str], text: str, within: str) -> DataFrame:
    """The keys of each text and each phrase of its corpus (``within``, one of the keys) that occurs in it as a substring, once.

    ``phrases``: (within, phrase), distinct. They make an Aho-Corasick automaton that is
    broadcast; each text is read once for all of them and only keys and phrases leave the
    scan. The phrases are measured first and dealt out to several automata where one would
    grow over AUTOMATON_CHARS. Null texts and empty phrases are never found.
    """
    spark = phrases.sparkSession
    some = phrases.select(F.col(within).alias("corpus"), "phrase").filter(F.length("phrase") > 0)
    size = some.agg(F.coalesce(F.sum(F.length("phrase")), F.lit(0))).head()[0]
    parts = max(1, -(-size // AUTOMATON_CHARS))
    rows = texts.select(*keys, F.col(text).alias("_text")).filter(F.col("_text").isNotNull())
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys).schema.fields)
    out = None
    for part in range(parts):
        own = some.filter(F.pmod(F.xxhash64("phrase"), F.lit(parts)) == part).collect()  # of about AUTOMATON_CHARS characters
        shared = spark.sparkContext.broadcast(_automaton([tuple(r) for r in own]))

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            automaton = shared.value
            for batch in batches:
                at, said = [], []
                if len(automaton):
                    for k, (corpus, body) in enumerate(zip(batch.column(within).to_pylist(), batch.column("_text").to_pylist(), strict=True)):
                        found = {phrase for _, (phrase, corpora) in automaton.iter(body) if corpus in corpora}
                        at += [k] * len(found)
                        said += sorted(found)
                taken = batch.select(keys).take(pa.array(at, pa.int64()))
                yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(said, pa.string())], [*keys, "phrase"])

        found = rows.mapInArrow(scan, f"{kinds}, phrase string")
        out = found if out is None else out.unionByName(found)
    return out

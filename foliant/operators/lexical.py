"""Lexical scoring of chunks against many queries at once, corpus by corpus.

A corpus is a ``dataset_id``; tables without one are a single corpus. Its chunks are stored
as an index: a chunk table with the distinct tokens of each chunk, and postings, rows of
(corpus, term, block) with the numbers of the chunks that hold the term.

Candidates are found in one scan. The rarest terms of a query come first: their postings
give some chunks, whose exact scores set a floor under the query's candidate list. Then
chunks are dealt out and meet all queries where they lie; of the pairs that share a term
those leave the scan whose score can still reach the floor, equal scores only with a
smaller id. Sentence windows, which need the chunks' texts, are scored in two waves: the
best pairs first, then those that the raised floor leaves. The result is exact; a test
compares it with scoring everything.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import lists
from ..functions import text as T
from ..plans.scans import top_rows
from ..plans.sizing import bounded_broadcast, spread
from ..session import cut, stored
from .phrases import found_in

CHUNK = ["dataset_id", "source_name", "chunk_index", "chunk_id"]
QUERY = ["query_id", "dataset_id"]
FACTS = ["direct", "expanded", "entity", "weights", "phrases", "variant_terms", "description", "role"]
MIN_SCORE = 1.4
SLACK = 1e-6
#: More than sums of the same weights in another order can differ by.
NOISE = 1e-9
#: Weights of a matched term by its class, and what else can add to a score (fixed values).
DIRECT, EXPANDED, ENTITY = 1.35, 0.65, 0.3
PER_VARIANT, DESCRIBED, ROLED, MOST_INTRO = 0.9, 0.8, 1.2, 0.9
#: Chunks of one row of postings at most.
POSTINGS_BLOCK = 8192
#: Postings of the rarest terms that set the first floor, as a multiple of the candidate limit.
LEAD = 60
#: Inner terms that a chunk must hold before its text is searched for a phrase, the rarest ones.
PHRASE_TERMS = 3


# -- queries ---------------------------------------------------------------------------

def query_features(queries: DataFrame, keys: list[str], query: str = "query", single: bool = False,
                   synonyms: dict[str, str] | None = None) -> DataFrame:
    """Terms, phrases, variants and shape flags of each query, one row per query.

    ``single`` treats the text as one variant of a larger query: its own tokens
    only and no phrases.
    """
    none = F.array().cast("array<string>")
    base = queries.select(*keys, F.col(query).alias("query"))
    if single:
        base = base.withColumn("variants", F.array(F.col("query"))).withColumn("phrases", none)
    else:
        base = base.withColumn("variants", T.query_variants("query")).withColumn("phrases", T.quoted_phrases("query"))
    base = base.withColumn("variant_terms", F.filter(
        F.transform("variants", lambda v: T.search_token_set(T.search_norm(v))), lambda s: F.size(s) > 0))
    base = base.withColumn("direct", F.array_distinct(F.flatten("variant_terms")))
    return base.select(
        "*",
        T.expanded_terms("query", "direct", synonyms).alias("expanded"),
        T.entity_tokens("query").alias("entity"),
        T.is_multi_part("query").alias("multi_part"),
        T.is_description_query("query").alias("description"),
        T.is_role_query("query").alias("role"),
        (F.size("phrases") > 0).alias("has_quote"),
    )


def variant_features(features: DataFrame, synonyms: dict[str, str] | None = None) -> DataFrame:
    """Features of variant 2, 3, ... of each multi-part query, those without tokens left out."""
    own = [c for c in QUERY if c in features.columns]
    parts = features.filter("multi_part").select(*own, F.posexplode("variants").alias("variant_no", "variant"))
    out = query_features(parts.filter("variant_no > 0"), [*own, "variant_no"], "variant", True, synonyms)
    return out.filter(F.size("direct") > 0)


def feature_terms(features: DataFrame, keys: list[str]) -> DataFrame:
    """One row per query term with its classes and the variants it belongs to."""
    every = F.array_union(F.array_union(F.col("direct"), F.col("expanded")), F.col("entity"))
    return features.select(*keys, "direct", "expanded", "entity", "variant_terms", F.explode(every).alias("term")).select(
        *keys, "term",
        F.array_contains("direct", F.col("term")).alias("is_direct"),
        F.array_contains("expanded", F.col("term")).alias("is_expanded"),
        F.array_contains("entity", F.col("term")).alias("is_entity"),
        F.filter(F.transform("variant_terms", lambda s, i: F.when(F.array_contains(s, F.col("term")), i)),
                 lambda i: i.isNotNull()).alias("in_variants"),
    )


# -- corpus -----------------------------------------------------------------------------

def scoped(df: DataFrame) -> DataFrame:
    """``df`` with its ``dataset_id``; without one, all rows belong to one corpus."""
    return df if "dataset_id" in df.columns else df.withColumn("dataset_id", F.lit(""))


def with_tokens(chunks: DataFrame) -> DataFrame:
    """Chunks with a number, their distinct search tokens and what scoring needs of their text, to be stored once and searched often."""
    rows = scoped(chunks).withColumn("tokens", T.search_token_set(T.search_norm("content")))
    return rows.withColumns({
        "chunk_no": F.monotonically_increasing_id(), "has_question": F.contains("content", F.lit("?")),
        "description_cue": F.arrays_overlap("tokens", T.words(lists.DESCRIPTION_CUES)),
        "role_cue": F.arrays_overlap("tokens", T.words(lists.ROLE_CUES))})


def chunk_tokens(chunks: DataFrame) -> DataFrame:
    """Chunk key, distinct tokens and question-mark flag; the text itself is left behind."""
    rows = chunks if "tokens" in chunks.columns else with_tokens(chunks)
    return scoped(rows).select(*CHUNK, "tokens", F.contains("content", F.lit("?")).alias("has_question"))


class ChunkIndex:
    """A stored chunk table, its postings and the size of each corpus.

    ``chunks``: as ``with_tokens`` makes them, stored (their numbers must not change any more). Postings of the whole
    vocabulary are made when ``postings`` is first read, for an index that many batches of queries share. One batch asks
    for a small part of it: ``of_terms`` keeps the postings of the batch's terms; without either, ``held`` scans the tokens.
    """

    def __init__(self, chunks: DataFrame) -> None:
        self.chunks = chunks
        self._part: DataFrame | None = None

    def _post(self, held: DataFrame) -> DataFrame:
        block = F.floor(F.col("chunk_no") / POSTINGS_BLOCK).alias("block")
        rows = held.groupBy("dataset_id", "term", block).agg(F.collect_list("chunk_no").alias("chunk_nos"))
        return stored(rows.sortWithinPartitions("dataset_id", "term"))

    def _tokens(self) -> DataFrame:
        return self.chunks.select("dataset_id", "chunk_no", F.explode("tokens").alias("term"))

    @cached_property
    def postings(self) -> DataFrame:
        return self._post(self._tokens())

    @cached_property
    def sizes(self) -> DataFrame:
        return cut(self.chunks.groupBy("dataset_id").agg(F.count("*").alias("total")))

    def of_terms(self, terms: DataFrame) -> ChunkIndex:
        """This index for a batch of queries that asks for these (dataset_id, term) and no others."""
        if "postings" in self.__dict__:
            return self
        out, wanted = ChunkIndex(self.chunks), bounded_broadcast(terms.select("dataset_id", "term").distinct())
        out._part = self._post(self._tokens().join(wanted, ["dataset_id", "term"]))
        return out

    def _posted(self) -> DataFrame | None:
        return self.postings if "postings" in self.__dict__ else self._part

    def held(self, terms: DataFrame) -> DataFrame:
        """(chunk_no and the columns of ``terms``) of every posting of some (dataset_id, term)."""
        posted = self._posted()
        if posted is None:
            return self._tokens().join(bounded_broadcast(terms), ["dataset_id", "term"])
        met = posted.join(bounded_broadcast(terms), ["dataset_id", "term"])
        return met.withColumn("chunk_no", F.explode("chunk_nos")).drop("chunk_nos", "block")

    def frequencies(self, terms: DataFrame) -> DataFrame:
        """Chunks (df) that hold each of some distinct (dataset_id, term)."""
        posted = self._posted()
        rows = self._tokens() if posted is None else posted
        number = F.count("*") if posted is None else F.sum(F.size("chunk_nos"))
        return rows.join(bounded_broadcast(terms), ["dataset_id", "term"]).groupBy("dataset_id", "term").agg(number.alias("df"))

    def keys(self, *columns: str) -> DataFrame:
        return self.chunks.select("chunk_no", *(columns or CHUNK))


def index_of(chunks: DataFrame | ChunkIndex) -> ChunkIndex:
    """The index of a chunk table; one that is indexed or stored with its tokens is taken as it is."""
    if isinstance(chunks, ChunkIndex):
        return chunks
    return ChunkIndex(chunks if "chunk_no" in chunks.columns else stored(with_tokens(chunks)))


def document_frequency(index: ChunkIndex, terms: DataFrame) -> DataFrame:
    """Chunks of each corpus that hold each wanted term (dataset_id, term)."""
    return index.frequencies(terms.select("dataset_id", "term").distinct())


def idf(total, frequency) -> Column:
    return F.log((T.col(total) + 1) / (T.col(frequency) + 1)) + F.lit(1.0)


def term_weights(terms: DataFrame, frequency: DataFrame, sizes: DataFrame) -> DataFrame:
    """Weight and frequency of every wanted (dataset_id, term); a corpus without chunks weighs all terms 1."""
    rows = terms.select("dataset_id", "term").distinct().join(frequency, ["dataset_id", "term"], "left").join(F.broadcast(sizes), "dataset_id", "left")
    df = F.coalesce("df", F.lit(0))
    weight = F.when(F.col("total") > 0, idf(F.col("total").cast("double"), df.cast("double"))).otherwise(1.0)
    return rows.select("dataset_id", "term", weight.alias("weight"), df.alias("df"))


def with_weights(features: DataFrame, keys: list[str], weights: DataFrame) -> DataFrame:
    """Add each query's term weights as one map (as long as the query, not the corpus)."""
    per_query = feature_terms(features, keys).select(*keys, "term").join(weights, ["dataset_id", "term"]).groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct("term", "weight"))).alias("weights"),
        F.map_from_entries(F.collect_list(F.struct("term", "df"))).alias("frequencies"))
    empty = F.create_map().cast("map<string,double>")
    return features.join(per_query, keys, "left").withColumns({
        "weights": F.coalesce("weights", empty), "frequencies": F.coalesce("frequencies", F.create_map().cast("map<string,bigint>"))})


def entity_intro(index: ChunkIndex, features: DataFrame) -> DataFrame:
    """First chunk index of every queried entity per source."""
    asked = features.filter("description or role").select("dataset_id", F.explode("entity").alias("term")).distinct()
    held = index.held(asked).join(index.keys("source_name", "chunk_index"), "chunk_no")
    return held.groupBy("dataset_id", "source_name", "term").agg(F.min("chunk_index").alias("intro_index"))


def intro_bonus(index: ChunkIndex, features: DataFrame, intro: DataFrame) -> DataFrame:
    """Bonus of chunks near the first mention of an entity of the query."""
    asked = features.filter("description or role").select(*QUERY, F.explode("entity").alias("term"))
    held = index.held(asked).join(index.keys("source_name", "chunk_index"), "chunk_no")
    gap = F.abs(F.col("chunk_index") - F.col("intro_index"))
    value = F.when(gap <= 1, MOST_INTRO).when(gap <= 2, 0.6).when(gap <= 4, 0.3).otherwise(0.0)
    return held.join(intro, ["dataset_id", "source_name", "term"]).groupBy("query_id", "chunk_no").agg(F.max(value).alias("intro"))


def intro_places(index: ChunkIndex, features: DataFrame) -> DataFrame:
    """Chunks near the first mention of an entity that some query asks for: dataset_id, term, chunk_no, at, intro."""
    asked = features.filter("description or role").select("dataset_id", F.explode("entity").alias("term")).distinct()
    keys = index.chunks.select("chunk_no", "source_name", "chunk_index", _place("chunk_id").alias("at"))
    held = index.held(asked).join(keys.filter("source_name is not null and chunk_index is not null"), "chunk_no")
    gap = F.col("chunk_index") - F.min("chunk_index").over(Window.partitionBy("dataset_id", "source_name", "term"))
    value = F.when(gap <= 1, MOST_INTRO).when(gap <= 2, 0.6).when(gap <= 4, 0.3)
    return held.select("dataset_id", "term", "chunk_no", "at", value.alias("intro")).filter("intro is not null")


def _place(chunk_id: str) -> Column:
    """A number that orders chunks as their ids do, as far as its bytes go; equal for ids that begin alike."""
    start = F.rpad(F.substring(F.hex(F.encode(chunk_id, "UTF-8")), 1, 14), 14, "0")
    return F.coalesce(F.conv(start, 16, 10).cast("long"), F.lit(0).cast("long"))


# -- scores --------------------------------------------------------------------------------

def combine_score(direct_sum, expanded_sum, entity_sum, direct_n, expanded_n, entity_n, phrases, variants,
                  description, role, description_cue, role_cue, question, bound: bool = False) -> Column:
    """The lexical score of one text. ``bound`` leaves out all that can only lower it."""
    matched = (direct_n + expanded_n + entity_n + phrases) > 0
    score = direct_sum * DIRECT + expanded_sum * EXPANDED + entity_sum * ENTITY + phrases * 5.0
    score = score + F.greatest(variants - 1, F.lit(0)) * PER_VARIANT
    score = score + F.when(description & (entity_n > 0) & description_cue, DESCRIBED).otherwise(0.0)
    score = score + F.when(role & ((entity_n > 0) | (direct_n > 0)) & role_cue, ROLED).otherwise(0.0)
    if not bound:
        score = score - F.when(question, 2.5).otherwise(0.0)
        only_entity = (entity_n > 0) & (direct_n == 0) & (expanded_n == 0) & (phrases == 0)
        score = F.when(only_entity, F.least(score, F.lit(1.15))).otherwise(score)
    return F.when(matched, F.greatest(score, F.lit(0.0))).otherwise(0.0)


def unit(text) -> Column:
    """What scoring needs of a text: struct<norm, tokens, question>."""
    return T.let(T.search_norm(text), lambda norm: F.struct(
        norm.alias("norm"), T.search_token_set(norm).alias("tokens"), F.contains(T.col(text), F.lit("?")).alias("question")))


def window_units(content) -> Column:
    """The ``unit`` of each sentence window of a text (see ``text.sentence_windows``), from those of its sentences: each is brought
    to its normal form once, not with its neighbors again. Equal windows aren't left out."""
    parts = F.transform(T.sentences(content), lambda s: F.struct(F.length(s).alias("size"), unit(s).alias("u")))

    def both(rows):
        def windows(a, i):
            b = F.get(rows, i + 1)
            pair = F.struct((a["size"] + b["size"] + 1).alias("size"), F.struct(
                F.trim(F.concat(a["u"]["norm"], F.lit(" "), b["u"]["norm"])).alias("norm"), F.array_union(a["u"]["tokens"], b["u"]["tokens"]).alias("tokens"),
                (a["u"]["question"] | b["u"]["question"]).alias("question")).alias("u"))
            return F.when(a["size"] + b["size"] + 1 <= T.WINDOW_MOST, F.array(a, pair)).otherwise(F.array(a))

        return F.transform(F.filter(F.flatten(F.transform(rows, windows)), lambda w: w["size"] >= T.WINDOW_LEAST), lambda w: w["u"])

    return T.let(parts, both)


def pair_score(u: Column, f: dict[str, Column] | None = None) -> Column:
    """struct<hits, score> of a ``unit`` against the query features on the same row."""
    f = f or {c: F.col(c) for c in FACTS}
    hits = F.size(F.filter(f["phrases"], lambda p: F.contains(u["norm"], p)))
    cues = {"description_cue": F.arrays_overlap(u["tokens"], T.words(lists.DESCRIPTION_CUES)),
            "role_cue": F.arrays_overlap(u["tokens"], T.words(lists.ROLE_CUES)), "has_question": u["question"]}
    return F.when(F.size(u["tokens"]) == 0, F.struct(F.lit(0).alias("hits"), F.lit(0.0).alias("score"))).otherwise(
        T.let(token_score(u["tokens"], hits, f, cues), lambda s: F.struct(s["hits"].alias("hits"), s["score"].alias("score"))))


def token_score(tokens: Column, hits: Column, f: dict[str, Column], cues: dict[str, Column]) -> Column:
    """struct<hits, score, bound> of a text with these tokens, phrase hits and cues against a query's features."""
    total = lambda shared: F.aggregate(shared, F.lit(0.0), lambda s, t: s + f["weights"][t])

    def scored(p):
        args = (total(p["direct"]), total(p["expanded"]), total(p["entity"]),
                F.size(p["direct"]), F.size(p["expanded"]), F.size(p["entity"]), p["hits"],
                F.size(F.filter(f["variant_terms"], lambda s: F.arrays_overlap(s, tokens))), f["description"], f["role"],
                cues["description_cue"], cues["role_cue"], cues["has_question"])
        return F.struct(p["hits"].alias("hits"), combine_score(*args).alias("score"), combine_score(*args, bound=True).alias("bound"))

    return T.let(F.struct(*[F.array_intersect(f[c], tokens).alias(c) for c in ("direct", "expanded", "entity")], hits.alias("hits")), scored)


def phrase_hits(index: ChunkIndex, features: DataFrame) -> DataFrame:
    """Quoted phrases of each query that occur in a chunk's normal form: query_id, chunk_no, phrases.

    The words between a phrase's first and last are whole words of any text that holds it, so only chunks with its
    rarest inner terms are searched for it. Phrases without inner terms are found by one scan of each text, whatever
    their number: see ``phrases.found_in``.
    """
    asked = features.select(*QUERY, F.explode("phrases").alias("phrase")).filter(F.length("phrase") > 0)
    inner = T.search_token_set(F.regexp_extract("phrase", "(?s)^[^ ]* (.*) [^ ]*$", 1))
    wanted = cut(asked.select("dataset_id", "phrase").distinct().withColumn("inner", inner))
    met = None
    if _has_any(wanted, F.size("inner") > 0):
        terms = cut(wanted.select("dataset_id", "phrase", F.explode("inner").alias("term")))
        # a term that no chunk holds comes first, so that its phrase meets nothing
        rare = terms.join(index.frequencies(terms.select("dataset_id", "term").distinct()), ["dataset_id", "term"], "left").withColumn("df", F.coalesce("df", F.lit(0)))
        rare = top_rows(rare, ["dataset_id", "phrase"], [F.col("df"), F.col("term")], PHRASE_TERMS, "_r")
        rare = cut(rare.withColumn("due", F.count("*").over(Window.partitionBy("dataset_id", "phrase"))).select("dataset_id", "phrase", "term", "due"))
        near = index.held(rare).groupBy("dataset_id", "phrase", "chunk_no").agg(F.count("*").alias("n"), F.first("due").alias("due")).filter("n = due")
        near = cut(near.groupBy("dataset_id", "chunk_no").agg(F.collect_list("phrase").alias("near")))
        few = index.chunks.select("chunk_no", "content").join(bounded_broadcast(near), "chunk_no")
        held = T.let(T.search_norm("content"), lambda norm: F.filter("near", lambda p: F.contains(norm, p)))
        met = few.select("dataset_id", "chunk_no", F.explode(held).alias("phrase"))
    if met is None or _has_any(wanted, F.size("inner") == 0):
        loose = wanted.filter(F.size("inner") == 0).select("dataset_id", "phrase")
        texts = index.chunks.select("dataset_id", "chunk_no", T.search_norm("content").alias("norm"))
        loose = found_in(loose, texts, ["dataset_id", "chunk_no"], "norm", within="dataset_id")
        met = loose if met is None else met.unionByName(loose)
    return met.join(bounded_broadcast(asked), ["dataset_id", "phrase"]).groupBy("query_id", "chunk_no").agg(F.count("*").alias("phrases"))


def _has_any(features: DataFrame, condition) -> bool:
    return len(features.filter(condition).select(F.lit(1)).head(1)) > 0


def weighted_terms(features: DataFrame) -> DataFrame:
    """Query terms with weight, frequency, what a match adds at most, and a mark of the variants they belong to."""
    terms = feature_terms(features, QUERY).join(
        features.select("query_id", "frequencies", F.explode("weights").alias("term", "weight")), ["query_id", "term"])
    bits = F.aggregate("in_variants", F.lit(0).cast("long"), lambda m, i: m.bitwiseOR(
        F.when(i < 63, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))))
    share = lambda flag, value: F.when(F.col(flag), value).otherwise(0.0)
    gain = F.col("weight") * (share("is_direct", DIRECT) + share("is_expanded", EXPANDED) + share("is_entity", ENTITY))
    return terms.withColumns({"variant_bits": bits, "gain": gain, "df": F.element_at("frequencies", F.col("term"))}).drop("frequencies")


#: What scoring needs to know of a text besides its tokens.
CUES = ["has_question", "description_cue", "role_cue"]
SCORED = ["ds", "xs", "es", "dn", "xn", "en", "phrases", "vn", "description", "role", "description_cue", "role_cue", "has_question"]
SUMMED = ["dw", "xw", "ew", "dx_n", "e_n", "in_variants", "variant_bits"]


def _summands(terms: DataFrame) -> DataFrame:
    """``terms`` with what each adds to a text's sums; two counts share one number."""
    weight = lambda flag: F.when(F.col(flag), F.col("weight")).otherwise(0.0)
    one = lambda flag: F.when(F.col(flag), 1).otherwise(0).cast("long")
    return terms.select(
        *QUERY, "term", weight("is_direct").alias("dw"), weight("is_expanded").alias("xw"), weight("is_entity").alias("ew"),
        (one("is_direct") + F.shiftleft(one("is_expanded"), 32)).alias("dx_n"), one("is_entity").alias("e_n"), "in_variants", "variant_bits")


def _sums(features: DataFrame) -> list[Column]:
    """Aggregates over the terms that a query and a text share."""
    # up to 63 variants fit one number, which aggregates far cheaper than lists
    if _has_any(features, F.size("variant_terms") > 63):
        variants = F.size(F.array_distinct(F.flatten(F.collect_list("in_variants"))))
    else:
        variants = F.bit_count(F.bit_or("variant_bits"))
    return [F.sum("dw").alias("ds"), F.sum("xw").alias("xs"), F.sum("ew").alias("es"), F.sum("dx_n").alias("dx_n"), F.sum("e_n").alias("e_n"), variants.alias("vn")]


def _counted(matched: DataFrame) -> DataFrame:
    low = F.lit((1 << 32) - 1)
    return matched.withColumns({"dn": F.col("dx_n").bitwiseAND(low), "xn": F.shiftright("dx_n", 32), "en": F.col("e_n").bitwiseAND(low)})


def _scored(matched: DataFrame, key: list[str], features: DataFrame) -> DataFrame:
    args = [F.col(c) for c in SCORED]
    return matched.join(bounded_broadcast(features.select("query_id", "description", "role")), "query_id").select(
        "query_id", *key, F.col("phrases").cast("int").alias("hits"), combine_score(*args).alias("score"))


def score_units(units: DataFrame, key: list[str], terms: DataFrame, features: DataFrame, pairs: DataFrame, said: DataFrame | None = None) -> DataFrame:
    """Score of every (query, unit) that shares a term or a phrase, among ``pairs`` (query_id, chunk_no).

    ``units``: key, tokens, has_question, description_cue, role_cue; the first key column is the chunk's number. A unit
    only meets the terms of its chunk's queries, by an equi-join on chunk and term. ``said``: query_id, key, phrases.
    """
    base = units.select(*key, *CUES, "tokens")
    held = base.withColumn("term", F.explode("tokens")).drop("tokens")
    met = held.join(pairs.select("query_id", "chunk_no").join(bounded_broadcast(_summands(terms)), "query_id"), ["chunk_no", "term"])
    matched = _counted(met.groupBy("query_id", *key).agg(*_sums(features), *[F.max(c).alias(c) for c in CUES]))
    if said is not None:
        known = base.select(*key, *[F.col(c).alias(f"_{c}") for c in CUES])
        matched = matched.join(said.join(known, key), ["query_id", *key], "full_outer")
        for c in CUES:
            matched = matched.withColumn(c, F.coalesce(c, f"_{c}"))
        matched = matched.na.fill(0)
    else:
        matched = matched.withColumn("phrases", F.lit(0))
    return _scored(matched, key, features)


#: Chunks that meet all queries in one task: the pairs of more would not stay in its hash table.
SCORED_CHUNKS = 1536


def deal(index: ChunkIndex, rows: DataFrame, key: str) -> DataFrame:
    """Rows of the index's chunks dealt out by a key of theirs, so that a task has about SCORED_CHUNKS of its chunks at most."""
    chunks = index.sizes.agg(F.sum("total")).head()[0] or 0
    width = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return rows.repartition(max(width, -(-chunks // SCORED_CHUNKS)), key)


def _dealt(index: ChunkIndex, features: DataFrame, terms: DataFrame, said: DataFrame | None = None, intros: DataFrame | None = None) -> DataFrame:
    """query_id, chunk_no, at, hits, whole, bound, intro of every (query, chunk) pair that shares a term or a phrase.

    There are far more pairs than chunks, so chunks are dealt out by their number before they meet the queries and no
    pair is shuffled: the rows stay dealt by ``chunk_no``. The phrases that a query has in a chunk count as one more
    term, which only that query asks for, and so does a place near the first mention of an entity.
    """
    units = index.chunks.select("chunk_no", "dataset_id", _place("chunk_id").alias("at"), "tokens", *CUES).filter(F.size("tokens") > 0)
    units = deal(index, units, "chunk_no")
    wanted, notes = _summands(terms), []
    item = lambda term, n, intro: F.struct(term.alias("term"), n.cast("long").alias("n"), intro.cast("double").alias("intro"))
    nothing = {c: F.lit(None if c == "in_variants" else 0).cast(wanted.schema[c].dataType) for c in SUMMED}
    none = [v.alias(c) for c, v in nothing.items()]
    if said is not None:
        own = F.concat(F.lit("\0"), F.col("query_id").cast("string"))  # no token has this character
        notes.append(said.select("chunk_no", item(own, F.col("phrases"), F.lit(0)).alias("note")))
        wanted = wanted.unionByName(features.filter("has_quote").select(*QUERY, own.alias("term"), *none))
    if intros is not None:
        near = F.concat(F.lit("\1"), F.col("term"))
        notes.append(intros.select("chunk_no", item(near, F.lit(0), F.col("intro")).alias("note")))
        wanted = wanted.unionByName(features.filter("description or role").select(*QUERY, F.explode("entity").alias("term")).select(*QUERY, near.alias("term"), *none))
    held = F.transform("tokens", lambda t: item(t, F.lit(0), F.lit(0)))
    if notes:
        every = notes[0] if len(notes) == 1 else notes[0].unionByName(notes[1])
        units = units.join(deal(index, every, "chunk_no").groupBy("chunk_no").agg(F.collect_list("note").alias("notes")).hint("merge"), "chunk_no", "left")
        held = F.concat(held, F.coalesce("notes", F.array().cast("array<struct<term:string,n:bigint,intro:double>>")))
    met = units.select("chunk_no", "dataset_id", "at", *CUES, F.inline(held)).join(bounded_broadcast(wanted), ["dataset_id", "term"])
    met = met.withColumn("e_n", F.col("e_n") + F.shiftleft("n", 32))
    matched = met.groupBy("query_id", "chunk_no", "at", *CUES).agg(*_sums(features), F.max("intro").alias("intro"))
    matched = _counted(matched).withColumn("phrases", F.shiftright("e_n", 32))
    args = [F.col(c) for c in SCORED]
    return matched.join(bounded_broadcast(features.select("query_id", "description", "role")), "query_id").select(
        "query_id", "chunk_no", "at", F.col("phrases").cast("int").alias("hits"), combine_score(*args).alias("whole"),
        combine_score(*args, bound=True).alias("bound"), "intro")


def whole_scores(index: ChunkIndex, features: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """Score of every (query, chunk) pair that shares a term or a phrase, not shuffled: as many rows as there are such pairs."""
    terms = cut(weighted_terms(features)) if terms is None else terms
    said = phrase_hits(index, features) if _has_any(features, "has_quote") else None
    return _dealt(index, features, terms, said).select("query_id", "chunk_no", "hits", "whole")


# -- candidates ------------------------------------------------------------------------------

def _pair_scores(index: ChunkIndex, features: DataFrame, pairs: DataFrame) -> DataFrame:
    """Exact whole score and bound of given (query_id, chunk_no, hits) pairs, from the chunks' stored tokens."""
    facts = [c for c in FACTS if c != "phrases"]
    tokens = index.chunks.select("chunk_no", _place("chunk_id").alias("at"), "tokens", "has_question", "description_cue", "role_cue")
    rows = pairs.join(tokens, "chunk_no").join(bounded_broadcast(features.select("query_id", *facts)), "query_id").filter(F.size("tokens") > 0)
    scored = token_score(F.col("tokens"), F.col("hits"), {c: F.col(c) for c in facts}, {c: F.col(c) for c in ("has_question", "description_cue", "role_cue")})
    return rows.select("query_id", "chunk_no", "at", "hits", scored.alias("s")).select("query_id", "chunk_no", "at", "hits", F.col("s.score").alias("whole"), F.col("s.bound").alias("bound"))


def _top(pairs: DataFrame) -> DataFrame:
    """Pairs with the most that their windows can bring them to; those that stay below the least score go."""
    top = F.col("bound") + F.least("bound", "whole") * 0.2 + F.col("intro")
    return pairs.withColumn("top", top).filter((F.col("hits") > 0) | (F.col("top") >= MIN_SCORE - SLACK))


def _floors(scored: DataFrame, features: DataFrame, score: Column) -> DataFrame:
    """query_id, floor (hits, score, at) of the last row that its limit lets in; queries with fewer rows have none.

    ``score``: what a row's score, which is rounded, is at least.
    """
    rows = scored.join(bounded_broadcast(features.select("query_id", "limit")), "query_id").withColumn("_s", F.round(score - NOISE, 6))
    last = top_rows(rows, ["query_id"], [F.col("hits").desc(), F.col("_s").desc(), F.col("at")], F.col("limit"), "_r").filter("_r = limit")
    return last.select("query_id", F.struct("hits", F.col("_s").alias("score"), "at").alias("floor"))


def _reaching(pairs: DataFrame, floors: DataFrame) -> DataFrame:
    """Pairs that can still get into their query's list; of equal scores the smaller id comes first."""
    floor, top = F.col("floor"), F.round(F.col("top") + NOISE, 6)
    # few get as far as the rounding
    better = (F.col("top") >= floor["score"] - SLACK) & (
        (top > floor["score"] + SLACK / 2) | ((top >= floor["score"] - SLACK / 2) & (F.col("at") <= floor["at"])))
    open_ = floor.isNull() | (F.col("hits") > floor["hits"]) | ((F.col("hits") == floor["hits"]) & better)
    return pairs.join(bounded_broadcast(floors), "query_id", "left").filter(open_).drop("floor")


def _lead_floors(index: ChunkIndex, features: DataFrame, terms: DataFrame, intros: DataFrame | None) -> DataFrame:
    """Floors under the queries' lists from some chunks: those with the rarest terms, and those that first mention an entity.

    Any chunks will do, as a floor that is lower only leaves more pairs: of a term that is in very many chunks, a part is looked at.
    """
    limits = bounded_broadcast(features.select("query_id", "limit"))
    before = Window.partitionBy("query_id").orderBy(F.desc("gain"), "term").rowsBetween(Window.unboundedPreceding, -1)
    ranked = terms.join(limits, "query_id").withColumn("df_before", F.coalesce(F.sum("df").over(before), F.lit(0)))
    rare = ranked.filter(F.col("df_before") < F.col("limit") * LEAD).withColumn("step", F.greatest(F.lit(1), F.floor(F.col("df") / (F.col("limit") * LEAD))))
    lead = index.held(cut(rare.select("query_id", "dataset_id", "term", "gain", "step"))).filter(F.pmod("chunk_no", "step") == 0)
    first = lead.groupBy("query_id", "chunk_no").agg(F.sum("gain").alias("sum")).join(limits, "query_id")
    first = top_rows(first, ["query_id"], [F.desc("sum"), F.col("chunk_no")], F.col("limit") * 2).select("query_id", "chunk_no")
    if intros is not None:
        most = features.agg(F.max("limit")).head()[0] or 0
        told = top_rows(intros, ["dataset_id", "term"], [F.desc("intro"), F.col("at")], most)
        asked = features.filter("description or role").select(*QUERY, F.explode("entity").alias("term"))
        first = first.union(cut(told).join(bounded_broadcast(asked), ["dataset_id", "term"]).select("query_id", "chunk_no")).distinct()
    first = cut(first)
    best = _pair_scores(index, features, first.withColumn("hits", F.lit(0))).withColumn("intro", F.lit(0.0))
    if intros is not None:
        own = first.join(bounded_broadcast(asked), "query_id").join(intros.drop("at"), ["dataset_id", "term", "chunk_no"])
        own = own.groupBy("query_id", "chunk_no").agg(F.max("intro").alias("near"))
        best = best.join(own, ["query_id", "chunk_no"], "left").withColumn("intro", F.coalesce("near", F.lit(0.0))).drop("near")
    best = top_rows(best.join(limits, "query_id"), ["query_id"], [F.desc(F.col("whole") * 1.2 + F.col("intro")), F.col("at")], F.col("limit"))
    best = cut(best.select("query_id", "chunk_no", "at", "hits", "whole", "intro"))
    return _floors(_final_scores(index, best, features, terms).withColumn("hits", F.lit(0)), features, F.col("score"))


def candidate_pairs(index: ChunkIndex, features: DataFrame, terms: DataFrame, said: DataFrame | None = None, prune: bool = True,
                    intros: DataFrame | None = None) -> DataFrame:
    """Pairs among which each query's best ``limit`` chunks are, as ``_dealt`` has them, with ``top``, the most they can score.

    ``terms``: as ``weighted_terms``, written. ``said``: query_id, chunk_no, phrases. ``intros``: as ``intro_places``, written.
    Without ``prune`` all pairs (query_id, chunk_no, hits) that share a term or a phrase, from the postings.
    """
    if prune:
        floors = cut(_lead_floors(index, features, terms, intros))
        pairs = _dealt(index, features, terms, said, intros).join(bounded_broadcast(floors), "query_id", "left")
        # most pairs go by their bound alone
        least = F.greatest(F.lit(MIN_SCORE), F.coalesce("floor.score", F.lit(MIN_SCORE))) - SLACK
        pairs = pairs.filter((F.col("hits") > 0) | (F.col("bound") * 1.2 + F.col("intro") >= least)).drop("floor")
        return _reaching(_top(pairs), floors)
    pairs = index.held(terms.select("query_id", "dataset_id", "term")).select("query_id", "chunk_no").distinct()
    if said is None:
        return pairs.withColumn("hits", F.lit(0))
    return pairs.join(said, ["query_id", "chunk_no"], "full_outer").select("query_id", "chunk_no", F.coalesce("phrases", F.lit(0)).cast("int").alias("hits"))


def window_scores(index: ChunkIndex, pairs: DataFrame, features: DataFrame, terms: DataFrame) -> DataFrame:
    """Best window (phrase hits, then score) of the given (query_id, chunk_no, hits) pairs.

    Windows are built once per chunk and then meet the few queries that want it.
    """
    # of a window's tokens only those count that a query of its chunk asks for: the others go before they are rows
    asked = pairs.select("query_id", "chunk_no").join(bounded_broadcast(terms.select("query_id", "term")), "query_id")
    asked = asked.groupBy("chunk_no").agg(F.collect_set("term").alias("asked"))
    texts = spread(index.chunks.select("chunk_no", "content").join(asked, "chunk_no"), "chunk_no")
    units = texts.select("chunk_no", "asked", F.posexplode(window_units("content")).alias("window_no", "u"))
    units = units.filter(F.size("u.tokens") > 0).select(
        "chunk_no", "window_no", "u.norm", F.array_intersect("u.tokens", "asked").alias("tokens"), F.col("u.question").alias("has_question"),
        F.arrays_overlap("u.tokens", T.words(lists.DESCRIPTION_CUES)).alias("description_cue"), F.arrays_overlap("u.tokens", T.words(lists.ROLE_CUES)).alias("role_cue"))
    key = ["chunk_no", "window_no"]
    said = None
    if _has_any(features, "has_quote"):
        # a window can only hold phrases its chunk holds
        quoting = pairs.filter("hits > 0").select("query_id", "chunk_no")
        phrases = features.select("query_id", F.explode("phrases").alias("phrase"))
        said = units.select(*key, "norm").join(bounded_broadcast(quoting), "chunk_no").join(bounded_broadcast(phrases), "query_id").filter(
            F.contains("norm", F.col("phrase"))).groupBy("query_id", *key).agg(F.count_distinct("phrase").alias("phrases"))
    scored = score_units(units, key, terms, features, pairs, said)
    return scored.groupBy("query_id", "chunk_no").agg(F.max(F.struct("hits", "score")).alias("window"))


def _final_scores(index: ChunkIndex, pairs: DataFrame, features: DataFrame, terms: DataFrame) -> DataFrame:
    """query_id, chunk_no, whole, best_window, intro, score, hits of pairs (query_id, chunk_no, hits, whole, intro)."""
    nothing = F.struct(F.lit(0).alias("hits"), F.lit(0.0).alias("score"))
    rows = pairs.withColumnRenamed("hits", "whole_hits").join(
        window_scores(index, pairs, features, terms), ["query_id", "chunk_no"], "left").withColumn("window", F.coalesce("window", nothing))
    best = F.col("window.score")
    return rows.select(
        "query_id", "chunk_no", *[c for c in ("at",) if c in pairs.columns], "whole", best.alias("best_window"), "intro",
        F.round(F.greatest(best, F.col("whole") * 0.75) + F.least(best, F.col("whole")) * 0.2 + F.col("intro"), 6).alias("score"),
        F.greatest(F.col("whole_hits"), F.col("window.hits")).cast("int").alias("hits"))


def lexical_candidates(chunks: DataFrame | ChunkIndex, features: DataFrame, limit: Column | int | None = None, prune: bool = True) -> DataFrame:
    """Best ``limit`` chunks per query by (phrase hits, lexical score); by default each query's own ``limit`` column.

    Columns: query_id, chunk key, score, hits, whole, best_window, intro, lpos.
    """
    index = index_of(chunks)
    if limit is not None:
        features = features.withColumn("limit", F.lit(limit) if isinstance(limit, int) else limit)
    terms = cut(weighted_terms(features))
    said = cut(phrase_hits(index, features)) if _has_any(features, "has_quote") else None
    nearing = _has_any(features, "(description or role) and size(entity) > 0")
    if prune:
        intros = cut(intro_places(index, features)) if nearing else None
        columns = ["query_id", "chunk_no", "at", "hits", "whole", "intro"]
        pairs = cut(candidate_pairs(index, features, terms, said, True, intros).select(*columns, "top"))
        pairs = cut(_reaching(pairs, _floors(pairs, features, F.col("whole") * 0.75 + F.col("intro"))))
        wave = pairs.join(bounded_broadcast(features.select("query_id", "limit")), "query_id")
        wave = cut(top_rows(wave, ["query_id"], [F.desc("hits"), F.desc(F.round("top", 6)), F.col("at")], F.col("limit") * 2).select(*columns))
        first = cut(_final_scores(index, wave, features, terms))
        rest = pairs.join(wave.select("query_id", "chunk_no"), ["query_id", "chunk_no"], "left_anti")
        rest = cut(_reaching(rest, _floors(first, features, F.col("score"))).select(*columns))
        scored = first.unionByName(_final_scores(index, rest, features, terms))
    else:
        pairs = _pair_scores(index, features, candidate_pairs(index, features, terms, said, False))
        bonus = intro_bonus(index, features, entity_intro(index, features)) if nearing else None
        pairs = pairs.withColumn("intro", F.lit(0.0)) if bonus is None else pairs.join(bonus, ["query_id", "chunk_no"], "left").withColumn("intro", F.coalesce("intro", F.lit(0.0)))
        scored = _final_scores(index, cut(_top(pairs).select("query_id", "chunk_no", "hits", "whole", "intro")), features, terms)
    kept = scored.filter((F.col("hits") > 0) | (F.col("score") >= MIN_SCORE - SLACK))
    kept = kept.join(index.keys(), "chunk_no").drop("chunk_no", "at").join(bounded_broadcast(features.select("query_id", "limit")), "query_id")
    best = top_rows(kept, ["query_id"], [F.col("hits").desc(), F.col("score").desc(), F.col("chunk_id"), F.col("source_name")], F.col("limit"), "lpos")
    return best.select("query_id", *CHUNK, "score", "hits", "whole", "best_window", "intro", "lpos")

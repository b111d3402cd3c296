"""Hybrid retrieval: fusion of vector and lexical candidates, expansion, ranking, contexts.

A query asks one corpus (``dataset_id``); sizes, weights, limits, neighbors and ranks are
those of that corpus. Tables without the column are one corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..plans.scans import sorted_place, top_rows
from ..plans.sizing import bounded_broadcast
from ..session import cut
from .lexical import (CHUNK, FACTS, QUERY, ChunkIndex, document_frequency, feature_terms, index_of, lexical_candidates, pair_score,
                      query_features, scoped, term_weights, unit, variant_features, with_weights)
from .vectors import best_relevance, embed, nearest

TOP_K = 4
NEARBY = 10


def candidate_limit(corpus_size: Column | int, top_k: int = TOP_K) -> Column:
    """Candidates per list, by corpus size."""
    n = F.lit(corpus_size) if isinstance(corpus_size, int) else corpus_size
    band = lambda factor, low, high: F.least(F.greatest(F.lit(top_k * factor), F.lit(low)), F.lit(high))
    return (
        F.when(n >= 180, band(6, 32, 64)).when(n >= 80, band(5, 24, 48)).when(n >= 40, band(4, 18, 32))
        .when(n > 0, F.least(F.greatest(F.lit(top_k * 3), F.lit(12)), F.greatest(n, F.lit(12))))
        .otherwise(F.greatest(F.lit(top_k * 2), F.lit(8))))


def candidate_limit_value(n: int, top_k: int = TOP_K) -> int:
    for least, factor, low, high in ((180, 6, 32, 64), (80, 5, 24, 48), (40, 4, 18, 32)):
        if n >= least:
            return min(max(top_k * factor, low), high)
    return min(max(top_k * 3, 12), max(n, 12)) if n else max(top_k * 2, 8)


def neighbors(seeds: DataFrame, chunks: DataFrame, keys: list[str], window: Column | int = 1,
              whole: bool = False) -> DataFrame:
    """Chunks of the same source within ``window`` places of a seed, each once, in seed order.

    ``seeds``: keys, source_name, chunk_index, seed_no. Where both sides have a dataset_id,
    sources of equal names in different ones are different sources. The offsets are spelled
    out, so the range condition becomes an equi-join on (source, index).

    A retrieved list has few seeds, and each key's places are numbered in one task. With
    ``whole`` a key's seeds may be a whole corpus; places are then numbered in ranges.
    """
    w = F.lit(window) if isinstance(window, int) else window
    source = [c for c in ("dataset_id", "source_name") if c in seeds.columns and c in chunks.columns]
    wanted = seeds.select(*keys, *source, "seed_no", F.explode(
        F.transform(F.sequence(-w, w), lambda o: F.struct((F.col("chunk_index") + o).alias("at"), o.alias("offset")))).alias("p"))
    first = wanted.groupBy(*keys, *source, F.col("p.at").alias("chunk_index")).agg(
        F.min(F.struct("seed_no", "p.offset")).alias("first_seen"))
    found = chunks.join(bounded_broadcast(first), [*source, "chunk_index"])
    if whole:
        return sorted_place(found, keys, [F.col("first_seen")]).drop("first_seen")
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("first_seen"))
    return found.withColumn("place", place).drop("first_seen")


def merge_lists(lists_: list[DataFrame], query: str = "query_id") -> DataFrame:
    """Union of ranked lists: first-seen order, and for each chunk the copy with the higher relevance."""
    tagged = [part.withColumn("_list", F.lit(i)) for i, part in enumerate(lists_)]
    rows = tagged[0]
    for part in tagged[1:]:
        rows = rows.unionByName(part)
    body = [c for c in rows.columns if c not in (query, "chunk_id", "place", "_list")]
    merged = rows.groupBy(query, "chunk_id").agg(
        F.max_by(F.struct(*body), F.struct("relevance", (-F.col("_list")).alias("l"), (-F.col("place")).alias("p"))).alias("_row"),
        F.min(F.struct("_list", "place")).alias("_first"))
    order = F.row_number().over(Window.partitionBy(query).orderBy("_first"))
    return merged.select(query, "chunk_id", *[F.col("_row")[c].alias(c) for c in body], order.alias("place"))


def as_retrieved(chunks: DataFrame, relevance: float) -> DataFrame:
    return chunks.withColumn("distance", F.lit(max(0.0, 1.0 - relevance))).withColumn("relevance", F.lit(relevance))


def nearby_support(keys: list[str]) -> Column:
    """Other rows of the same source within ten places."""
    window = Window.partitionBy(*keys, "source_name").orderBy("chunk_index").rangeBetween(-NEARBY, NEARBY)
    return F.count("*").over(window) - 1


def prepare_queries(queries: DataFrame, chunks: DataFrame | ChunkIndex, query: str = "query", top_k: int = TOP_K,
                    synonyms: dict[str, str] | None = None):
    """The chunk index, and query and variant features with their corpus's weights, both as written tables.

    The query features also have their corpus's ``total`` of chunks and its candidate ``limit``. The index serves
    these queries; for others its ``chunks`` or the index given are to be prepared again.
    """
    index = index_of(chunks)
    features = cut(query_features(scoped(queries), QUERY, query, synonyms=synonyms))
    parts = cut(variant_features(features, synonyms))
    wanted = cut(feature_terms(features, QUERY).select("dataset_id", "term").union(
        feature_terms(parts, [*QUERY, "variant_no"]).select("dataset_id", "term")).distinct())
    index = index.of_terms(wanted)
    weights = cut(term_weights(wanted, document_frequency(index, wanted), index.sizes))
    sized = with_weights(features, QUERY, weights).join(bounded_broadcast(index.sizes), "dataset_id", "left").withColumn("total", F.coalesce("total", F.lit(0)))
    return index, cut(sized.withColumn("limit", candidate_limit(F.col("total"), top_k))), cut(with_weights(parts, [*QUERY, "variant_no"], weights))


def vector_candidates(features: DataFrame, vectors: DataFrame, embed_fn=None) -> DataFrame:
    """Best relevance per (query, chunk) over the query's variants, in first-seen order (vpos).

    ``vectors``: chunk key and embedding.
    """
    variants = features.select(*QUERY, "limit", F.posexplode("variants").alias("variant_no", "variant"))
    hits = nearest(embed(variants, "variant", embed_fn), [*QUERY, "variant_no"], vectors, CHUNK, F.col("limit"), within="dataset_id")
    best = best_relevance(hits, "query_id", CHUNK)
    return best.withColumn("vpos", F.row_number().over(Window.partitionBy("query_id").orderBy("first_seen", *CHUNK))).drop(
        "first_seen")


def fuse(vector: DataFrame, lexical: DataFrame) -> DataFrame:
    """Full outer fusion with relevances; lexical relevance is relative to the query's best."""
    both = vector.join(lexical.select("query_id", *CHUNK, "score", "hits", "lpos"), ["query_id", *CHUNK], "full_outer")
    top = F.max("score").over(Window.partitionBy("query_id"))
    return both.withColumn("lmax", top).select(
        "query_id", *CHUNK, F.coalesce("distance", F.lit(1.0)).alias("distance"),
        F.coalesce("relevance", F.lit(0.0)).alias("v"),
        F.when(F.col("lmax") > 0, F.coalesce("score", F.lit(0.0)) / F.col("lmax")).otherwise(0.0).alias("l"),
        F.coalesce("hits", F.lit(0)).alias("hits"), "vpos", "lpos")


def expand(fused: DataFrame, features: DataFrame, top_k: int = TOP_K, neighbor_window: int | None = None) -> DataFrame:
    """Candidates plus the positions around the seeds, with the best seed support of each position."""
    flags = features.select("query_id", "has_quote", "multi_part", "description", "role", "total", "limit")
    rows = fused.join(bounded_broadcast(flags), "query_id")
    first = Window.partitionBy("query_id").orderBy(F.coalesce("lpos", F.lit(1 << 30)), "vpos")
    lead = max(top_k + 2, 6)
    is_seed = F.when(F.col("has_quote"), F.row_number().over(first) <= F.greatest(F.col("limit"), F.lit(top_k + 2))).otherwise(
        (F.coalesce("lpos", F.lit(1 << 30)) <= lead) | (F.coalesce("vpos", F.lit(1 << 30)) <= lead))
    seeds = rows.withColumn("_seed", is_seed).filter("_seed")
    wide = F.lit(neighbor_window) if neighbor_window is not None else F.when(
        F.col("multi_part") | (F.col("total") >= 40) | F.col("description"), 2).otherwise(1)
    around = seeds.select(
        *QUERY, "source_name", F.greatest("v", "l").alias("support"),
        F.explode(F.transform(F.sequence(-wide, wide), lambda o: F.col("chunk_index") + o)).alias("chunk_index"))
    around = around.groupBy(*QUERY, "source_name", "chunk_index").agg(F.max("support").alias("support"))
    return rows.drop("has_quote", "multi_part", "description", "role", "total", "limit").join(
        around, [*QUERY, "source_name", "chunk_index"], "full_outer").withColumnRenamed("chunk_id", "_candidate")


def rank_candidates(expanded: DataFrame, chunks: DataFrame, features: DataFrame) -> DataFrame:
    """Bonuses, combined score, relevance and global rank of every candidate."""
    flags = features.select("query_id", "has_quote", "multi_part", "description", "role", "total")
    texts = chunks.select(*CHUNK, "content")
    rows = texts.join(bounded_broadcast(expanded), ["dataset_id", "source_name", "chunk_index"]).join(
        bounded_broadcast(flags), "query_id")
    in_expansion = F.col("support").isNotNull()
    only_expansion = in_expansion & F.col("_candidate").isNull()
    neighbor = F.when(only_expansion, F.greatest(F.lit(0.1), F.least(F.lit(0.22), F.col("support") * 0.38))).otherwise(0.0)
    rows = rows.na.fill({"distance": 1.0, "v": 0.0, "l": 0.0, "hits": 0}).withColumn(
        "nearby", nearby_support(["query_id"]))
    cluster = F.least(F.lit(0.14), F.col("nearby") * 0.045)
    quoted = F.greatest("v", "l") + F.when(F.col("hits") > 0, 0.8).otherwise(0.0)
    plain = F.col("v") * 0.6 + F.col("l") * 0.4 + F.when(F.col("description") | F.col("role"), F.col("l") * 0.08).otherwise(0.0)
    rows = rows.withColumn("combined", F.round(F.when(F.col("has_quote"), quoted).otherwise(plain) + neighbor + cluster, 6))
    rows = rows.withColumn("relevance", F.round(F.greatest("v", "l", F.when(in_expansion, 0.34).otherwise(0.0)), 6))
    order = Window.partitionBy("query_id").orderBy(
        F.desc("hits"), F.desc("combined"), F.desc("relevance"), "chunk_id", "source_name")
    return rows.withColumn("global_rank", F.row_number().over(order)).drop("_candidate", "vpos", "lpos", "support")


def variant_picks(ranked: DataFrame, parts: DataFrame) -> DataFrame:
    """For each part of a multi-part query, its best candidate by own score and nearby support."""
    facts = parts.select("query_id", "variant_no", F.struct(*FACTS).alias("f"))
    score = pair_score(F.col("unit"), {c: F.col("f")[c] for c in FACTS})["score"]
    scored = ranked.select("query_id", *CHUNK, unit("content").alias("unit"), "nearby").join(facts, "query_id").select(
        "query_id", "variant_no", *CHUNK,
        F.round(score + F.least(F.lit(4.0), F.col("nearby") * 2.0), 6).alias("own"))
    return top_rows(scored, ["query_id", "variant_no"], [F.desc("own"), F.col("chunk_id"), F.col("source_name")], 1).groupBy(
        "query_id", *CHUNK).agg(F.min("variant_no").alias("slot"))


def finish(ranked: DataFrame, picks: DataFrame, top_k: int = TOP_K) -> DataFrame:
    """Reserved part picks first, then the global ranking, cut to the query's limit."""
    limit = F.when(F.col("multi_part") | (F.col("total") >= 40), top_k + 2).otherwise(max(top_k, 6))
    order = Window.partitionBy("query_id").orderBy(F.coalesce("slot", F.lit(1 << 30)), "global_rank")
    return ranked.join(picks, ["query_id", *CHUNK], "left").withColumn("rank", F.row_number().over(order)).filter(
        F.col("rank") <= limit).select("query_id", "rank", *CHUNK, "content", F.round("distance", 6).alias("distance"), "relevance")


def retrieve(queries: DataFrame, chunks: DataFrame | ChunkIndex, vectors: DataFrame | None = None, top_k: int = TOP_K,
             neighbor_window: int | None = None, embed_fn=None, synonyms: dict[str, str] | None = None,
             query: str = "query") -> DataFrame:
    """Batch hybrid retrieval: queries (query_id, query) against the chunks of their corpora.

    With a ``dataset_id`` on both sides each query only meets the chunks of its own; a query
    of a corpus without chunks gets none. Returns query_id, rank, chunk key, content, distance, relevance.
    """
    index, features, parts = prepare_queries(queries, chunks, query, top_k, synonyms)
    if vectors is None:
        known = ["tokens"] if embed_fn is None else []
        vectors = embed(index.chunks.select(*CHUNK, "content", *known), "content", embed_fn)
    lexical = lexical_candidates(index, features)
    fused = fuse(vector_candidates(features, scoped(vectors), embed_fn), lexical)
    expanded = expand(fused, features, top_k, neighbor_window)
    ranked = cut(rank_candidates(expanded, index.chunks, features))
    return finish(ranked, variant_picks(ranked, parts), top_k)


# -- contexts -----------------------------------------------------------------------------

def excerpt_block(number, chunk_id, source_name, content) -> Column:
    return F.concat(F.lit("[Excerpt "), T.col(number).cast("string"), F.lit(" | chunk_id="), T.col(chunk_id),
                    F.lit(" | source="), T.col(source_name), F.lit("]\n"), T.col(content))


def joined_blocks(rows: DataFrame, order: str, block: Column, out: str = "context") -> DataFrame:
    """Blocks of one query in order; as many as the query's result limit."""
    return rows.groupBy("query_id").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), block.alias("b")))), lambda s: s["b"]), "\n\n").alias(out))


def build_context(retrieved: DataFrame) -> DataFrame:
    return joined_blocks(retrieved, "rank", excerpt_block("rank", "chunk_id", "source_name", "content"))


def focused_excerpts(queries: DataFrame, retrieved: DataFrame, max_excerpts: int = 6, max_chars: int = 360,
                     keep_extra: bool = False, synonyms: dict[str, str] | None = None, query: str = "query") -> DataFrame:
    """Best sentence windows of each query's retrieved chunks, as (query_id, excerpt_no, chunk_id, source_name, text).

    A part of a multi-part query gets its best window first; then windows by
    score, at most two per chunk and ``max_excerpts`` in all. ``keep_extra`` lets
    one more through when the parts alone already fill the limit.
    """
    features = query_features(queries, ["query_id"], query, synonyms=synonyms)
    parts = variant_features(features, synonyms)
    hits = retrieved.select("query_id", "rank", "chunk_id", "source_name", "content", "relevance",
                            T.search_token_set(T.search_norm("content")).alias("tokens"))
    own = hits.groupBy("query_id").agg(F.count("*").alias("total"))

    def weighted(table: DataFrame, keys: list[str]) -> DataFrame:
        terms = feature_terms(table, keys)
        held = hits.select("query_id", F.explode("tokens").alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("df"))
        local = terms.join(held, ["query_id", "term"], "left").join(own, "query_id").withColumn(
            "weight", F.log((F.col("total") + 1.0) / (F.coalesce("df", F.lit(0)) + 1.0)) + 1.0)
        maps = local.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("term", "weight"))).alias("weights"))
        return table.join(maps, keys, "left").withColumn("weights", F.coalesce("weights", F.create_map().cast("map<string,double>")))

    texts = hits.select("query_id", "rank", "chunk_id", "source_name", "relevance",
                        F.posexplode(T.sentence_windows("content")).alias("window_no", "window")).withColumn("unit", unit("window"))

    def scored(table: DataFrame, keys: list[str], boost: float) -> DataFrame:
        rows = texts.join(weighted(table, keys), "query_id").withColumn("s", pair_score(F.col("unit"))["score"]).filter("s > 0")
        return rows.select(*keys, "rank", "window_no", "chunk_id", "source_name",
                           F.round(F.col("s") + F.col("relevance") * boost, 6).alias("score"),
                           T.strip(F.substring("window", 1, max_chars)).alias("text"))

    windows = scored(features, ["query_id"], 1.1)
    usable = windows.select("query_id").distinct()
    first = top_rows(scored(parts, ["query_id", "variant_no"], 1.0), ["query_id", "variant_no"],
                     [F.desc("score"), F.col("rank"), F.col("window_no")], 1).join(usable, "query_id", "left_semi")
    first = first.groupBy("query_id", "text").agg(F.min_by(F.struct("variant_no", "chunk_id", "source_name"), "variant_no").alias("b"))
    reserved = top_rows(first.select("query_id", "text", "b.variant_no", "b.chunk_id", "b.source_name"), ["query_id"],
                        [F.col("variant_no")], max_excerpts, "n")
    entry = F.struct("chunk_id", "source_name", "text")
    start = reserved.groupBy("query_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("n", entry.alias("e")))), lambda r: r["e"]).alias("start"))
    # windows of one query: its result limit times the windows of a chunk
    ranked = windows.groupBy("query_id").agg(F.transform(
        F.reverse(F.array_sort(F.collect_list(F.struct("score", "chunk_id", "source_name", "text")))),
        lambda r: F.struct(r["chunk_id"].alias("chunk_id"), r["source_name"].alias("source_name"), r["text"].alias("text"))).alias("ranked"))
    none = F.array().cast("array<struct<chunk_id:string,source_name:string,text:string>>")
    lists_ = ranked.join(start, "query_id", "left").withColumn("start", F.coalesce("start", none))

    def take(picked, x):
        same_chunk = F.size(F.filter(picked, lambda p: p["chunk_id"] == x["chunk_id"]))
        known = F.exists(picked, lambda p: p["text"] == x["text"])
        room = F.size(picked) < max_excerpts
        if keep_extra:
            room = room | (F.size(picked) == F.size("start"))
        return F.when(room & ~known & (same_chunk < 2), F.array_append(picked, x)).otherwise(picked)

    picked = lists_.select("query_id", F.posexplode(F.aggregate("ranked", F.col("start"), take)).alias("n", "e")).select(
        "query_id", "n", "e.chunk_id", "e.source_name", "e.text")
    whole = retrieved.join(usable, "query_id", "left_anti").filter(F.col("rank") <= max_excerpts).select(
        "query_id", F.col("rank").alias("n"), "chunk_id", "source_name", F.col("content").alias("text"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("n"))
    return picked.unionByName(whole).select("query_id", place.alias("excerpt_no"), "chunk_id", "source_name", "text")


def focused_context(queries: DataFrame, retrieved: DataFrame, **options) -> DataFrame:
    rows = focused_excerpts(queries, retrieved, **options)
    return joined_blocks(rows, "excerpt_no", excerpt_block("excerpt_no", "chunk_id", "source_name", "text"))


def unique_sources(rows: DataFrame, order: str = "rank") -> DataFrame:
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(order, "source_name"))), lambda s: s["source_name"])
    return rows.groupBy("query_id").agg(F.array_distinct(ordered).alias("source_names"))

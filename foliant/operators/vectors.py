"""Embedding slot, vector reuse and exact nearest neighbours."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import cosine, relevance, search_norm, search_token_set
from ..plans.scans import top_rows
from ..plans.sizing import bounded_broadcast, is_small
from ..session import stored

EMBED_BATCH = 24
#: Distances computed at once, at most.
QUERY_BLOCK, DISTANCES = 1024, 4 << 20
BROADCAST_VECTORS = 20_000
#: Items around one pivot, about; more share a pivot in parts of so many, and queries of a block come in parts of as
#: many. Where nothing is ruled out, each side is sent once per part of the other. Pivots are broadcast.
PIVOT_BLOCK, MOST_PIVOTS = 16384, 4096
#: Distances are rounded to six places, squared ones before their root is taken.
ROUNDING = 1e-6


# -- embedding slot -------------------------------------------------------------------------

def hash_embedding(batches: Iterator[pd.DataFrame], dim: int = 64) -> Iterator[pd.DataFrame]:
    """Default offline embedding: token counts by hash bucket, scaled to length one.

    Expects ``tokens``; the bucket of a token is its first four MD5 hex digits modulo ``dim``.
    """
    seen: dict[str, int] = {}

    def bucket(token: str) -> int:
        place = seen.get(token)
        if place is None:
            if len(seen) > 1_000_000:
                seen.clear()
            place = seen[token] = int(hashlib.md5(token.encode()).hexdigest()[:4], 16) % dim
        return place

    for batch in batches:
        vectors = []
        for tokens in batch["tokens"]:
            counts = np.bincount([bucket(t) for t in tokens], minlength=dim).astype("float64")
            norm = math.sqrt(float((counts * counts).sum()))
            vectors.append((counts / norm if norm else counts).tolist())
        yield batch.drop(columns=["tokens"]).assign(embedding=vectors)


def embed(texts: DataFrame, text: str, embed_fn: Callable | None = None) -> DataFrame:
    """Add ``embedding`` to every row; rows in equals rows out.

    ``embed_fn`` maps batches with a ``text`` column (blank for empty texts) to the
    same rows with ``embedding``. Without one, the offline hash embedding is used.
    """
    keep = [c for c in texts.columns if c != text]
    fields = [f for f in texts.schema.fields if f.name in keep]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", embedding array<double>"
    if embed_fn is None:
        tokens = F.col("tokens") if "tokens" in keep else search_token_set(search_norm(text))
        keep = [c for c in keep if c != "tokens"]
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields if f.name in keep) + ", embedding array<double>"
        body = texts.select(*keep, tokens.alias("tokens"))
        return body.mapInPandas(hash_embedding, schema)
    body = texts.select(*keep, F.when(F.length(text) > 0, F.col(text)).otherwise(F.lit(" ")).alias("text"))

    def checked(batches):
        for batch in batches:
            for start in range(0, len(batch), EMBED_BATCH):
                part = batch.iloc[start:start + EMBED_BATCH]
                out = pd.concat(list(embed_fn(iter([part]))))
                if len(out) != len(part):
                    raise ValueError("embedding provider returned an unexpected number of vectors")
                yield out[[*keep, "embedding"]]

    return body.mapInPandas(checked, schema)


# -- reuse -------------------------------------------------------------------------------------

def vector_plan(chunks: DataFrame, stored: DataFrame, model: str) -> DataFrame:
    """Per source: whether all its chunk vectors can be reused as they are."""
    want = chunks.select("source_sha256", "source_path", "chunk_id", F.sha2("content", 256).alias("content_sha256"))
    have = (stored.filter(F.col("embedding_model") == model)
            .select("source_sha256", "chunk_id", "content_sha256").distinct().withColumn("_have", F.lit(True)))
    return (want.join(have, ["source_sha256", "chunk_id", "content_sha256"], "left")
            .groupBy("source_sha256", "source_path")
            .agg(F.bool_and(F.col("_have").isNotNull()).alias("reusable"), F.count("*").alias("chunk_count")))


def missing_vectors(chunks: DataFrame, stored: DataFrame, model: str) -> DataFrame:
    """Chunks of every source with at least one missing or stale vector."""
    stale = vector_plan(chunks, stored, model).filter("not reusable").select("source_sha256", "source_path")
    return chunks.join(stale, ["source_sha256", "source_path"], "left_semi")


# -- nearest neighbours --------------------------------------------------------------------------

def _best_of(matrix: np.ndarray, items: pd.DataFrame, queries: np.ndarray, keys: pd.DataFrame, k: int) -> pd.DataFrame:
    """Nearest ``k`` rows of one block for each query row; equal distances go by the items' keys."""
    gaps = np.maximum(
        (queries * queries).sum(1)[:, None] + (matrix * matrix).sum(1)[None, :] - 2.0 * (queries @ matrix.T), 0.0)
    gaps = np.round(gaps, 6)
    if matrix.shape[0] > k:
        limit = np.partition(gaps, k - 1, axis=1)[:, k - 1]
        rows, cols = np.nonzero(gaps <= limit[:, None])
        place = np.empty(len(items), np.int64)
        place[items.reset_index(drop=True).sort_values(list(items.columns), kind="stable").index] = np.arange(len(items))
        order = np.lexsort((place[cols], gaps[rows, cols], rows))
        rows, cols = rows[order], cols[order]
        first = np.searchsorted(rows, np.arange(gaps.shape[0]))
        best = np.arange(len(rows)) - first[rows] < k
        rows, cols = rows[best], cols[best]
    else:
        rows, cols = np.indices(gaps.shape).reshape(2, -1)
    own = [c for c in keys.columns if c not in items.columns]
    out = pd.concat([keys[own].iloc[rows].reset_index(drop=True), items.iloc[cols].reset_index(drop=True)], axis=1)
    out["distance"] = gaps[rows, cols]
    return out


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype="float64")


def _near(matrix: np.ndarray, items: pd.DataFrame, queries: np.ndarray, keys: pd.DataFrame, limits: np.ndarray, within: str | None) -> pd.DataFrame:
    """As ``_best_of`` with a limit per query; with ``within`` a query meets only items that share that key's value."""
    parts = []
    groups = [(np.arange(len(items)), np.arange(len(keys)))] if within is None else [
        (np.flatnonzero((items[within] == value).to_numpy()), np.flatnonzero((keys[within] == value).to_numpy())) for value in items[within].unique()]
    for own, asked in groups:
        step = max(1, min(QUERY_BLOCK, DISTANCES // max(1, len(own))))
        for start in range(0, len(asked), step):
            part = asked[start:start + step]
            block = _best_of(matrix[own], items.iloc[own].reset_index(drop=True), queries[part], keys.iloc[part].reset_index(drop=True), int(limits[part].max()))
            parts.append(block)
    return pd.concat(parts) if parts else pd.DataFrame()


#: Key and distances of an item's or a query's pivots.
_TO_PIVOT = "pivot int, gap double"


def _to_pivots(pivots, vector: str, nearest_only: bool):
    """Adds to each row its nearest pivot and the distance to it, or the distances to all pivots."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        centers = pivots.value
        for batch in batches:
            if batch.empty:
                continue
            points = _matrix(batch[vector])
            gaps = np.sqrt(np.maximum((points * points).sum(1)[:, None] + (centers * centers).sum(1) - 2.0 * points @ centers.T, 0.0))
            if nearest_only:
                yield batch.assign(pivot=gaps.argmin(axis=1).astype("int32"), gap=gaps.min(axis=1))
            else:
                yield batch.assign(gaps=gaps.tolist())
    return run


def _by_pivots(q: DataFrame, v: DataFrame, query_cols: list[str], item_cols: list[str], within: str | None, columns: list[str], schema: str) -> DataFrame:
    """Partial nearest lists of many queries: items in blocks around pivots, (query, block) pairs ruled out by the triangle inequality.

    Items are dealt to their nearest of about |items| / PIVOT_BLOCK pivots, at most MOST_PIVOTS.
    A query first meets the nearest blocks that together hold its limit (of its corpus); its
    worst distance there is a radius, and it goes on only to blocks whose pivot is no farther
    than that radius plus the block's own. Blocks and the queries that want them are cut into
    parts of PIVOT_BLOCK items and queries, of which each pair is one group.
    """
    spark = v.sparkSession
    count = v.count()
    wanted = min(MOST_PIVOTS, max(1, math.ceil(count / PIVOT_BLOCK)))
    chosen = v.orderBy(F.xxhash64(*item_cols), *item_cols).limit(wanted).select("i_vector").collect()
    if not chosen:
        return spark.createDataFrame([], schema)
    pivots = spark.sparkContext.broadcast(np.array([r[0] for r in chosen], dtype="float64"))
    corpus = [within] if within else []
    names = lambda df, drop=(): ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name not in drop)
    dealt = stored(v.mapInPandas(_to_pivots(pivots, "i_vector", True), f"{names(v)}, {_TO_PIVOT}"))
    blocks = dealt.groupBy(*corpus, "pivot").agg(F.max("gap").alias("radius"), F.count("*").alias("n"))
    asked = stored(q.mapInPandas(_to_pivots(pivots, "q_vector", False), f"{names(q)}, gaps array<double>"))
    pairs = asked.select(*query_cols, "k", F.posexplode("gaps").alias("pivot", "away")).join(F.broadcast(blocks), [*corpus, "pivot"])
    order = Window.partitionBy(*query_cols).orderBy(F.col("away") + F.col("radius"), "pivot")
    pairs = stored(pairs.withColumn("before", F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))))

    def met(own: DataFrame) -> DataFrame:
        part = lambda cols, n, size: F.pmod(F.xxhash64(*cols), F.greatest(F.lit(1), F.ceil(F.col(n) / size)))
        sizes = own.groupBy(*corpus, "pivot").agg(F.count("*").alias("queries"), F.first("n").alias("n"))
        known = lambda: F.broadcast(sizes.toDF(*sizes.columns))  # each side of the cogroup needs columns of its own
        meeting = own.select(*query_cols, "pivot").join(asked.drop("gaps"), query_cols).join(known(), [*corpus, "pivot"])
        meeting = meeting.withColumn("qp", part(query_cols, "queries", PIVOT_BLOCK)).withColumn(
            "ip", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n") / PIVOT_BLOCK) - 1)))
        items = dealt.join(known(), [*corpus, "pivot"]).withColumn("ip", part(item_cols, "n", PIVOT_BLOCK)).withColumn(
            "qp", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("queries") / PIVOT_BLOCK) - 1)))
        key = [*corpus, "pivot", "ip", "qp"]

        def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            if left.empty or right.empty:
                return pd.DataFrame(columns=columns)
            return _near(_matrix(right["i_vector"]), right[item_cols], _matrix(left["q_vector"]), left[query_cols], left["k"].to_numpy(), None)[columns]

        return meeting.groupBy(*key).cogroup(items.groupBy(*key)).applyInPandas(meet, schema)

    near = F.col("before") < F.col("k")
    first = stored(met(pairs.filter(near)))
    ordered = Window.partitionBy(*query_cols).orderBy("distance")
    worst = first.join(asked.select(*query_cols, "k"), query_cols).withColumn("_n", F.row_number().over(ordered)).filter("_n = k")
    worst = worst.select(*query_cols, F.sqrt(F.col("distance") + ROUNDING).alias("reach"))
    rest = pairs.filter(~near).join(worst, query_cols, "left").filter(
        F.col("reach").isNull() | (F.col("away") - F.col("radius") <= F.col("reach") + ROUNDING))
    return first.unionByName(met(rest))


def nearest(queries: DataFrame, query_cols: list[str], items: DataFrame, item_cols: list[str], k: int | Column,
            query_vector: str = "embedding", item_vector: str = "embedding",
            broadcast_vectors: int = BROADCAST_VECTORS, within: str | None = None) -> DataFrame:
    """Exact ``k`` nearest items of every query by squared distance; ``k`` may be a column of the queries.

    ``within``: a key of both sides; a query meets only items of its own value of it.
    Few queries (counted first) travel to the items as one matrix, each task keeps only its
    own best per query, and those partial lists are merged. Many meet the items in blocks
    around pivots, most of which are ruled out before the shuffle (``_by_pivots``). No pair table exists in either case.
    """
    limit = F.lit(k) if isinstance(k, int) else k
    q = stored(queries.select(*query_cols, limit.cast("int").alias("k"), F.col(query_vector).alias("q_vector")))
    v = items.select(*item_cols, F.col(item_vector).alias("i_vector"))
    columns = [*[c for c in query_cols if c not in item_cols], *item_cols, "distance"]
    kinds = {f.name: f.dataType.simpleString() for f in [*q.schema.fields, *v.schema.fields]} | {"distance": "double"}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in columns)
    if is_small(q, broadcast_vectors):
        local = q.toPandas()
        shared = q.sparkSession.sparkContext.broadcast((local[query_cols], local["k"].to_numpy(), _matrix(local["q_vector"])))

        def scan(batches):
            keys, limits, matrix = shared.value
            for batch in batches:
                if len(batch) and len(keys):
                    out = _near(_matrix(batch["i_vector"]), batch[item_cols], matrix, keys, limits, within)
                    if len(out):
                        yield out[columns]

        partial = v.mapInPandas(scan, schema)
    else:
        partial = _by_pivots(q, stored(v), query_cols, item_cols, within, columns, schema)
    order = [F.col("distance"), *[F.col(c) for c in item_cols]]
    if isinstance(k, int):
        best = top_rows(partial, query_cols, order, k)
    else:
        best = top_rows(partial.join(bounded_broadcast(q.select(*query_cols, "k")), query_cols), query_cols, order, F.col("k")).drop("k")
    return best.withColumn("relevance", relevance("distance"))


def best_relevance(hits: DataFrame, query: str, item_cols: list[str]) -> DataFrame:
    """Over a query's variants: the best relevance per item, and where it first appeared."""
    return hits.groupBy(query, *item_cols).agg(
        F.min("distance").alias("distance"), F.max("relevance").alias("relevance"),
        F.min(F.struct("variant_no", "rank")).alias("first_seen"))


def best_similarity(pairs: DataFrame, key: str, left: str, right: str, out: str = "similarity") -> DataFrame:
    """Highest cosine of each key over its evidence vectors; 0 without any."""
    return pairs.groupBy(key).agg(F.coalesce(F.max(cosine(left, right)), F.lit(0.0)).alias(out))

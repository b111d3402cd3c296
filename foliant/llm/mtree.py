"""Exact inner-product search with M-trees.

Vectors are dealt out to shards of about SHARD rows, each of which is bulk-loaded into an
M-tree: a table of pages, each with at most PAGE entries. An inner page's entry has a
routing vector, the covering radius of the page below it and the distance to the page's
own routing vector; a leaf's entry has a vector and that distance. Every page but the
root stands below a routing vector.

The metric is the Euclidean distance after every vector gets one more component, so that
all have the length of the longest, and queries get 0: the nearest vector is then the one of
the largest inner product. A search takes pages in the order of the least distance that
they can hold and stops where that exceeds the k-th best; entries whose stored distance to
the routing vector rules them out (triangle inequality) cost no distance. Each query first
searches one shard; its k-th score there is the bound that all other shards start with.
Queries go in blocks of QUERIES; pages are copied once for each block.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm.common import small_batches, written

SHARD = 8192
PAGE = 256
QUERIES = 1024
#: Slack of floating-point distances, relative to the largest.
SLACK = 1e-9
#: Squared length of a quantised vector up to which no score can leave 64 bits.
LONGEST = float(1 << 62)
_PAGES = "dims int, shard long, page int, leaf boolean, ids binary, vectors binary, radii binary, parent binary, children binary"


def quantised(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component, or null if the vector or any component is null or not finite. Components end at 2 ** 32, beyond which no vector takes part in a search."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    whole = lambda x: F.floor(F.greatest(F.least(x.cast("double") * scale, F.lit(float(1 << 32))), F.lit(-float(1 << 32))))
    return F.when(vector.isNotNull() & fine, F.transform(vector, lambda x: whole(x).cast("long")))


def _norm(vector: Column) -> Column:
    """Squared length, in doubles, which huge components don't overflow."""
    return F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))


def _lifted(x: np.ndarray, longest: float) -> np.ndarray:
    """Vectors with the component that makes all equally long."""
    f = x.astype(np.float64)
    return np.column_stack([f, np.sqrt(np.maximum(longest - (f * f).sum(axis=1), 0))])


def _distances(points: np.ndarray, to: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(((points - to) ** 2).sum(axis=1), 0))


def build(ids: np.ndarray, x: np.ndarray, longest: float) -> list[tuple]:
    """Pages of one tree: page, leaf, ids, vectors, radii, distances to the page's routing vector, children. Page 0 is the root."""
    points, pages = _lifted(x, longest), []

    def load(rows: np.ndarray, routing: np.ndarray | None) -> tuple[int, float]:
        """Loads a page for some rows; its number and covering radius."""
        number = len(pages)
        pages.append(())
        to_routing = np.zeros(len(rows)) if routing is None else _distances(points[rows], routing)
        if len(rows) <= PAGE:
            pages[number] = (number, True, ids[rows], x[rows], np.zeros(0), to_routing, np.zeros(0, np.int32))
            return number, float(to_routing.max(initial=0))
        n = min(PAGE, -(-len(rows) // PAGE) * 2)
        seeds = points[rows[np.random.default_rng(len(rows)).choice(len(rows), n, replace=False)]]
        near = ((points[rows] ** 2).sum(axis=1)[:, None] - 2 * points[rows] @ seeds.T + (seeds ** 2).sum(axis=1)).argmin(axis=1)
        groups = [(seeds[k], rows[near == k]) for k in range(n) if (near == k).any()]
        if len(groups) == 1:  # equal vectors: any cut is as good
            groups = [(groups[0][0], part) for part in np.array_split(rows, min(PAGE, -(-len(rows) // PAGE)))]
        below = [load(part, seed) for seed, part in groups]
        vectors = np.stack([seed for seed, _ in groups])
        parent = np.zeros(len(groups)) if routing is None else _distances(vectors, routing)
        pages[number] = (number, False, np.zeros(0, np.int64), vectors, np.array([r for _, r in below]), parent, np.array([p for p, _ in below], np.int32))
        return number, float(to_routing.max(initial=0))

    if len(ids):
        load(np.arange(len(ids)), None)
    return pages


class Tree:
    """Pages of one shard, ready for search. ``computed`` counts distances."""

    def __init__(self, pages: dict[int, tuple], longest: float) -> None:
        self.pages, self.longest, self.computed = pages, longest, 0

    def search(self, query: np.ndarray, own: int | None, k: int, bound: int | None) -> list[tuple[int, int]]:
        """The k best (score, id) apart from ``own``, of scores of ``bound`` at least; ties to smaller ids."""
        q = np.append(query.astype(np.float64), 0.0)
        square = float(q @ q) + self.longest
        slack = SLACK * (square + 1)
        best: list[tuple[int, int]] = []  # a heap of (score, -id), the worst first
        worst = -float("inf") if bound is None else float(bound)
        reach = float("inf") if bound is None else np.sqrt(max(square - 2 * worst, 0) + slack) + slack
        queue: list[tuple[float, int, float]] = [(0.0, 0, -1.0)]
        while queue:
            least, number, to_parent = heapq.heappop(queue)
            if least > reach:
                break
            _, leaf, ids, vectors, radii, parent, children = self.pages[number]
            if to_parent < 0:
                chosen = np.arange(len(parent))
            else:
                chosen = np.flatnonzero(np.abs(to_parent - parent) - (0 if leaf else radii) <= reach)
            self.computed += len(chosen)
            if not len(chosen):
                continue
            if leaf:
                scores = vectors[chosen] @ query
                for at in np.flatnonzero(scores >= worst):
                    pair = int(scores[at]), -int(ids[chosen[at]])
                    if -pair[1] == own:
                        continue
                    if len(best) < k:
                        heapq.heappush(best, pair)
                    elif pair > best[0]:
                        heapq.heapreplace(best, pair)
                if len(best) == k and best[0][0] > worst:
                    worst = best[0][0]
                    reach = np.sqrt(max(square - 2 * worst, 0) + slack) + slack
            else:
                far = _distances(vectors[chosen], q)
                for at, d in zip(chosen.tolist(), far.tolist(), strict=True):
                    if (nearest := max(0.0, d - radii[at])) <= reach:
                        heapq.heappush(queue, (nearest, int(children[at]), d))
        return [(s, -i) for s, i in sorted(best, reverse=True)]


def _built(longest: float):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        dims, shard = key[0].as_py(), key[1].as_py()
        ids = np.array(table.column("vec_id"), np.int64)
        x = np.array(table.column("vector").combine_chunks().flatten(), np.int64).reshape(len(ids), dims)
        order = np.argsort(ids, kind="stable")
        pages = build(ids[order], x[order], longest)
        packed = [[p[k].tobytes() for p in pages] for k in range(2, 7)]
        return pa.table([pa.array([dims] * len(pages), pa.int32()), pa.array([shard] * len(pages), pa.int64()), pa.array([p[0] for p in pages], pa.int32()),
                         pa.array([p[1] for p in pages]), *(pa.array(x, pa.binary()) for x in packed)],
                        ["dims", "shard", "page", "leaf", "ids", "vectors", "radii", "parent", "children"])
    return run


def _searched(longest: float, k: int):
    def run(key: tuple, pages: pa.Table, queries: pa.Table) -> pa.Table:
        dims, rows = key[0].as_py(), []
        if pages.num_rows and queries.num_rows:
            of = {}
            for p in pages.to_pylist():
                flat = np.frombuffer(p["vectors"], np.int64 if p["leaf"] else np.float64)
                of[p["page"]] = (p["page"], p["leaf"], np.frombuffer(p["ids"], np.int64), flat.reshape(-1, dims if p["leaf"] else dims + 1),
                                 np.frombuffer(p["radii"]), np.frombuffer(p["parent"]), np.frombuffer(p["children"], np.int32))
            tree = Tree(of, longest)
            for q in queries.to_pylist():
                rows += [(q["vec_id"], i, s) for s, i in tree.search(np.array(q["vector"], np.int64), q["vec_id"], k, q["bound"])]
        return pa.table([pa.array([r[c] for r in rows], pa.int64()) for c in range(3)], ["query_id", "vec_id", "score"])
    return run


def top_k(vectors: DataFrame, queries: Column, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k best other rows of each query row: ``query_id, rank, vec_id, score``.

    ``queries``: which rows are queries. The score is the inner product of the vectors
    quantised by ``scale``, in 64-bit integers; ties go to the smaller id. Null vectors, null
    ids, and vectors with a null or non-finite component or of no components take no part;
    vectors of different lengths aren't compared. Vectors whose quantised squared length is over LONGEST take
    no part either: their scores may not fit 64 bits. A repeated id is a candidate in each of
    its rows, never of itself, and as a query once, with the smallest of its vectors. An empty table gives no rows. Other columns are ignored.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    flag = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.coalesce(queries, F.lit(False)).alias("is_query"), quantised(F.col(f"`{vector_col}`"), scale).alias("vector"))
    used = written(flag.filter("vec_id is not null and size(vector) > 0").withColumn("dims", F.size("vector")))
    used = used.filter(_norm(F.col("vector")) <= LONGEST)
    told = used.agg(F.count("*").alias("n"), F.coalesce(F.max(_norm(F.col("vector"))), F.lit(0.0)).alias("longest"), F.count_if("is_query").alias("queries")).head()
    shards, blocks = -(-told["n"] // SHARD) or 1, -(-told["queries"] // QUERIES) or 1
    of_id = lambda salt, n: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(n))
    pages = written(used.withColumn("shard", of_id("shard", shards)).groupBy("dims", "shard").applyInArrow(_built(told["longest"]), _PAGES))
    copies = pages.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asked = used.filter("is_query").groupBy("vec_id").agg(F.min(F.struct("dims", "vector")).alias("q")).select("vec_id", "q.dims", "q.vector")
    asked = asked.select("*", of_id("home", shards).alias("home"), of_id("block", blocks).cast("int").alias("block"))

    def searched(rows: DataFrame) -> DataFrame:
        key = ["dims", "shard", "block"]
        return copies.groupBy(*key).cogroup(rows.groupBy(*key)).applyInArrow(_searched(told["longest"], k), "query_id long, vec_id long, score long")

    first = written(searched(asked.withColumn("shard", F.col("home")).withColumn("bound", F.lit(None).cast("long"))))
    found = first
    if shards > 1:
        bounds = first.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("low")).select(F.col("query_id").alias("vec_id"), F.when(F.col("n") >= k, F.col("low")).alias("bound"))
        others = asked.join(bounds, "vec_id", "left").withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long")))).filter("shard <> home")
        found = first.unionByName(searched(others))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

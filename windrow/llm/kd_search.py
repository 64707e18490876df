"""Exact search for the largest inner products with one KD-tree per shard.

Rows are dealt into shards of bounded size; a task builds the tree of one shard: median splits along the widest side, tight bounding
boxes, leaves of a few hundred rows.  A query walks a tree best box first, by the largest product its box allows, and stops at the
first box below its kth score.  Queries first search the shard that would hold them, and take the kth score found there into all
others, where most boxes can then fall at once.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from windrow.llm.common import stored

SHARD_ROWS, QUERY_ROWS, LEAF_ROWS = 20_000, 4096, 256
#: products and sums below this are exact in double precision
EXACT = 2.0**53


def usable(vector: Column, scale: float) -> Column:
    """Neither null nor holding a null or a component that is not finite once scaled."""
    return vector.isNotNull() & F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * scale) < float("inf"))), F.lit(False))


def within_long(score: np.ndarray) -> np.ndarray:
    """Python integers beyond a long become its nearest value; doubles are exact and far below."""
    return np.minimum(np.maximum(score, -(2**63)), 2**63 - 1) if score.dtype == object else score


class Tree:
    """KD-tree over the rows of a matrix; ``order`` lists rows leaf by leaf."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF_ROWS):
        self.order = np.arange(len(x))
        low, high, self.children, self.span = [], [], [], []
        stack = [(0, len(x), -1)]
        while stack:
            start, stop, parent = stack.pop()
            own = x[self.order[start:stop]]
            number = len(self.span)
            low.append(own.min(axis=0))
            high.append(own.max(axis=0))
            self.children.append([])
            self.span.append((start, stop))
            if parent >= 0:
                self.children[parent].append(number)
            if stop - start > leaf:
                side, middle = int(np.argmax(high[-1] - low[-1])) if x.shape[1] else 0, (stop - start) // 2
                if x.shape[1]:
                    self.order[start:stop] = self.order[start:stop][np.argpartition(own[:, side], middle)]
                stack += [(start + middle, stop, number), (start, start + middle, number)]
        self.low, self.high = np.array(low), np.array(high)
        self.x = x[self.order]

    def bounds(self, query: np.ndarray) -> np.ndarray:
        """The largest product a row in each box can have."""
        return within_long(np.maximum(self.low * query, self.high * query).sum(axis=1))

    def best(self, query: np.ndarray, ids: np.ndarray, copies: np.ndarray, own: int, k: int, least: float) -> list[tuple[int, int]]:
        """(score, id) of the k best rows not of id ``own`` among those that score ``least`` or more.  ``ids`` and ``copies``
        follow ``order``; ties go to smaller ids."""
        bound = self.bounds(query).tolist()
        heap, found, kth = [(-bound[0], 0)], [], least
        while heap:
            top, node = heapq.heappop(heap)
            if -top < kth:
                break
            if self.children[node]:
                for child in self.children[node]:
                    if bound[child] >= kth:
                        heapq.heappush(heap, (-bound[child], child))
                continue
            start, stop = self.span[node]
            score = within_long(self.x[start:stop] @ query)
            for i in np.flatnonzero(score >= kth).tolist():
                if ids[start + i] != own:
                    found += [(-score[i], int(ids[start + i]))] * min(k, int(copies[start + i]))
            if len(found) >= k:
                found = heapq.nsmallest(k, found)
                kth = max(kth, -found[-1][0])
        return [(-s, i) for s, i in heapq.nsmallest(k, found)]


def matrix(column: pa.ChunkedArray, scale: float, exact: bool) -> np.ndarray:
    """floor(scale * x) as doubles, or as Python integers where doubles would round products."""
    flat = np.floor(np.asarray(column.combine_chunks().flatten(), np.float64) * scale)
    x = flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)
    return x if exact else np.vectorize(int, otypes=[object])(x) if x.size else x.astype(object)


def search_shard(k: int, scale: float):
    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        out: tuple[list[int], list[int], list[int]] = ([], [], [])
        if rows.num_rows and queries.num_rows:
            sizes = [np.abs(np.floor(np.asarray(t.column("v").combine_chunks().flatten(), np.float64) * scale)).max(initial=0.0) for t in (rows, queries)]
            exact = sizes[0] * sizes[1] * max(1, len(rows.column("v")[0])) < EXACT
            tree = Tree(matrix(rows.column("v"), scale, exact))
            ids, copies = (rows.column(c).to_numpy()[tree.order] for c in ("vec_id", "copies"))
            asked = matrix(queries.column("v"), scale, exact)
            # a lower bound known from another shard may have been rounded up beyond 2^53
            least = [-np.inf if s is None or not exact else float(s) for s in queries.column("kth").to_pylist()]
            for q, query_id in enumerate(queries.column("query_id").to_pylist()):
                for score, vec_id in tree.best(asked[q], ids, copies, query_id, k, least[q]):
                    out[0].append(query_id)
                    out[1].append(vec_id)
                    out[2].append(int(score))
        return pa.table([pa.array(x, pa.int64()) for x in out], names=["query_id", "vec_id", "score"])

    return run


def top_products(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: float = 256.0, id_column: str = "vec_id", vector_column: str = "embedding",
                 shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k rows of ``vectors`` with the largest integer inner product.

    Components become floor(scale * x), x as double; ties go to the smaller id; fewer than k rows give all.  Rows with the query's
    id take no part.  Vectors that are null, or hold a null or a component not finite once scaled, take no part on either side,
    nor do rows without an id.  Vectors meet those of their own length only.  A repeated row counts each time; a query id given more
    than once is asked once, with its smallest vector.  Scores outside a long become its nearest value before they are ranked.  Shards and blocks of
    queries are bounded, so a task holds ``shard_rows`` vectors and ``query_rows`` queries about; the plan reads each shard once
    for each block of queries.
    """
    numbers = lambda df: df.where(F.col(id_column).isNotNull() & usable(F.col(vector_column), scale)).select(
        F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).cast("array<double>").alias("v"))
    distinct = numbers(vectors).groupBy("vec_id", "v").agg(F.count(F.lit(1)).alias("copies"))
    rows = stored(distinct.select("vec_id", "v", "copies", F.size("v").alias("dim")), "search-rows")
    asked = stored(numbers(queries).groupBy(F.col("vec_id").alias("query_id"), F.size("v").alias("dim")).agg(F.min("v").alias("v")), "search-queries")
    asked = asked.groupBy("query_id").agg(F.min(F.struct("v", "dim")).alias("q")).select("query_id", "q.v", "q.dim")
    shards = max(1, -(-rows.count() // shard_rows))
    blocks = max(1, -(-asked.count() // query_rows))
    place = lambda *c: F.pmod(F.xxhash64(*c), F.lit(shards)).cast("int")
    dealt = rows.withColumn("shard", place("vec_id", "v"))
    home = asked.withColumns({"shard": place("query_id", "v"), "kth": F.lit(None).cast("long")})
    schema = "query_id long, vec_id long, score long"
    keys = ["dim", "shard", "block"]

    def meet(left: DataFrame, right: DataFrame) -> DataFrame:
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(search_shard(k, scale), schema)

    first = stored(meet(dealt.withColumn("block", F.lit(0)), home.withColumn("block", F.lit(0))), "search-home")
    known = first.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("kth"))
    away = home.drop("kth").withColumnRenamed("shard", "home").join(known, "query_id", "left").withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
    away = away.select("*", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard")).where("shard <> home")
    copied = dealt.select("*", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    second = meet(copied, away)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")  # k rows from each shard at most
    return first.union(second).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


#: DuckDB's form over ``embeddings``
SQL = """
WITH v AS (SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum([q.e[i] * c.e[i] FOR i IN range(1, len(q.e) + 1)]) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

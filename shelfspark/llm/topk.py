"""Exact top-k search by inner product: a KD-tree for each shard.

Vectors are dealt to shards by a hash of their id, queries to blocks, and each pair of shard and block meets in one
task of bounded size.  There the shard's vectors are split at medians into a tree whose nodes keep tight bounding
boxes.  A query visits nodes in order of the largest product that their box allows and stops at the first that
cannot reach its k-th best score.  Every query first searches one shard; its k-th score there is where the search of
the others starts.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

SHARD_ROWS, BLOCK_ROWS, LEAF_ROWS = 8192, 4096, 256


def quantised(embedding, scale: int = 256):
    """floor(scale * x) of each component as double; null for a vector that is null or holds a null or non-finite one."""
    ok = embedding.isNotNull() & F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.when(ok, F.transform(embedding, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long")))


class Tree:
    """Median splits of rows of integers.  Node 0 is the root; node n has a box, and children or rows."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, leaf: int = LEAF_ROWS):
        self.lo, self.hi, self.children, self.leaves = [], [], [], []
        todo = [(np.arange(len(ids)), -1, 0)]
        while todo:
            at, parent, side = todo.pop()
            n = len(self.lo)
            if parent >= 0:
                self.children[parent][side] = n
            box = rows[at]
            lo, hi = box.min(axis=0), box.max(axis=0)
            self.lo.append(lo)
            self.hi.append(hi)
            if len(at) <= leaf:
                self.children.append(None)
                self.leaves.append((ids[at], box))
                continue
            order = np.argpartition(box[:, int(np.argmax(hi - lo))], len(at) // 2)
            self.children.append([0, 0])
            self.leaves.append(None)
            todo += [(at[order[: len(at) // 2]], n, 0), (at[order[len(at) // 2 :]], n, 1)]
        self.lo, self.hi = np.array(self.lo), np.array(self.hi)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """The largest product of each query with any point of each box."""
        return np.maximum(queries, 0) @ self.hi.T + np.minimum(queries, 0) @ self.lo.T

    def search(self, query: np.ndarray, own: int, bound: np.ndarray, k: int, kth) -> list[tuple[int, int]]:
        """(score, id) of the k best rows that reach kth, ties to smaller ids."""
        ids, scores = np.empty(0, np.int64), np.empty(0, query.dtype)
        heap = [(-bound[0], 0)]
        while heap:
            upper, n = heapq.heappop(heap)
            if -upper < kth:
                break
            if self.children[n]:
                for c in self.children[n]:
                    if bound[c] >= kth:
                        heapq.heappush(heap, (-bound[c], c))
                continue
            leaf_ids, rows = self.leaves[n]
            got = rows @ query
            good = np.flatnonzero((got >= kth) & (leaf_ids != own))
            if len(good):
                ids, scores = np.concatenate([ids, leaf_ids[good]]), np.concatenate([scores, got[good]])
                if len(ids) > k:
                    best = np.lexsort((ids, -scores))[:k]
                    ids, scores = ids[best], scores[best]
                if len(ids) == k:
                    kth = max(kth, scores.min())
        return [(int(s), int(i)) for s, i in zip(scores, ids, strict=True)]


def _matrix(column, width: int) -> np.ndarray:
    """Rows of integers, padded with zeros to the width."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(lengths) and (lengths == width).all():
        return flat.reshape(len(lengths), width)
    out, at = np.zeros((len(lengths), width), np.int64), 0
    for i, n in enumerate(lengths):
        out[i, :n] = flat[at : at + n]
        at += n
    return out


def _width(*tables: pa.Table) -> int:
    return max([0, *(max(t.column("v").combine_chunks().value_lengths().to_pylist(), default=0) for t in tables)])


def _exact(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as double where every product is exact in it, as whole numbers of any size otherwise."""
    top = [float(np.abs(x.astype(np.float64)).max()) if x.size else 0.0 for x in (a, b)]
    if top[0] * top[1] * max(a.shape[1], 1) < 2**52:
        return a.astype(np.float64), b.astype(np.float64)
    return a.astype(object), b.astype(object)


def _search(k: int):
    def run(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[tuple[int, int, int]] = []
        if vectors.num_rows and queries.num_rows:
            width = _width(vectors, queries)
            rows, asked = _exact(_matrix(vectors.column("v"), width), _matrix(queries.column("v"), width))
            tree = Tree(vectors.column("vec_id").to_numpy(), rows)
            bounds = tree.bounds(asked)
            for q, row, bound, kth in zip(queries.column("query_id").to_pylist(), asked, bounds, queries.column("kth").to_pylist(), strict=True):
                out += [(q, i, max(min(s, 2**63 - 1), -(2**63))) for s, i in tree.search(row, q, bound, k, -math.inf if kth is None else kth)]
        columns = list(zip(*out, strict=True)) or [[], [], []]
        return pa.table([pa.array(c, pa.int64()) for c in columns], ["query_id", "vec_id", "score"])

    return run


def _meet(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    left, right = vectors.groupBy("shard", "block"), queries.groupBy("shard", "block")
    return left.cogroup(right).applyInArrow(_search(k), "query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, is_query, k: int = 5, scale: int = 256) -> DataFrame:
    """vectors: vec_id, embedding.  is_query: a condition on vec_id.  Returns query_id, rank, vec_id, score.

    Vectors that are null or hold null or non-finite components take no part, nor do null ids.  Shorter vectors count as
    padded with zeros.  Rows with the query's own id are its own row; if a query's id is repeated the smallest of its
    vectors asks.  Repeated other rows each count.  With fewer than k other rows all are returned; an empty table gives an
    empty result.  Scores beyond 64 bits are cut to the ends of the range.  Other columns are not read."""
    spark = vectors.sparkSession
    good = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), quantised(F.col("embedding"), scale).alias("v")).where("vec_id is not null and v is not null")
    good = common.written(good, "top-vectors")
    asks = good.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v")).withColumnRenamed("vec_id", "query_id")
    n, n_asks = good.count(), asks.count()
    shards, blocks = max(1, math.ceil(n / SHARD_ROWS)), max(1, math.ceil(n_asks / BLOCK_ROWS))
    numbers = lambda n, start=0: F.explode(F.sequence(F.lit(start), F.lit(n - 1)))
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    rows = good.select("vec_id", "v", deal("vec_id", shards).alias("shard"), numbers(blocks).alias("block"))
    asks = asks.withColumn("block", deal("query_id", blocks))
    first = asks.select("query_id", "v", "block", F.lit(0).alias("shard"), F.lit(None).cast("double").alias("kth"))
    found = common.written(_meet(rows.where("shard = 0"), first, k), "top-first")
    if shards > 1:
        reached = found.groupBy("query_id").agg(F.min("score").alias("low"), F.count("*").alias("n")).select(F.col("query_id").alias("r_id"), F.when(F.col("n") >= k, F.col("low").cast("double")).alias("kth"))
        rest = asks.join(reached, asks["query_id"] == reached["r_id"], "left").select("query_id", "v", "block", numbers(shards, 1).alias("shard"), "kth")
        found = found.unionByName(_meet(rows.where("shard > 0"), rest, k))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")

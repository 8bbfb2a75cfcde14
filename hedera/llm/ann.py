"""Approximate nearest neighbours: a forest of random-projection trees, one shared priority queue, exact reranking."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import finite_vector, matrix, table, written
from .topk import HITS, ranked


class Forest:
    """Random-projection trees over the rows of a matrix; each leaf has a centroid.

    A node is split across the line between two of its rows, in halves by the order along it; so copies of one vector may
    stand in several leaves, and leaves of one tree differ by one row at most. All nodes of a depth are split at once.
    """

    def __init__(self, points: np.ndarray, trees: int, leaf_rows: int, seed: int):
        rng, n = np.random.default_rng(seed), len(points)
        depth = max(0, math.ceil(math.log2(max(n, 1) / leaf_rows)))
        orders, starts = [], []
        for t in range(trees):
            order, start = np.arange(n), np.array([0, n])
            for _ in range(depth):
                size = np.diff(start)
                node = np.repeat(np.arange(len(size)), size)
                one, two = (points[order[start[:-1] + (rng.random(len(size)) * size).astype(np.int64)]] for _ in range(2))
                along = np.einsum("ij,ij->i", points[order], (one - two)[node])
                order = order[np.lexsort((along, node))]
                start = np.r_[np.stack([start[:-1], start[:-1] + size // 2], axis=1).ravel(), n]
            orders.append(order)
            starts.append(start[:-1] + t * n)
        self.rows = np.concatenate(orders)
        self.starts = np.r_[np.concatenate(starts), trees * n]
        self.sizes = np.diff(self.starts)
        # No leaf is empty: a node is split only while it has more rows than leaf_rows / 2.
        self.centroids = np.add.reduceat(points[self.rows], self.starts[:-1], axis=0) / self.sizes[:, None]

    def leaf(self, i: int) -> np.ndarray:
        return self.rows[self.starts[i] : self.starts[i + 1]]

    def read(self, queries: np.ndarray, wanted: int) -> np.ndarray:
        """Which leaves each query reads: one queue holds the leaves of all trees, that with the largest inner product of query
        and centroid first, and a query takes leaves from it until it has seen wanted entries."""
        order = np.argsort(-(queries @ self.centroids.T), axis=1, kind="stable")
        before = np.cumsum(self.sizes[order], axis=1) - self.sizes[order]
        out = np.zeros(order.shape, bool)
        np.put_along_axis(out, order, before < wanted, axis=1)
        return out


def wanted(rows: int, trees: int, effort: float) -> int:
    """Entries that a query reads in a shard: effort * trees * rows ** 0.7, so their share falls as the shard grows."""
    return math.ceil(effort * trees * rows**0.7)


def dot_in_order(points: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products in double precision, summed from the first component on: equal rows get equal scores."""
    total = np.zeros(len(points))
    for d in range(points.shape[1]):
        total += points[:, d] * query[d]
    return total


def _searcher(k: int, trees: int, leaf_rows: int, effort: float, at_once: int = 512):
    def run(key: tuple, vectors: pa.Table, queries: pa.Table) -> pa.Table:
        n, m = vectors.num_rows, queries.num_rows
        got = []
        if n and m:
            ids, points = vectors["vec_id"].to_numpy(), matrix(vectors["vec"], n)
            order = np.lexsort((*points.T[::-1], ids))  # the forest doesn't depend on the order of arrival
            ids, points = ids[order], points[order]
            qids, q = queries["query_id"].to_numpy(), matrix(queries["vec"], m)
            forest = Forest(points, trees, leaf_rows, 7 + key[1].as_py())
            longest = np.sqrt((points**2).sum(axis=1).max())
            for begin in range(0, m, at_once):
                block = q[begin : begin + at_once]
                scores = np.full((len(block), n), -np.inf)
                reads = forest.read(block, wanted(n, trees, effort))
                for leaf in np.flatnonzero(reads.any(axis=0)).tolist():
                    some, rows = np.flatnonzero(reads[:, leaf]), forest.leaf(leaf)
                    scores[some[:, None], rows] = block[some] @ points[rows].T
                for i, s in enumerate(scores):
                    s[ids == qids[begin + i]] = -np.inf
                    found = np.flatnonzero(s > -np.inf)
                    if len(found) > k:
                        # Products of blocks are rounded otherwise than sums in order: whatever may be among the first k is summed in order.
                        kth = np.partition(s[found], len(found) - k)[len(found) - k]
                        room = 1e-12 * points.shape[1] * np.sqrt((block[i] ** 2).sum()) * longest
                        found = found[s[found] >= kth - room]
                    exact = dot_in_order(points[found], block[i])
                    best = np.argsort(-exact, kind="stable")[:k]  # rows stand in order of id
                    got.append((np.full(len(best), qids[begin + i]), ids[found][best], exact[best]))
        cols = [np.concatenate(x) for x in zip(*got, strict=True)] if got else [np.empty(0, np.int64)] * 2 + [np.empty(0)]
        return pa.table({"query_id": pa.array(cols[0], pa.int64()), "vec_id": pa.array(cols[1], pa.int64()), "score": pa.array(cols[2], pa.float64())})

    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, trees: int = 10, leaf_rows: int = 32, effort: float = 0.65, shard_rows: int = 32_768, query_block: int = 1_024) -> DataFrame:
    """The k nearest found for each query by inner product: query_id, rank (from 1), vec_id, score; ties go to the smaller id.

    vectors and queries: (id, vector) by position; other columns are ignored. Rows whose id or vector is null, or whose
    vector is empty, zero or has null or non-finite components, take no part; a vector meets queries of its own length only;
    rows with a query's own id are no candidates for it; of vectors, rows that repeat an id are candidates each; of queries
    they count once, with the smallest vector. Empty inputs give an empty result.

    Vectors are dealt to shards of about shard_rows by a hash of id and vector; every row of a shard is in every tree of that
    shard's forest. A query reads leaves in the order of one queue over all trees until it has seen wanted(rows, trees,
    effort) entries (an entry may repeat a row, once a tree), and the rows seen are scored exactly on the original vectors.
    A shard returns at most k rows a query.
    """
    def pick(df: DataFrame, name: str) -> DataFrame:
        df = df.select(F.col(df.columns[0]).cast("long").alias(name), F.col(df.columns[1]).cast("array<double>").alias("vec"))
        return df.where(F.col(name).isNotNull() & finite_vector(F.col("vec")) & F.exists("vec", lambda x: x != 0))

    v, q = pick(vectors, "vec_id"), written(pick(queries, "query_id").groupBy("query_id").agg(F.min("vec").alias("vec")))
    shards = max(1, math.ceil(v.count() / shard_rows))
    blocks = max(1, math.ceil(q.count() / query_block))
    v = v.select("*", F.size("vec").alias("dim"), F.pmod(F.xxhash64("vec_id", "vec"), F.lit(shards)).cast("int").alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    q = q.select("*", F.size("vec").alias("dim"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block"))
    key = ("dim", "shard", "block")
    hits = v.groupBy(*key).cogroup(q.groupBy(*key)).applyInArrow(_searcher(k, trees, leaf_rows, effort), HITS)
    return ranked(hits, k)


def op2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(e, e.where(F.col("vec_id") % 20 == 0), 20)

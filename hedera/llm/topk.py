"""Exact top-k by inner product: a ball tree per shard, branch and bound, and a k-th score shared between shards."""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import finite_vector, matrix, table, written

HITS = "query_id long, vec_id long, score double"


class BallTree:
    """Nodes over rows of a matrix: a centre and a radius each; a leaf holds at most leaf_rows rows, or rows that are all equal."""

    def __init__(self, points: np.ndarray, leaf_rows: int):
        self.points, self.order = points, np.arange(len(points))
        self.start, self.end, self.kids, centres, radii = [], [], [], [], []
        todo = [(0, len(points), -1)]
        while todo:
            start, end, parent = todo.pop()
            node = len(self.start)
            rows = self.order[start:end]
            centre = points[rows].mean(axis=0)
            away = np.sqrt(((points[rows] - centre) ** 2).sum(axis=1))
            self.start.append(start)
            self.end.append(end)
            self.kids.append([])
            centres.append(centre)
            radii.append(float(away.max()))
            if parent >= 0:
                self.kids[parent].append(node)
            if end - start > leaf_rows and radii[-1] > 0:
                one = points[rows[away.argmax()]]
                other = points[rows[((points[rows] - one) ** 2).sum(axis=1).argmax()]]
                middle = (end - start) // 2
                self.order[start:end] = rows[np.argpartition(points[rows] @ (one - other), middle)]
                todo += [(start, start + middle, node), (start + middle, end, node)]
        self.centres, self.radii = np.array(centres), np.array(radii)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """For each query and node, what no inner product in the node exceeds (with room for rounding)."""
        length = np.sqrt((queries**2).sum(axis=1))[:, None]
        bound = queries @ self.centres.T + length * self.radii
        return bound + 1e-9 * (np.abs(bound) + length * (np.abs(self.centres).max() + self.radii) + 1)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    if len(scores) > 4 * k:
        keep = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
        scores, ids = scores[keep], ids[keep]
    first = np.lexsort((ids, -scores))[:k]
    return scores[first], ids[first]


def search(tree: BallTree, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, floor: np.ndarray, k: int):
    """Yields (query row, scores, ids) of the k best rows with a score of at least the query's floor."""
    points, out = tree.points[tree.order], ids[tree.order]
    for begin in range(0, len(queries), 512):
        bounds = tree.bounds(queries[begin : begin + 512])
        for i, bound in enumerate(bounds.tolist(), begin):
            least, scores, found = floor[i], np.empty(0), np.empty(0, dtype=np.int64)
            heap = [(-bound[0], 0)]
            while heap and -heap[0][0] >= least:
                _, node = heapq.heappop(heap)
                if kids := tree.kids[node]:
                    for kid in kids:
                        if bound[kid] >= least:
                            heapq.heappush(heap, (-bound[kid], kid))
                    continue
                rows = slice(tree.start[node], tree.end[node])
                s, d = points[rows] @ queries[i], out[rows]
                keep = (s >= least) & (d != query_ids[i])
                if keep.any():
                    scores, found = _best(np.concatenate([scores, s[keep]]), np.concatenate([found, d[keep]]), k)
                    if len(scores) == k:
                        least = max(least, scores[-1])
            if len(scores):
                yield i, scores, found


def _searcher(k: int, leaf_rows: int):
    def run(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        n, m = vectors.num_rows, queries.num_rows
        rows = []
        if n and m:
            ids, points = vectors["vec_id"].to_numpy(), matrix(vectors["vec"], n)
            qids, q = queries["query_id"].to_numpy(), matrix(queries["vec"], m)
            floor = queries["floor"].to_numpy()
            rows = list(search(BallTree(points, leaf_rows), ids, q, qids, floor, k))
            rows = [(np.full(len(s), qids[i]), d, s) for i, s, d in rows]
        got = [np.concatenate(x) for x in zip(*rows, strict=True)] if rows else [np.empty(0, np.int64)] * 2 + [np.empty(0)]
        return pa.table({"query_id": pa.array(got[0], pa.int64()), "vec_id": pa.array(got[1], pa.int64()), "score": pa.array(got[2], pa.float64())})

    return run


def exact_topk(vectors: DataFrame, queries: DataFrame, k: int = 5, shard_rows: int = 65_536, shards_least: int = 64, query_block: int = 2_048, leaf_rows: int = 64) -> DataFrame:
    """The k largest inner products for each query: query_id, rank (from 1), vec_id, score; ties go to the smaller vec_id.

    vectors and queries: (id, vector of double) by position; other columns may follow and are ignored. Inner products are
    exact where they and their terms are integers under 2**53. Rows whose id or vector is null, or whose vector is empty or
    has null or non-finite components, take no part. A vector meets queries of its own length only. Rows with a
    query's own id are no candidates for it. Of vectors, rows that repeat an id are candidates each; of queries they count
    once, with the smallest vector. Empty inputs give an empty result.

    Vectors are dealt to shards by a hash of id and vector, so copies and hot labels spread evenly. First each query searches one
    shard; the k-th score found there is then the floor with which all shards are searched, in blocks of queries. A shard
    returns at most k rows a query, so what is merged is small.
    """
    spark = vectors.sparkSession
    pick = lambda df, name: df.select(F.col(df.columns[0]).cast("long").alias(name), F.col(df.columns[1]).cast("array<double>").alias("vec")).where(F.col(name).isNotNull() & finite_vector(F.col("vec")))
    v, q = pick(vectors, "vec_id"), pick(queries, "query_id").groupBy("query_id").agg(F.min("vec").alias("vec"))
    shards = max(shards_least, math.ceil(v.count() / shard_rows))
    q = written(q)
    blocks = max(1, math.ceil(q.count() / query_block))
    v = v.withColumn("dim", F.size("vec")).withColumn("shard", F.pmod(F.xxhash64("vec_id", "vec"), F.lit(shards)).cast("int"))
    q = q.withColumn("dim", F.size("vec")).withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
    run = _searcher(k, leaf_rows)

    home = q.withColumn("shard", F.pmod(F.xxhash64("query_id", F.lit(1)), F.lit(shards)).cast("int")).withColumn("floor", F.lit(float("-inf")))
    seeds = v.groupBy("dim", "shard").cogroup(home.groupBy("dim", "shard")).applyInArrow(run, HITS)
    floor = written(seeds.groupBy("query_id").agg(F.when(F.count("score") >= k, F.min("score")).alias("floor")))
    q = q.join(floor, "query_id", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
    everywhere = q.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    spread = v.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    hits = spread.groupBy("dim", "shard", "block").cogroup(everywhere.groupBy("dim", "shard", "block")).applyInArrow(run, HITS)
    return ranked(hits, k)


def ranked(hits: DataFrame, k: int) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").where(finite_vector(F.col("embedding")))
    v = e.select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * 256).cast("double")).alias("vec"))
    top = exact_topk(v, v.where(F.col("vec_id") % 50 == 0), 5)
    return top.select("query_id", "rank", "vec_id", F.col("score").cast("long").alias("score"))


OP1_SQL = """
WITH bad AS (
  SELECT vec_id, embedding FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)::DOUBLE) AS e FROM bad
), s AS (
  SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.e, v.e)::BIGINT AS score
  FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

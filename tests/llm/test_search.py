import numpy as np
import pytest

from hedera.llm.ann import Forest, nearest, op2_nearest, wanted
from hedera.llm.topk import BallTree, exact_topk, op1_exact_topk

from .helpers import vectors

VEC = "vec_id long, embedding array<double>, score string"


def brute(ids, m, queries, k):
    out = []
    for q in queries:
        s = [(-(float(np.dot(m[i], m[q]))), int(ids[i])) for i in range(len(ids)) if ids[i] != ids[q]]
        out += [(int(ids[q]), r, v, -x) for r, (x, v) in enumerate(sorted(s)[:k], 1)]
    return sorted(out)


def test_topk_equals_brute_force_with_ties(spark):
    m = np.floor(vectors(1, 400) * 4)
    m[50:120] = m[50]  # ties
    df = spark.createDataFrame([(i, x.tolist(), "x") for i, x in enumerate(m)], VEC)
    got = exact_topk(df, df.where("vec_id % 7 = 0"), 5, shard_rows=50, shards_least=4, leaf_rows=8, query_block=20)
    assert sorted(tuple(r) for r in got.collect()) == brute(np.arange(400), m, range(0, 400, 7), 5)


def test_topk_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0], "a"), (0, [1.0, 2.0], "a"), (1, [3.0, 1.0], None), (2, None, "b"), (3, [], "c"), (4, [1.0, None], "d"), (5, [nan, 1.0], "e"), (6, [inf, 1.0], "f"), (None, [1.0, 1.0], "g"), (7, [1.0, 1.0, 1.0], "h"), (8, [0.0, 0.0], "i")]
    df = spark.createDataFrame(rows, VEC)
    # The rows of vec_id 0 are candidates each.
    assert sorted(tuple(r) for r in exact_topk(df, df, 5).collect()) == [(0, 1, 1, 5.0), (0, 2, 8, 0.0), (1, 1, 0, 5.0), (1, 2, 0, 5.0), (1, 3, 8, 0.0), (8, 1, 0, 0.0), (8, 2, 0, 0.0), (8, 3, 1, 0.0)]
    assert sorted(tuple(r) for r in nearest(df, df, 5).collect()) == [(0, 1, 1, 5.0), (1, 1, 0, 5.0), (1, 2, 0, 5.0)]
    none = df.limit(0)
    assert exact_topk(none, none).count() == nearest(none, none).count() == 0


def test_bounds_hold_and_every_row_is_in_every_tree():
    m = vectors(3, 500)
    tree = BallTree(m, 16)
    bound = tree.bounds(m[:20])
    for node in range(len(tree.start)):
        rows = tree.order[tree.start[node] : tree.end[node]]
        assert ((m[:20] @ m[rows].T).max(axis=1) <= bound[:, node]).all()
    forest = Forest(m, 3, 16, 1)
    assert sorted(forest.rows.tolist()) == sorted(list(range(500)) * 3)
    assert forest.sizes.min() > 0 and forest.sizes.max() <= 16
    for n in (1, 2, 16, 17):
        assert Forest(np.ones((n, 4)), 2, 16, 1).sizes.min() > 0  # copies only


def test_repeated_ids_with_other_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 1.0], "x"), (1, [2.0, 0.0], "x"), (1, [3.0, 0.0], "x")], VEC)
    for search in (exact_topk, nearest):
        assert sorted(tuple(r) for r in search(df, df.where("vec_id = 0"), 5).collect()) == [(0, 1, 1, 3.0), (0, 2, 1, 2.0)]


def test_nearest_ties_go_to_smaller_ids(spark):
    m = np.tile(np.eye(4), (10, 1))
    df = spark.createDataFrame([(i, x.tolist(), "x") for i, x in enumerate(m)], VEC)
    assert sorted(tuple(r) for r in nearest(df, df.where("vec_id % 8 = 0"), 5).collect()) == brute(np.arange(40), m, range(0, 40, 8), 5)


def test_queries_on_the_small_table(spark):
    d = "/root/testdata/sf0.001"
    pdf = spark.read.parquet(f"{d}/embeddings.parquet").toPandas().sort_values("vec_id")
    m = np.stack(pdf["embedding"]).astype(np.float64)
    ids = pdf["vec_id"].to_numpy()
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in op1_exact_topk(spark, d).collect())
    assert got == [(*x[:3], int(x[3])) for x in brute(ids, np.floor(256 * m), np.flatnonzero(ids % 50 == 0), 5)]
    want = brute(ids, m, np.flatnonzero(ids % 20 == 0), 20)
    found = [tuple(r) for r in op2_nearest(spark, d).collect()]
    assert len(found) == len(want)
    assert len({(a, c) for a, _, c, _ in found} & {(a, c) for a, _, c, _ in want}) >= 0.9 * len(want)


@pytest.mark.parametrize(("n", "most"), [(2000, 0.47), (20_000, 0.29)])
def test_recall_and_share_of_rows_scored(n, most):
    """Random directions in 64 dimensions, which have no structure that a tree could use: recall 0.9, and how much was scored for it."""
    m = vectors(5, n, 64)
    m /= np.sqrt((m**2).sum(axis=1))[:, None]
    q = np.arange(0, n, n // 100)
    forest = Forest(m, 10, 32, 1)
    reads = forest.read(m[q], wanted(n, 10, 0.65))
    scores = m[q] @ m.T
    scores[np.arange(len(q)), q] = -9
    hits, scored = 0, 0
    for i in range(len(q)):
        rows = np.unique(np.concatenate([forest.leaf(x) for x in np.flatnonzero(reads[i])]))
        scored += len(rows)
        hits += np.isin(np.argsort(-scores[i])[:20], rows).sum()
    assert hits >= 0.9 * 20 * len(q) and scored <= most * n * len(q)


def test_recall_in_shards(spark):
    m = vectors(5, 6000, 64)
    df = spark.createDataFrame([(i, x.tolist(), None) for i, x in enumerate(m)], VEC)
    want = {(a, c) for a, _, c, _ in brute(np.arange(6000), m, range(0, 6000, 100), 20)}
    for rows in (32_768, 2000):
        got = {(r.query_id, r.vec_id) for r in nearest(df, df.where("vec_id % 100 = 0"), 20, shard_rows=rows).collect()}
        assert len(got & want) >= 0.9 * len(want)

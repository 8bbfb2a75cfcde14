import numpy as np
import pytest

from hedera.llm.common import lean
from hedera.llm.near import Heats, _buckets, _keys, _least, _lengths, _width, _Words, components, near_classes, parity, possible, sets_of

from .helpers import DOC, awkward, near_brute, rng_rows


@pytest.mark.parametrize(("seed", "size", "percent", "block"), [(1, 3, 90, 256), (2, 5, 80, 4), (3, 3, 90, 3)])
def test_equals_brute_force(spark, seed, size, percent, block):
    rows = rng_rows(seed, 160)
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOC)
    got = sorted((tuple(r) for r in near_classes(df, size, percent, block=block).collect()), key=str)
    assert got == near_brute(rows, size, percent)


def test_a_hub_that_no_other_pair_replaces(spark):
    """Copies with one change each link with their origin only."""
    base = [f"w{i}" for i in range(100)]
    rows = [(100, " ".join(base))] + [(i, " ".join(base[: 2 + 3 * i] + [f"x{i}"] + base[3 + 3 * i :])) for i in range(30)]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOC)
    got = sorted((tuple(r) for r in near_classes(df, 3, 90, block=5).collect()), key=str)
    assert got == near_brute(rows, 3, 90)
    assert {r[2] for r in got} == {0}


def test_awkward_rows(spark):
    df = awkward(spark)
    rows = [(r.doc_id, r.text) for r in df.collect()]
    assert sorted((tuple(r) for r in near_classes(df, 3, 90).collect()), key=str) == near_brute(rows, 3, 90)
    assert near_classes(df.limit(0)).count() == 0


def test_components_of_a_chain(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(0, 40) if i != 20], "u long, v long")
    got = {r.id: r.comp for r in components(df).collect()}
    assert got == {i: 0 if i <= 20 else 21 for i in range(41)}


def test_hot_tokens_are_dealt_in_parts(spark):
    """Tokens of more than two sets are dealt in parts; the links stay the same."""
    rows = rng_rows(7, 160)
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOC)
    got = sorted((tuple(r) for r in near_classes(df, 3, 90, bits=16, block=8, quota=2).collect()), key=str)
    assert got == near_brute(rows, 3, 90)


def test_equal_buckets_are_kept_once(spark):
    """Sets that share many tokens make one bucket, not one for each token."""
    pre = [(token, 0, 100, i, 0) for token in range(50) for i in (1, 2, 3)] + [(99, 0, 100, i, 0) for i in (2, 3)] + [(77, 1 + i % 2, 100, i, 0) for i in range(4)]
    shared, pairs = _buckets(spark.createDataFrame(pre, "token long, salt int, n int, id long, hot int"), 90)
    rows = [tuple(r) for r in shared.collect()]
    assert sorted((r[1], r[2], r[4]) for r in rows if not r[5]) == [(1, 3, 3), (2, 3, 2), (2, 3, 3), (3, 3, 2), (3, 3, 3)]
    assert sorted(r[1] for r in rows if r[5]) == [0, 1, 2, 3] and len({r[0] for r in rows}) == 3
    assert {(1, 3), (2, 3)} <= {tuple(r) for r in pairs.collect()}


def test_a_task_gives_its_memory_back():
    """What a worker holds after a task isn't added to the next task's needs."""

    def held():
        with open("/proc/self/smaps_rollup") as f:
            return next(int(line.split()[1]) for line in f if line.startswith("Pss_Anon")) >> 10

    def run(batches):
        for b in batches:
            # A small block after each large one keeps the heap from shrinking by itself.
            blocks = [(bytearray(100_000), kept.append(bytearray(600))) for _ in range(2000)]
            yield b + len(blocks)

    kept, before = [], held()
    assert list(lean(run)([1])) == [2001]
    assert held() - before < 60


def test_clashing_columns(spark):
    rows = rng_rows(8, 40)
    df = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], "doc_id long, text string, row long, id string, comp int")
    assert sorted((tuple(r) for r in near_classes(df, 3, 90).collect()), key=str) == near_brute(rows, 3, 90)


@pytest.mark.parametrize("percent", [50, 80, 90])
def test_possible_loses_no_link(percent):
    """What the filters rule out doesn't link, and of random pairs they rule out nearly all."""
    rng, sets = np.random.default_rng(percent), []
    for _ in range(30):
        base = rng.integers(0, 1 << 63, rng.integers(1, 400)).astype(np.uint64)
        sets.append(np.unique(base))
        for _ in range(4):
            some = base.copy()
            some[: rng.integers(0, max(1, len(base) // 4))] += np.uint64(1)
            sets.append(np.unique(some))
    heats = Heats(np.ones(1 << 8), 8, 10)
    n = np.array([len(s) for s in sets])
    sketches = []
    for s in sets:
        heat, k = heats.of(s), int(_lengths(len(s), percent))
        parts = [parity(s[_least(_keys(s, heat, j), k)], int(_width(4 * k))) for j in (1, 2)]
        sketches.append(np.concatenate([*parts, parity(s, int(_width(2 * len(s))))]))
    every = np.arange(len(sets))
    sizes = (100 * n[:, None] >= percent * n[None, :]) & (100 * n[None, :] >= percent * n[:, None])
    may = possible(n, sketches, every, every, sizes, percent, 3)
    links = np.array([[100 * len(np.intersect1d(a, b)) >= percent * len(np.union1d(a, b)) for b in sets] for a in sets])
    assert not (links & ~may).any() and (may & ~links).sum() < 0.2 * (sizes & ~links).sum()


def test_first_shingles():
    """Whole sets of all kinds of texts: fewer words than size, one shingle twice, none."""
    found = [b"a b", b"", None, b"a b c a b c", b"x", b"A b"]
    values, ends = sets_of(found, 3, _Words())
    assert np.diff(ends).tolist() == [1, 0, 0, 3, 1, 1] and values[0] == values[ends[5]]

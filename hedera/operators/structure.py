"""What fixed effects are among each other: singletons, nesting, components, ranks and degrees of freedom."""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.errors import IdentificationError
from ..sources.scratch import written
from .absorb import Term


def drop_singletons(df: DataFrame, keys: list[str], mass: str | None = None) -> tuple[DataFrame, int, int]:
    """Rows left after levels with a count (or frequency weight) of 1 or less are removed again and again: (rows, removed, rounds)."""
    keys = list(dict.fromkeys(keys))
    if not keys:
        return df, 0, 0
    first = left = df.count()
    rounds = 0
    while left:
        size = F.sum(mass) if mass else F.count(F.lit(1))
        alone = [df.groupBy(k).agg(size.alias("_n")).where(F.col("_n") <= 1 + 1e-12).select(k) for k in keys]
        if not any(a.limit(1).count() for a in alone):
            break
        for k, a in zip(keys, alone, strict=True):
            df = df.join(a, k, "left_anti")
        df = written(df)
        left = df.count()
        rounds += 1
    return df, first - left, rounds


def nested_within(df: DataFrame, fine: str, coarse: str) -> bool:
    """Whether each level of fine lies in one level of coarse."""
    return not df.groupBy(fine).agg((F.min(coarse) != F.max(coarse)).alias("_x")).where("_x").limit(1).count()


def canonical(df: DataFrame, terms: list[Term]) -> tuple[list[Term], list[tuple[Term, Term]]]:
    """Terms without the intercepts that finer ones span, and which term each dropped one lies in. Of equal terms the first stays."""
    dropped: list[tuple[Term, Term]] = []
    pure = [t for t in terms if not t.slopes]
    holders = [t for t in terms if t.intercept]
    gone: set[int] = set()
    for t in pure:
        for h in holders:
            if h is t or id(h) in gone:
                continue
            contained = t.effect and h.effect and set(t.effect.group) <= set(h.effect.group)
            if t.key == h.key or contained or nested_within(df, h.key, t.key):
                same = t.key == h.key or (set(t.effect.group) == set(h.effect.group) if t.effect and h.effect else False) or nested_within(df, t.key, h.key)
                if same and terms.index(t) < terms.index(h) and not h.slopes:
                    continue  # the later one goes instead
                gone.add(id(t))
                dropped.append((t, h))
                break
    return [t for t in terms if id(t) not in gone], dropped


# -------------------------------------------------------------------------------------------------------- components


def _union_find(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Component labels of nodes 0 ... n - 1 under edges (a, b): labels fall to the smaller neighbour's and jump."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while (jump := new[new] != new).any():
            new[jump] = new[new][jump]
        new = new[label]
        if (new == label).all():
            return label
        label = new


def _labels(edges: DataFrame) -> tuple[pd.Index, np.ndarray]:
    """Levels of a and their components, of edges (a, b) that are joined on the driver."""
    e = edges.toArrow().to_pandas()
    a, au = pd.factorize(e["a"])
    b, bu = pd.factorize(e["b"])
    return au, _union_find(a, b + len(au), len(au) + len(bu))[: len(au)]


def component_table(df: DataFrame, left: str, right: str, most_edges: int = 1_000_000) -> DataFrame:
    """(left level, component) of the bipartite graph of two keys; components are numbered by a smallest label.

    Up to most_edges distinct pairs are joined on the driver. Beyond that the key with more levels is taken out (each of its
    levels links all its neighbours to the smallest of them), and what is left goes to the driver if it is few pairs; else
    labels spread on the cluster.
    """
    spark = df.sparkSession
    edges = written(df.select(F.col(left).alias("a"), F.col(right).alias("b")).distinct())
    none = spark.createDataFrame([], edges.select("a", F.lit(0).cast("long").alias("component")).schema)
    if edges.limit(most_edges + 1).count() <= most_edges:
        au, label = _labels(edges)
        return spark.createDataFrame(pd.DataFrame({"a": au, "component": label})) if len(au) else none
    n_left, n_right = edges.agg(F.count_distinct("a"), F.count_distinct("b")).first()
    large, small = ("a", "b") if n_left >= n_right else ("b", "a")
    low = written(edges.groupBy(large).agg(F.min(small).alias("low")))
    pairs = written(edges.join(low, large).select(F.col(small).alias("a"), F.col("low").alias("b")).distinct())
    if pairs.limit(most_edges + 1).count() <= most_edges and pairs.limit(1).count():
        au, label = _labels(pairs)
        found = spark.createDataFrame(pd.DataFrame({"low": au, "component": label}))
        return (low if large == "a" else pairs.select(F.col("a").alias("low")).distinct().withColumn("a", F.col("low"))).join(found, "low").select("a", "component")
    label = edges.select("a").distinct().withColumn("component", F.xxhash64("a"))
    while True:
        right_low = edges.join(label, "a").groupBy("b").agg(F.min("component").alias("low"))
        new = edges.join(right_low, "b").groupBy("a").agg(F.min("low").alias("low"))
        step = written(label.join(new, "a").select("a", F.col("component").alias("was"), F.least("component", "low").alias("component")))
        # A label is also known by the level whose hash it is; following it halves long chains.
        jump = step.select(F.xxhash64("a").alias("component"), F.col("component").alias("over"))
        step = written(step.join(jump, "component", "left").select("a", "was", F.least("component", F.coalesce("over", "component")).alias("component")))
        label = step.select("a", "component")
        if not step.where("was <> component").limit(1).count():
            return label


def n_components(df: DataFrame, left: str, right: str, most_edges: int = 1_000_000) -> int:
    return component_table(df, left, right, most_edges).agg(F.count_distinct("component")).first()[0]


# --------------------------------------------------------------------------------------------------------------- rank


def categorical_rank(codes: list[np.ndarray]) -> int:
    """The exact rank of stacked dummies: levels for one factor, levels minus components for two, elimination for more."""
    sizes = [int(c.max()) + 1 if len(c) else 0 for c in codes]
    if len(codes) == 0 or not sizes[0]:
        return 0
    if len(codes) == 1:
        return sizes[0]
    if len(codes) == 2:
        return sum(sizes) - len(np.unique(_union_find(codes[0], codes[1] + sizes[0], sum(sizes))))
    rows = np.unique(np.stack(codes, axis=1), axis=0)
    starts = np.cumsum([0, *sizes[:-1]])
    # A level that one row has alone gives a pivot; that row and level are done.
    pivots, alive = 0, np.ones(len(rows), bool)
    while alive.any():
        peeled = False
        for g in range(len(codes)):
            at = np.flatnonzero(alive)
            count = np.bincount(rows[at, g], minlength=sizes[g])
            lone = at[count[rows[at, g]] == 1]
            if len(lone):
                alive[lone] = False
                pivots += len(lone)
                peeled = True
        if not peeled:
            break
    return pivots + _sparse_rank([{int(s + c): 1 for s, c in zip(starts, r, strict=True)} for r in rows[alive]])


def _sparse_rank(rows: list[dict[int, int]], most_cells: int = 50_000_000) -> int:
    """Rank over the rationals. Rank modulo a large prime is a lower bound and almost always equal; it is proved by the
    bound from above where that is known, else by exact elimination."""
    prime = (1 << 61) - 1
    found: dict[int, dict] = {}
    rank = cells = 0
    for row in rows:
        row = {c: v % prime for c, v in row.items()}
        while row:
            pivot = min(row)
            if pivot not in found:
                inverse = pow(row[pivot], -1, prime)
                found[pivot] = {c: v * inverse % prime for c, v in row.items()}
                cells += len(row)
                rank += 1
                break
            k = row[pivot]
            for c, v in found[pivot].items():
                x = (row.get(c, 0) - k * v) % prime
                if x:
                    row[c] = x
                else:
                    row.pop(c, None)
        if cells > most_cells:
            raise IdentificationError("the exact rank needs too much elimination; use dof method 'pairwise'", code="identification.rank_size")
    columns = {c for r in rows for c in r}
    if rank == min(len(rows), len(columns)) or not rows:
        return rank
    exact: dict[int, dict] = {}
    full = 0
    for row in rows:
        own = {c: Fraction(v) for c, v in row.items()}
        while own:
            pivot = min(own)
            if pivot not in exact:
                exact[pivot] = {c: v / own[pivot] for c, v in own.items()}
                full += 1
                break
            k = own[pivot]
            for c, v in exact[pivot].items():
                x = own.get(c, 0) - k * v
                if x:
                    own[c] = x
                else:
                    own.pop(c, None)
    return full


def collected_codes(df: DataFrame, keys: list[str], most: int = 20_000_000) -> list[np.ndarray]:
    cells = df.select(*keys).distinct()
    if cells.limit(most + 1).count() > most:
        raise IdentificationError("too many distinct cells for an exact rank", code="identification.rank_size")
    data = cells.toArrow().to_pandas()
    return [pd.factorize(data[k])[0] for k in keys]


def cells_rank(cells: DataFrame, keys: list[str], most: int = 1_000_000) -> int:
    """The exact rank of the dummies of keys over cells (distinct rows); up to `most` cells are brought to the driver.

    More cells are first made fewer on the cluster. Values of levels that add up to zero in all cells have, for one key,
    one value in each component of its graph with the other keys' combinations: components stand for that key's levels,
    which leaves a cell for each combination of the others. A level that one cell has alone gives a pivot and goes with it.
    """
    rank, first = 0, cells.count()
    left = first
    while left > most:
        before = left
        levels = cells.agg(*(F.count_distinct(k) for k in keys)).first()
        for k, _ in sorted(zip(keys, levels, strict=True), key=lambda x: -x[1]):
            if left <= most:
                break
            rest = [c for c in keys if c != k]
            texts = [F.col(c).cast("string") for c in rest]
            named = cells.select(k, *rest, F.concat(*(x for t in texts for x in (F.length(t).cast("string"), F.lit(":"), t))).alias("_rest"))
            found = component_table(named, "_rest", k, most)
            n_levels = cells.select(k).distinct().count()
            cells = written(named.select("_rest", *rest).distinct().join(found.withColumnRenamed("a", "_rest"), "_rest").select(F.col("component").alias(k), *rest))
            rank += n_levels - cells.select(k).distinct().count()
            left = cells.count()
        for k in keys:
            if left > most and (lone := cells.groupBy(k).count().where("count = 1").select(k)).limit(1).count():
                cells = written(cells.join(lone, k, "left_anti"))
                was, left = left, cells.count()
                rank += was - left
        if left == before:
            raise IdentificationError("too many distinct cells for an exact rank", code="identification.rank_size")
    return rank + (categorical_rank(collected_codes(cells, keys)) if left else 0)


def prefix_ranks(df: DataFrame, keys: list[str], most: int = 1_000_000) -> list[int]:
    """Ranks of the first key's dummies, of the first two keys' and so on."""
    cells = written(df.select(*keys).distinct()) if len(keys) > 1 else df
    levels = cells.agg(*(F.count_distinct(k).alias(f"n{i}") for i, k in enumerate(keys))).first()
    ranks = [levels[0]]
    if len(keys) > 1:
        ranks.append(levels[0] + levels[1] - n_components(cells, keys[0], keys[1], most))
    return ranks + [cells_rank(cells if i == len(keys) else cells.select(*keys[:i]).distinct(), keys[:i], most) for i in range(3, len(keys) + 1)]


# ------------------------------------------------------------------------------------------------- degrees of freedom


@dataclass(frozen=True)
class DofInfo:
    df_absorbed: int
    initial: int
    redundant: int
    nested: int
    levels: tuple[int, ...]
    lost: tuple[int, ...]
    exact: tuple[bool, ...]
    nested_by_component: tuple[bool, ...]
    method: str


def slope_redundancy(df: DataFrame, key: str, slope: str, intercept: bool, tol: float = 1e-6) -> int:
    """Levels whose slope variable is constant (with an intercept) or zero (without)."""
    x = F.col(slope)
    flat = F.max(x) - F.min(x) <= tol if intercept else F.max(F.abs(x)) <= tol
    return df.groupBy(key).agg(flat.alias("_x")).where("_x").count()


def absorbed_dof(df: DataFrame, terms: list[Term], clusters: list[str] | None = None, method: str = "pairwise", adjust_nested: bool = True, adjust_continuous: bool = True) -> DofInfo:
    """Degrees of freedom that terms take: levels less those known to be redundant.

    A term nested in a cluster counts as fully redundant. Every other intercept after the first (or after a nested one)
    loses one. pairwise: each also loses the components it forms with every earlier one; firstpair: only the first two;
    exact: what it adds to the rank. Slopes lose the levels where they are constant.
    """
    if method not in ("exact", "pairwise", "firstpair", "none"):
        raise ValueError("the dof method is exact, pairwise, firstpair or none")
    if not terms:
        return DofInfo(0, 0, 0, 0, (), (), (), (), method)
    counts = df.agg(*(F.count_distinct(t.key).alias(f"n{i}") for i, t in enumerate(terms))).first()
    levels, lost, exact, nested, place = [], [], [], [], []
    for i, t in enumerate(terms):
        place.append(len(levels) if t.intercept else None)
        for _ in t.parts:
            levels.append(counts[i])
            lost.append(0)
            exact.append(False)
            nested.append(False)
    total = 0
    active: list[tuple[int, str]] = []
    for t, at in zip(terms, place, strict=True):
        if at is None:
            continue
        if adjust_nested and any(nested_within(df, t.key, c) for c in clusters or []):
            lost[at], exact[at], nested[at] = levels[at], True, True
            total += levels[at]
        else:
            active.append((at, t.key))
    for n, (at, _) in enumerate(active):
        if n or total:
            lost[at] = max(lost[at], 1)
        exact[at] = exact[at] or n == 0
    if method == "exact" and active:
        before = 0
        for n, ((at, _), rank) in enumerate(zip(active, prefix_ranks(df, [k for _, k in active]), strict=True)):
            lost[at] = min(levels[at], levels[at] - (rank - before) + (1 if n == 0 and total else 0))
            exact[at] = True
            before = rank
    elif method != "none":
        pairs = [(a, b) for i, a in enumerate(active) for b in active[i + 1 :]]
        for n, ((_, ka), (at, kb)) in enumerate(pairs[:1] if method == "firstpair" else pairs):
            lost[at] = max(lost[at], n_components(df, ka, kb))
            exact[at] = exact[at] or n == 0
    if adjust_continuous:
        at = 0
        for t in terms:
            for s in t.parts:
                if s is not None:
                    lost[at] = max(lost[at], slope_redundancy(df, t.key, s, t.intercept))
                at += 1
    return DofInfo(sum(levels) - sum(lost), sum(levels), sum(lost), total, tuple(levels), tuple(lost), tuple(exact), tuple(nested), method)

"""Bootstraps: wild cluster tests, pairs and cluster resamples, and diagnostics of clusters."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.errors import BootstrapError, EngineError, InferenceError, InputError
from ..sources.scratch import written
from .absorb import absorb
from .linear import combined
from .report import Result


def wild_weights(rng: np.random.Generator, shape, distribution: str = "rademacher") -> np.ndarray:
    """Multipliers with mean 0 and variance 1."""
    d = distribution.lower()
    if d in ("rademacher", "radem", "rad"):
        return rng.integers(0, 2, shape) * 2.0 - 1.0
    if d == "mammen":
        r = math.sqrt(5)
        return np.where(rng.random(shape) < (r + 1) / (2 * r), (1 - r) / 2, (1 + r) / 2)
    if d == "webb":
        return rng.choice(np.concatenate([s * np.sqrt([0.5, 1.0, 1.5]) for s in (-1, 1)]), shape)
    if d == "normal":
        return rng.standard_normal(shape)
    raise InputError(f"unknown weights {distribution!r}", code="resampling.weights")


def bootstrap_pvalue(observed: float, draws: np.ndarray, alternative: str = "two_sided", joint: bool = False, exact: bool = False) -> float:
    """The share of draws as extreme as the observed statistic; (1 + #) / (B + 1) unless draws are all that are possible."""
    if not len(draws):
        raise BootstrapError("no finite statistics", code="resampling.no_valid_replicates")
    tol = 1e-8 * max(1.0, abs(observed))  # draws are as exact as absorption
    share = (lambda hit: hit.mean()) if exact else (lambda hit: (1 + hit.sum()) / (len(draws) + 1))
    up, down = draws >= observed - tol, draws <= observed + tol
    a = alternative.lower().replace("-", "_")
    if joint or a in ("greater", "right"):
        return float(share(up))
    if a in ("less", "left"):
        return float(share(down))
    if a in ("equal_tailed", "equal_tail"):
        return float(min(1.0, 2 * min(share(up), share(down))))
    if a not in ("two_sided", "two_tailed"):
        raise InputError("alternative is two_sided, equal_tailed, greater or less", code="resampling.alternative")
    return float(share(np.abs(draws) >= abs(observed) - tol))


@dataclass
class WildResult:
    statistic: float
    pvalue: float
    draws: np.ndarray
    clusters: int
    full_enumeration: bool
    kind: str


def wild_cluster_test(result: Result, *, param: str | None = None, R=None, r=0.0, reps: int = 9_999, impose_null: bool = True, distribution: str = "rademacher", alternative: str = "two_sided", seed: int = 0, most_clusters: int = 2_000) -> WildResult:
    """Studentized wild cluster bootstrap of an OLS hypothesis, one-way clusters.

    Outcomes of a draw are linear in the clusters' multipliers, so the rows are read once for each group of clusters: each
    cluster's share of the residuals is absorbed as a column, and all draws follow from sums by cluster on the driver.
    """
    p, i = result.problem, result.notes["inference"]
    if reps < 99:
        raise InputError("reps must be 99 or more", code="resampling.reps")
    if len(p.clusters) != 1:
        raise InferenceError("the wild bootstrap takes one cluster variable", code="inference.clusters")
    rm = np.eye(len(result.names))[[result.names.index(param)]] if param is not None else np.atleast_2d(np.asarray(R, float))
    rv = np.broadcast_to(np.asarray(r, float), len(rm))
    bread, b = result.notes["bread"], result.coef
    x = [F.col(f"_r_{c}") for c in result.notes["columns"]]
    c = p.clusters[0]
    diff = rm @ b - rv
    beta0 = b - bread @ rm.T @ np.linalg.pinv(rm @ bread @ rm.T, hermitian=True) @ diff if impose_null else b
    frame = result.frame.withColumn("_u", F.col("_r_y") - combined(x, beta0))
    design = bread @ rm.T
    d = [combined(x, design[:, j]) for j in range(design.shape[1])]
    groups = frame.select(c).distinct().orderBy(c).limit(most_clusters + 1).collect()
    if len(groups) > most_clusters:
        raise InferenceError(f"more than {most_clusters} clusters; use their asymptotic test", code="inference.clusters")
    level = {g[0]: n for n, g in enumerate(groups)}
    G, q, k = len(level), len(rm), len(x)
    dx, xu, de = np.zeros((G, q, k)), np.zeros((G, k)), np.zeros((G, q))
    rows = frame.groupBy(c).agg(*(F.sum(F.col("w") * a * v) for a in d for v in x), *(F.sum(F.col("w") * v * F.col("_u")) for v in x), *(F.sum(F.col("w") * a * F.col("_e")) for a in d)).collect()
    for row in rows:
        g, v = level[row[0]], np.array(row[1:], float)
        dx[g], xu[g], de[g] = v[: q * k].reshape(q, k), v[q * k : q * k + k], v[q * k + k :]
    # du[h, g]: sum over cluster h of d times what is left of cluster g's residuals after absorption.
    du = np.zeros((G, G, q))
    order = list(level)
    for start in range(0, G, 100):
        part = order[start : start + 100]
        names = [f"_m{n}" for n in range(len(part))]
        wide = frame.select("*", *(F.when(F.col(c) == F.lit(v), F.col("_u")).otherwise(0.0).alias(n) for n, v in zip(names, part, strict=True)))
        wide = wide.drop(*(f for f in wide.columns if f.startswith("_r_") and f[3:] not in result.notes["columns"]))
        a = absorb(wide, p.terms, names, "w" if p.weights != "none" else None, p.config).frame
        for row in a.groupBy(c).agg(*(F.sum(F.col("w") * e * F.col(f"_r_{n}")) for n in names for e in d)).collect():
            du[level[row[0]], start : start + len(part)] = np.array(row[1:], float).reshape(len(part), q)
    nested = i.nested
    scale = (i.n - 1) / (i.n - result.notes["k"] - nested) * G / (G - 1)

    def statistic(delta: np.ndarray, sums: np.ndarray) -> float:
        cov = scale * sums.T @ sums
        if q == 1:
            return float(delta[0] / math.sqrt(cov[0, 0])) if cov[0, 0] > 1e-300 else math.nan
        return float(delta @ np.linalg.pinv(cov, hermitian=True) @ delta)

    observed = statistic(diff, de)
    full = distribution.lower() in ("rademacher", "radem", "rad") and G <= 16 and 2**G <= reps
    if full:
        v = ((np.arange(2**G)[:, None] >> np.arange(G)) & 1) * 2.0 - 1.0
    else:
        v = wild_weights(np.random.default_rng(seed), (reps, G), distribution)
    draws = np.empty(len(v))
    for n, m in enumerate(v):
        step = bread @ (m @ xu)  # how far the draw's coefficients are from those that made it
        sums = np.einsum("g,hgq->hq", m, du) - dx @ step
        draws[n] = statistic(rm @ (beta0 + step - (beta0 if impose_null else b)), sums)
    ok = draws[np.isfinite(draws)]
    if len(ok) < max(99 if not full else 1, 0.95 * len(v)):
        raise BootstrapError("too many draws without a finite statistic", code="resampling.too_many_failures")
    return WildResult(observed, bootstrap_pvalue(observed, ok, alternative, q > 1, full and len(ok) == len(v)), ok, G, full, "WCR11" if impose_null else "WCU11")


def wild_bootstrap(result: Result, *, reps: int = 999, seed: int = 0, distribution: str = "rademacher") -> np.ndarray:
    """Draws of OLS coefficients with cluster multipliers on the residuals (a draw a row)."""
    p, c = result.problem, result.problem.clusters[0]
    x = [F.col(f"_r_{n}") for n in result.notes["columns"]]
    rows = result.frame.groupBy(c).agg(*(F.sum(F.col("w") * v * F.col("_e")) for v in x)).orderBy(c).collect()
    if p is None or not rows:
        raise BootstrapError("no clusters")
    xu = np.array([list(r[1:]) for r in rows], float)
    return result.coef + wild_weights(np.random.default_rng(seed), (reps, len(rows)), distribution) @ xu @ result.notes["bread"]


def cluster_resample(df: DataFrame, cluster: str, seed: int, fresh: str = "_draw") -> DataFrame:
    """As many clusters as there are, drawn with replacement; each draw's rows get a cluster id of their own in column fresh.

    How often each cluster is drawn is a table of one row a cluster: draws are numbers 0 ... G - 1, each with the cluster
    that a seeded hash of the draw picks.
    """
    from pyspark.sql import Window

    ids = written(df.select(F.col(cluster).alias("_c")).distinct().withColumn("_k", F.row_number().over(Window.orderBy("_c")) - 1))
    g = ids.count()
    draws = df.sparkSession.range(g).select(F.col("id").alias(fresh), F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(g)).alias("_k"))
    return df.join(draws.join(ids, "_k").drop("_k"), df[cluster] == F.col("_c")).drop("_c")


def run_replicates(worker: Callable[[int], object], seeds, skip=(EngineError, np.linalg.LinAlgError, FloatingPointError, OverflowError)) -> tuple[list, int]:
    """What worker returns for each seed, and how many failed for statistical reasons; other errors are raised."""
    out, failed = [], 0
    for s in seeds:
        try:
            out.append(worker(s))
        except skip:
            failed += 1
    return out, failed


def pairs_bootstrap(data: DataFrame, estimator: Callable[[DataFrame], np.ndarray], *, reps: int = 999, seed: int = 0, cluster: str | None = None) -> np.ndarray:
    """Draws of an estimator on resampled rows (or clusters). Rows are repeated by Poisson(1) counts of a seeded hash."""
    data = written(data.withColumn("_id", F.monotonically_increasing_id())) if cluster is None else written(data)

    def one(s: int) -> np.ndarray:
        if cluster is not None:
            return np.asarray(estimator(cluster_resample(data, cluster, s)), float)
        u = (F.xxhash64(F.lit(s), "_id").bitwiseAND(F.lit((1 << 53) - 1)) + 0.5) / float(1 << 53)
        count, total, cut = F.lit(0), 0.0, math.exp(-1)
        for k in range(12):
            total += cut
            count = count + F.when(u > total, 1).otherwise(0)
            cut /= k + 1
        return np.asarray(estimator(data.withColumn("_n", count).where("_n > 0").withColumn("_n", F.explode(F.sequence(F.lit(1), F.col("_n")))).drop("_n", "_id")), float)

    draws, failed = run_replicates(one, range(seed, seed + reps))
    if len(draws) < max(2, 0.5 * reps):
        raise BootstrapError(f"{failed} of {reps} replicates failed", code="resampling.too_many_failures")
    return np.array(draws)


def percentile_interval(draws: np.ndarray, level: float = 0.95) -> tuple[np.ndarray, np.ndarray]:
    return np.quantile(draws, (1 - level) / 2, axis=0), np.quantile(draws, (1 + level) / 2, axis=0)


def cluster_diagnostics(df: DataFrame, clusters: list[str], intersections: bool = True) -> list[dict]:
    """Sizes of clusters: number, smallest, median, mean, largest, variation, largest share, effective number, singletons; and flags."""
    out = []
    for c in clusters:
        n = df.groupBy(c).count()
        g, low, mid, mean, high, sd, total, squares, lone = n.agg(F.count("*"), F.min("count"), F.percentile("count", 0.5), F.avg("count"), F.max("count"), F.stddev_pop("count"), F.sum("count"), F.sum(F.col("count").cast("double") ** 2), F.count_if(F.col("count") == 1)).first()
        share = high / total
        flags = [f for f, hit in (("few_clusters", g < 30), ("dominant_cluster", share > 0.5), ("unbalanced", sd / mean > 1)) if hit]
        out.append({"variable": c, "clusters": g, "min": low, "median": mid, "mean": mean, "max": high, "cv": sd / mean, "largest_share": share, "effective": total**2 / squares, "singletons": lone, "flags": flags})
    if intersections:
        for a, b in combinations(clusters, 2):
            out.append({"variable": f"{a}#{b}", "clusters": df.select(a, b).distinct().count()})
    return out

"""Sums of products, and the middle parts of sandwich covariances, as aggregations."""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.errors import InferenceError
from ..functions.kernels import automatic_bandwidth, kernel_weight, max_lag
from ..functions.linalg import fix_psd

#: Names of covariances and what else they are called (fixed values).
VCE = {
    "iid": ("iid", "unadjusted", "homoskedastic"),
    "robust": ("robust", "hc1", "heteroskedastic"),
    "cluster": ("cluster",),
    "hac": ("hac", "newey_west", "neweywest"),
    "dkraay": ("dkraay", "driscoll_kraay", "dk"),
}


def canonical_vce(kind: str | None) -> str:
    name = str(kind or "iid").lower().replace("-", "_")
    for k, known in VCE.items():
        if name in known:
            return k
    raise InferenceError(f"unknown covariance {kind!r}", code="inference.vce")


def gram(df: DataFrame, columns: list[Column], weight: Column | None = None, other: list[Column] | None = None, block: int = 400) -> np.ndarray:
    """Weighted sums of products of columns with each other, or with other columns, in as few passes as the width allows."""
    w = F.lit(1.0) if weight is None else weight
    pairs = [(i, j) for i in range(len(columns)) for j in (range(i, len(columns)) if other is None else range(len(other)))]
    right = columns if other is None else other
    out = np.zeros((len(columns), len(right)))
    for k in range(0, len(pairs), block):
        part = pairs[k : k + block]
        row = df.agg(*(F.sum(w * columns[i] * right[j]).alias(f"s{n}") for n, (i, j) in enumerate(part))).first()
        for (i, j), v in zip(part, row, strict=True):
            out[i, j] = v or 0.0
            if other is None:
                out[j, i] = v or 0.0
    return out


def cluster_meat(df: DataFrame, scores: list[Column], keys: list[str]) -> tuple[np.ndarray, int]:
    """Sum over groups of the outer product of summed scores, and the number of groups."""
    names = [f"s{i}" for i in range(len(scores))]
    groups = df.groupBy(*keys).agg(*(F.sum(s).alias(n) for n, s in zip(names, scores, strict=True)))
    cols = [F.col(n) for n in names]
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    row = groups.agg(F.count(F.lit(1)), *(F.sum(cols[i] * cols[j]) for i, j in pairs)).first()
    out = np.zeros((len(cols), len(cols)))
    for (i, j), v in zip(pairs, row[1:], strict=True):
        out[i, j] = out[j, i] = v or 0.0
    return out, row[0]


def multiway_meat(df: DataFrame, scores: list[Column], clusters: list[str], by_subset: bool = False) -> tuple[np.ndarray, list[int]]:
    """Inclusion and exclusion over all subsets of cluster variables, and the number of groups of each variable.

    by_subset: each subset's part is scaled by its own G / (G - 1).
    """
    if not 1 <= len(clusters) <= 10:
        raise InferenceError("1 to 10 cluster variables", code="inference.clusters")
    total, sizes = np.zeros((len(scores), len(scores))), []
    for r in range(1, len(clusters) + 1):
        for keys in combinations(clusters, r):
            m, g = cluster_meat(df, scores, list(keys))
            if r == 1:
                sizes.append(g)
                if g < 2:
                    raise InferenceError(f"cluster variable {keys[0]!r} has fewer than two levels", code="inference.clusters")
            total += (-1) ** (r + 1) * m * (g / (g - 1) if by_subset else 1.0)
    return total, sizes


def _clock(df: DataFrame, time: str) -> Column:
    t = df.schema[time].dataType
    if isinstance(t, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(F.col(time).cast("timestamp")).cast("double")
    if isinstance(t, T.DateType):
        return F.unix_date(time).cast("double")
    if isinstance(t, T.NumericType):
        return F.col(time).cast("double")
    raise InferenceError("time is a number, a date or a timestamp", code="inference.time")


def lagged_meat(df: DataFrame, scores: list[Column], time: str, panel: str | None = None, bandwidth: float | None = None, kernel: str = "bartlett", by_time: bool = False) -> tuple[np.ndarray, dict]:
    """Kernel-weighted sum of products of scores with their lags, matched exactly on time (within a panel).

    by_time: scores are summed over each time first (Driscoll and Kraay). Else (panel, time) must be unique. Steps are the
    smallest positive distance between times (within panels); gaps are kept, a lag that isn't there gives nothing.
    """
    from pyspark.sql import Window

    names = [f"s{i}" for i in range(len(scores))]
    base = df.select(_clock(df, time).alias("t"), *([F.col(panel).alias("p")] if panel else [F.lit(0).alias("p")]), *(s.alias(n) for s, n in zip(scores, names, strict=True)))
    if by_time:
        base = base.groupBy("t", "p").agg(*(F.sum(n).alias(n) for n in names))
    elif base.groupBy("p", "t").count().where("count > 1").limit(1).count():
        raise InferenceError("time repeats" + (" within the panel" if panel else "; name a panel"), code="inference.time")
    cols = [F.col(n) for n in names]
    total = gram(base, cols)
    step = base.select("p", "t").distinct().withColumn("d", F.col("t") - F.lag("t").over(Window.partitionBy("p").orderBy("t")))
    step, low, high, n = step.agg(F.min(F.when(F.col("d") > 0, F.col("d"))), F.min("t"), F.max("t"), F.count_distinct("t")).first()
    info = {"periods": n, "bandwidth": bandwidth}
    if step is None:
        return total, info
    info["bandwidth"] = bandwidth = float(automatic_bandwidth(n) if bandwidth is None else bandwidth)
    span = round((high - low) / step)
    lags = max_lag(n if panel is None and not by_time else span + 1, bandwidth, kernel, span)
    weights = {lag: kernel_weight(lag, bandwidth, kernel) for lag in range(1, lags + 1)}
    weights = {lag: w for lag, w in weights.items() if w != 0}
    if not weights:
        return total, info
    # Each row meets its lags in one equi-join on (panel, number of the step).
    at = F.round((F.col("t") - F.lit(low)) / F.lit(step), 6)
    base = base.withColumn("k", at)
    table = F.create_map(*(x for lag, w in weights.items() for x in (F.lit(lag), F.lit(w))))
    late = base.select("p", F.explode(F.array(*map(F.lit, weights))).alias("lag"), "k", *cols).withColumn("k", F.round(F.col("k") - F.col("lag"), 6))
    early = base.select("p", "k", *(F.col(n).alias(f"r{n}") for n in names))
    m = gram(late.join(early, ["p", "k"]).withColumn("w", F.element_at(table, F.col("lag"))), cols, F.col("w"), [F.col(f"r{n}") for n in names])
    return total + m + m.T, info


def score_covariance(df: DataFrame, scores: list[Column], kind: str, *, clusters: list[str] = (), n: float, k: float = 0, nested: int = 0, small: bool = True, time: str | None = None, panel: str | None = None, bandwidth: float | None = None, kernel: str = "bartlett", center: bool = False) -> tuple[np.ndarray, dict]:
    """The covariance of summed scores. small: n / (n - k), and for clusters (n - 1) / (n - k - nested) * G / (G - 1) with the smallest G."""
    kind = canonical_vce(kind)
    if center:
        means = df.agg(*(F.avg(s) for s in scores)).first()
        scores = [s - F.lit(m) for s, m in zip(scores, means, strict=True)]
    info: dict = {}

    def cluster_scale(g: int) -> float:
        if g < 2 or n <= k + nested:
            raise InferenceError("too few clusters or observations", code="inference.df")
        return (n - 1) / (n - k - nested) * g / (g - 1) if small else 1.0

    if kind == "cluster":
        if not clusters:
            raise InferenceError("a clustered covariance needs cluster=", code="inference.clusters")
        m, sizes = multiway_meat(df, scores, list(clusters))
        return m * cluster_scale(min(sizes)), {"clusters": sizes}
    if kind in ("hac", "dkraay"):
        if time is None:
            raise InferenceError("rows have no order: name time=", code="inference.time")
        m, info = lagged_meat(df, scores, time, panel if kind == "hac" else None, bandwidth, kernel, kind == "dkraay")
        if kind == "dkraay":
            return m * cluster_scale(info["periods"]), info
        return m * (n / max(n - k, 1) if small else 1.0), info
    return gram(df, scores) * (n / max(n - k, 1) if small else 1.0), info


def sandwich(bread: np.ndarray, meat: np.ndarray, repair: bool) -> np.ndarray:
    v = bread @ meat @ bread.T
    v = (v + v.T) / 2
    return fix_psd(v) if repair else v

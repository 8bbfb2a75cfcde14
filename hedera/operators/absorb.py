"""Absorbing fixed effects: level-space conjugate gradients on the driver, alternating projections on the cluster beyond that."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.errors import ConvergenceError
from ..functions.spec import FixedEffect, HDFEConfig
from ..sources.scratch import dropped, written


@dataclass(frozen=True)
class Term:
    """An absorbed term in a prepared frame: the key column, whether it has intercepts, and its slope columns."""

    key: str
    intercept: bool = True
    slopes: tuple[str, ...] = ()
    effect: FixedEffect | None = None

    @property
    def parts(self) -> list[str | None]:
        """None for the intercept, else a slope column."""
        return ([None] if self.intercept else []) + list(self.slopes)


@dataclass
class Absorbed:
    """frame: the input with each column's within value as _r_<column>; effects: for each term a table of its levels' coefficients."""

    frame: DataFrame
    effects: list[DataFrame]
    iterations: int
    method: str


def pcg_levels(codes, sizes, basis, w, rhs, tol: float, max_iter: int) -> tuple[list[np.ndarray], int]:
    """Solves D'WD g = D'W v for all columns v. basis: for each term its columns over cells, as (index of codes, values or None).

    The system is singular but consistent; started at zero, conjugate gradients stay in the range and residuals are unique.
    Two intercept terms are solved after the larger one is eliminated exactly, others with a diagonal preconditioner.
    """
    k = rhs.shape[1]

    def times(term: int, x: np.ndarray) -> np.ndarray:
        g, b = basis[term]
        x = x if b is None else x * b[:, None]
        return np.stack([np.bincount(codes[g], x[:, j], sizes[g]) for j in range(x.shape[1])], axis=1)

    def spread(term: int, p: np.ndarray) -> np.ndarray:
        g, b = basis[term]
        return p[codes[g]] if b is None else p[codes[g]] * b[:, None]

    diag = []
    for g, b in basis:
        d = np.bincount(codes[g], w if b is None else w * b * b, sizes[g])
        diag.append(np.where(d > 0, d, 1.0)[:, None])
    right = [times(t, rhs) for t in range(len(basis))]
    if len(basis) == 1:
        return [right[0] / diag[0]], 1
    schur = len(basis) == 2 and all(b is None for _, b in basis)
    big = int(np.argmax([sizes[g] for g, _ in basis])) if schur else -1
    own = [t for t in range(len(basis)) if t != big]

    def forward(ps: list[np.ndarray]) -> list[np.ndarray]:
        q = sum(spread(t, p) for t, p in zip(own, ps, strict=True)) * w[:, None]
        if schur:
            q = q - w[:, None] * spread(big, times(big, q) / diag[big])
        return [times(t, q) for t in own]

    r = [right[t].copy() for t in own]
    if schur:
        back = w[:, None] * spread(big, right[big] / diag[big])
        r = [x - times(t, back) for t, x in zip(own, r, strict=True)]
    x = [np.zeros_like(v) for v in r]
    z = [v / diag[t] for t, v in zip(own, r, strict=True)]
    p = [v.copy() for v in z]
    dot = lambda a, b: sum((u * v).sum(axis=0) for u, v in zip(a, b, strict=True))
    rz = dot(r, z)
    # Relative to the right side before elimination: what is left of it bounds every level's mean residual.
    start = np.maximum(sum((right[t] ** 2 / diag[t]).sum(axis=0) for t in range(len(basis))), 1e-300)
    it = 0
    while (rz > tol**2 * start).any():
        it += 1
        if it > max_iter:
            raise ConvergenceError(f"absorption did not converge in {max_iter} iterations", code="convergence.absorption", details={"gap": float(np.sqrt((rz / start).max()))})
        ap = forward(p)
        curve = dot(p, ap)
        a = np.where(curve > 0, rz / np.where(curve > 0, curve, 1), 0.0)
        for i in range(len(own)):
            x[i] += a * p[i]
            r[i] -= a * ap[i]
        z = [v / diag[t] for t, v in zip(own, r, strict=True)]
        new = dot(r, z)
        b = np.where(rz > 0, new / np.where(rz > 0, rz, 1), 0.0)
        p = [u + b * v for u, v in zip(z, p, strict=True)]
        if not curve.any():
            break
        rz = new
    out: list[np.ndarray] = [np.zeros((0, k))] * len(basis)
    for t, v in zip(own, x, strict=True):
        out[t] = v
    if schur:
        out[big] = (right[big] - times(big, w[:, None] * spread(own[0], x[0]))) / diag[big]
    return out, it


def absorb(df: DataFrame, terms: list[Term], columns: list[str], weight: str | None = None, config: HDFEConfig | None = None, tol: float | None = None) -> Absorbed:
    """Within values of columns after absorbing terms, weighted by weight.

    One term is solved level by level on the cluster from its levels' moments. For more, one pass sums weights and columns
    over the cells of the terms' keys (over rows where there are slopes). With up to
    config.driver_cells numbers to bring over, level coefficients are solved on the driver, which is exact to tol; beyond
    that, alternating projections run on the cluster over the cells. Rows are then read again and joined with the levels'
    coefficients, which Spark broadcasts or shuffles by their size.
    """
    config = config or HDFEConfig()
    tol = min(config.tolerance, 1e-9) if tol is None else tol
    if not terms:
        return Absorbed(df.select("*", *(F.col(c).alias(f"_r_{c}") for c in columns)), [], 0, "none")
    w = F.col(weight) if weight else F.lit(1.0)
    slopes = list(dict.fromkeys(s for t in terms for s in t.slopes))
    keys = [t.key for t in terms]
    sums = [F.sum(w).alias("_w")] + [F.sum(w * F.col(c)).alias(f"_v{i}") for i, c in enumerate(columns)]
    if len(terms) == 1 and not slopes:
        means = df.groupBy(*keys).agg(*sums)
        effects = [written(means.select(F.col(keys[0]).alias("_key"), *(F.when(F.col("_w") > 0, F.col(f"_v{i}") / F.col("_w")).otherwise(0.0).alias(f"_e{i}") for i in range(len(columns)))))]
        return Absorbed(_within(df, terms, effects, columns), effects, 1, "means")
    if len(terms) == 1:
        effects = [_by_level(df, terms[0], columns, w)]
        return Absorbed(_within(df, terms, effects, columns), effects, 1, "means")
    distinct_keys = list(dict.fromkeys(keys))
    cells = written(df.select(*distinct_keys, *slopes, w.alias("_w"), *((w * F.col(c)).alias(f"_v{i}") for i, c in enumerate(columns))) if slopes else df.groupBy(*distinct_keys).agg(*sums))
    # Numbers that the driver would hold.
    few = config.solver == "driver" or (config.solver == "auto" and cells.count() * (len(distinct_keys) + len(slopes) + 1 + len(columns)) <= 4 * config.driver_cells)
    solve = _on_driver if few and config.solver != "map" else _on_cluster
    effects, iterations = solve(df, cells, terms, columns, tol, config.max_iter)
    return Absorbed(_within(df, terms, effects, columns), effects, iterations, "driver" if solve is _on_driver else "map")


def _by_level(df: DataFrame, t: Term, columns: list[str], w) -> DataFrame:
    """Coefficients of one term with slopes: least squares within each level, from sums of products around the level's means.

    Rows are read twice and never written. A slope that is constant in a level (zero, without intercepts) or depends on the
    level's others adds nothing there.
    """
    k, values = len(t.slopes), [*t.slopes, *columns]
    means = [F.lit(0.0)] * len(values)
    if t.intercept:
        sums = df.groupBy(F.col(t.key).alias("_key")).agg(F.sum(w).alias("_sw"), *(F.sum(w * F.col(c)).alias(f"_s{i}") for i, c in enumerate(values)))
        mean = written(sums.select("_key", *(F.when(F.col("_sw") > 0, F.col(f"_s{i}") / F.col("_sw")).otherwise(0.0).alias(f"_m{i}") for i in range(len(values)))))
        means = [F.col(f"_m{i}") for i in range(len(values))]
        df = df.join(mean, F.col(t.key) == F.col("_key")).drop("_key")
    x = [F.col(c) - m for c, m in zip(values, means, strict=True)]
    sums = [F.sum(w * x[j] * x[i]).alias(f"p{j}_{i}") for j in range(k) for i in range(len(values))]
    raw = [F.sum(w * F.col(s) ** 2).alias(f"q{j}") for j, s in enumerate(t.slopes)]
    moments = df.groupBy(F.col(t.key).alias("_key")).agg(*sums, *raw, *(F.first(m).alias(f"m{i}") for i, m in enumerate(means)))
    names = [effect_name(t, m, i) for m in range(len(t.parts)) for i in range(len(columns))]
    schema = T.StructType([T.StructField("_key", df.schema[t.key].dataType), *(T.StructField(n, T.DoubleType()) for n in names)])
    intercept, n_values = t.intercept, len(values)

    def solve(batches):
        for b in batches:
            n = b.num_rows
            of = lambda name: b.column(name).to_numpy(zero_copy_only=False)
            p = np.stack([of(f"p{j}_{i}") for j in range(k) for i in range(n_values)]).reshape(k, n_values, n).transpose(2, 0, 1)
            q, m = np.stack([of(f"q{j}") for j in range(k)], axis=1), np.stack([of(f"m{i}") for i in range(n_values)], axis=1)
            own = np.einsum("njj->nj", p[:, :, :k])
            # What rounding leaves of a slope without any spread is no spread.
            scale = np.where(own > 1e-20 * q, 1 / np.sqrt(np.where(own > 0, own, 1)), 0.0)
            g = np.linalg.pinv(p[:, :, :k] * scale[:, :, None] * scale[:, None, :], rcond=1e-12, hermitian=True)
            b_slopes = scale[:, :, None] * (g @ (p[:, :, k:] * scale[:, :, None]))
            out = [m[:, k:] - np.einsum("nj,nji->ni", m[:, :k], b_slopes)] if intercept else []
            out = np.concatenate([x.reshape(n, -1) for x in [*out, b_slopes]], axis=1)
            yield pa.RecordBatch.from_arrays([b.column("_key"), *(pa.array(out[:, i]) for i in range(out.shape[1]))], ["_key", *names])

    return written(moments.mapInArrow(solve, schema))


def effect_name(t: Term, part: int, column: int) -> str:
    return f"_e{column}" if len(t.parts) == 1 else f"_e{part}_{column}"


def _within(df: DataFrame, terms: list[Term], effects: list[DataFrame], columns: list[str]) -> DataFrame:
    out, keep = df, df.columns
    parts = {c: F.col(c) for c in columns}
    for n, (t, e) in enumerate(zip(terms, effects, strict=True)):
        names = {c: f"_t{n}{c}" for c in e.columns}
        e = e.select(*(F.col(c).alias(names[c]) for c in e.columns))
        out = out.join(e, F.col(t.key) == F.col(names["_key"]), "left")
        for m, s in enumerate(t.parts):
            for i, c in enumerate(columns):
                x = F.coalesce(F.col(names[effect_name(t, m, i)]), F.lit(0.0))
                parts[c] = parts[c] - (x if s is None else x * F.col(s))
    return out.select(*(F.col(c) for c in keep), *(parts[c].alias(f"_r_{c}") for c in columns))


def _on_driver(df, cells, terms, columns, tol, max_iter):
    spark = df.sparkSession
    data = cells.toArrow().to_pandas()
    w = data["_w"].to_numpy(float)
    rhs = data[[f"_v{i}" for i in range(len(columns))]].to_numpy(float)
    # Rows without weight have no part in the sums.
    codes, sizes, levels, known = [], [], [], {}
    for t in terms:
        if t.key not in known:
            c, u = pd.factorize(data[t.key])
            known[t.key] = len(codes)
            codes.append(c)
            sizes.append(len(u))
            levels.append(u)
    basis, centre, at = [], {}, []
    for n, t in enumerate(terms):
        g = known[t.key]
        for m, s in enumerate(t.parts):
            b = None if s is None else data[s].to_numpy(float)
            if b is not None and t.intercept:  # around its group's mean, for a better condition
                total = np.bincount(codes[g], w, sizes[g])
                mean = np.bincount(codes[g], w * b, sizes[g]) / np.where(total > 0, total, 1)
                centre[n, m] = mean
                b = b - mean[codes[g]]
            basis.append((g, b))
            at.append((n, m))
    solved, iterations = pcg_levels(codes, sizes, basis, w, rhs, tol, max_iter)
    effects = []
    for n, t in enumerate(terms):
        g = known[t.key]
        own = {m: x for (k, m), x in zip(at, solved, strict=True) if k == n}
        for m in own:
            if (n, m) in centre:
                own[0] = own[0] - centre[n, m][:, None] * own[m]
        table = {"_key": levels[g]} | {effect_name(t, m, i): x[:, i] for m, x in own.items() for i in range(len(columns))}
        effects.append(spark.createDataFrame(pd.DataFrame(table)))
    return effects, iterations


def _on_cluster(df, cells, terms, columns, tol, max_iter):
    """Gauss-Seidel over terms: each sweep takes the weighted means of what is left out of every term in turn, forth and back."""
    names = [f"_v{i}" for i in range(len(columns))]
    cells = cells.select("*", *(F.when(F.col("_w") > 0, F.col(v) / F.col("_w")).otherwise(0.0).alias(f"_x{i}") for i, v in enumerate(names)))
    scale = cells.agg(*(F.sqrt(F.sum(F.col("_w") * F.col(f"_x{i}") ** 2) / F.sum("_w")).alias(f"s{i}") for i in range(len(columns)))).first()
    effects: dict[int, DataFrame | None] = dict.fromkeys(range(len(terms)))
    held = None
    for it in range(1, max_iter + 1):
        gap = 0.0
        for n in [*range(len(terms)), *reversed(range(len(terms) - 1))]:
            t = terms[n]
            parts = t.parts
            # One level's intercept and slopes in turn; with several parts a sweep is itself a Gauss-Seidel step.
            for m, s in enumerate(parts):
                b = F.lit(1.0) if s is None else F.col(s)
                mean = cells.groupBy(F.col(t.key).alias("_key")).agg(*(F.try_divide(F.sum(F.col("_w") * b * F.col(f"_x{i}")), F.sum(F.col("_w") * b * b)).alias(f"m{i}") for i in range(len(columns))))
                mean = written(mean.select("_key", *(F.coalesce(f"m{i}", F.lit(0.0)).alias(f"m{i}") for i in range(len(columns)))))
                size = mean.agg(*(F.max(F.abs(f"m{i}")) for i in range(len(columns)))).first()
                gap = max(gap, *((abs(x or 0.0) / (y or 1.0)) for x, y in zip(size, scale, strict=True)))
                cells = cells.join(mean, F.col(t.key) == F.col("_key"))
                cells = cells.select(*(c for c in cells.columns if not c.startswith(("_x", "m", "_key"))), *((F.col(f"_x{i}") - b * F.col(f"m{i}")).alias(f"_x{i}") for i in range(len(columns))))
                step = mean.select("_key", *(F.col(f"m{i}").alias(effect_name(t, m, i)) for i in range(len(columns))))
                effects[n] = _added(effects[n], step, t, columns)
        last, cells = held, written(cells)
        held = cells
        if last is not None:  # only the last sweep's rows are read again
            dropped(last)
        effects = {n: written(e) for n, e in effects.items()}
        if gap <= tol * 10:
            return [effects[n] for n in range(len(terms))], it
    raise ConvergenceError(f"absorption did not converge in {max_iter} sweeps", code="convergence.absorption", details={"gap": gap})


def _added(old: DataFrame | None, step: DataFrame, t: Term, columns: list[str]) -> DataFrame:
    names = [effect_name(t, m, i) for m in range(len(t.parts)) for i in range(len(columns))]
    full = step.select("_key", *(F.col(n) if n in step.columns else F.lit(0.0).alias(n) for n in names))
    if old is None:
        return full
    return old.unionByName(full).groupBy("_key").agg(*(F.sum(n).alias(n) for n in names))

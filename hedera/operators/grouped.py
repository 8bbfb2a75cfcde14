"""Outcomes of groups with effects of their individuals: OLS on group rows, individuals through a membership table."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.errors import ConvergenceError, InputError, SpecificationError
from ..functions.linalg import equilibrated_gram_inverse
from ..functions.spec import normalize_absorb
from ..sources.data import numeric, ordered_projection
from .absorb import Term
from .moments import canonical_vce
from .problem import group_key
from .report import Result
from .structure import absorbed_dof


def compressed(data: DataFrame, group: str, constant: list[str]) -> DataFrame:
    """One row a group; columns must be constant within groups."""
    out = data.groupBy(group).agg(*(F.min(c).alias(c) for c in constant), *((F.min(c) != F.max(c)).alias(f"_x_{c}") for c in constant))
    bad = out.agg(*(F.count_if(F.col(f"_x_{c}")) for c in constant)).first()
    for c, n in zip(constant, bad, strict=True):
        if n:
            raise InputError(f"{c!r} varies within {n} groups", code="data.not_constant")
    return out.select(group, *constant)


def memberships(data: DataFrame, group: str, individual: str) -> DataFrame:
    m = data.select(group, individual)
    if m.groupBy(group, individual).count().where("count > 1").limit(1).count():
        raise InputError("an individual is in a group more than once", code="data.membership")
    return m


def drop_group_singletons(groups: DataFrame, members: DataFrame, group: str, individual: str, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Groups go that are alone in a level of an effect, or that have an individual who is in no other group, again and again."""
    n = groups.count()
    while True:
        for k in keys:
            groups = groups.join(groups.groupBy(k).count().where("count > 1").select(k), k, "left_semi")
        members = members.join(groups.select(group), group, "left_semi")
        lone = members.groupBy(individual).count().where("count <= 1").select(individual)
        gone = members.join(lone, individual, "left_semi").select(group).distinct()
        groups = groups.join(gone, group, "left_anti").persist()
        members = members.join(gone, group, "left_anti").persist()
        left = groups.count()
        if left == n:
            return groups, members
        n = left


def group_ols(data: DataFrame, *, y: str, x=(), absorb=(), group: str, individual: str | None = None, aggregation: str = "mean", vce: str | None = None, cluster: str | None = None, drop_singletons: bool = True, tol: float = 1e-10, max_iter: int = 16_000, most_rows: int = 20_000_000) -> Result:
    """OLS on one row a group. individual: an effect for each individual, averaged or summed over a group's members.

    absorb names the other effects (and the individual, if given, exactly once). The level-space system is solved by
    conjugate gradients on the driver; groups and memberships together are at most most_rows there.
    """
    if aggregation not in ("mean", "sum"):
        raise SpecificationError("aggregation is mean or sum", code="specification.aggregation")
    terms = normalize_absorb(absorb)
    if individual is not None:
        own = [t for t in terms if t.group == (individual,)]
        if len(own) != 1 or own[0].slopes:
            raise SpecificationError("the individual is in absorb= exactly once, without slopes", code="specification.individual")
        terms = [t for t in terms if t.group != (individual,)]
    x = [x] if isinstance(x, str) else list(x)
    constant = list(dict.fromkeys([y, *x, *(g for t in terms for g in t.group), *([cluster] if cluster else [])]))
    data = ordered_projection(data, [group, *([individual] if individual else []), *constant])
    for c in (y, *x):
        numeric(data, c)
    groups = compressed(data, group, constant)
    keyed = [f"g{i}" for i in range(len(terms))]
    groups = groups.select("*", *(group_key(groups, t.group).alias(k) for t, k in zip(terms, keyed, strict=True)))
    members = memberships(data, group, individual) if individual else None
    if drop_singletons and members is not None:
        groups, members = drop_group_singletons(groups, members, group, individual, keyed)
    if groups.limit(most_rows + 1).count() + (members.limit(most_rows + 1).count() if members is not None else 0) > most_rows:
        raise SpecificationError("too many groups and memberships for the driver", code="specification.size")
    g = groups.toArrow().to_pandas()
    v = np.column_stack([g[c].to_numpy(float) for c in (y, *x)])
    ops = []
    for k in keyed:
        codes, levels = pd.factorize(g[k])
        ops.append((np.arange(len(g)), codes, np.ones(len(g)), len(levels)))
    if members is not None:
        m = members.toArrow().to_pandas()
        row = pd.Series(np.arange(len(g)), index=g[group]).reindex(m[group]).to_numpy()
        codes, levels = pd.factorize(m[individual])
        size = np.bincount(row, minlength=len(g))
        ops.append((row, codes, 1.0 / size[row] if aggregation == "mean" else np.ones(len(m)), len(levels)))
    r, its = _residuals(v, ops, tol, max_iter)
    gram = r.T @ r
    bread, rank = equilibrated_gram_inverse(gram[1:, 1:]) if x else (np.zeros((0, 0)), 0)
    b = bread @ gram[1:, 0]
    e = r[:, 0] - r[:, 1:] @ b
    n = len(g)
    info = absorbed_dof(groups, [Term(k, True, (), t) for k, t in zip(keyed, terms, strict=True)], [cluster] if cluster else None)
    df_a = info.df_absorbed + (ops[-1][3] if members is not None else 0)
    k = rank + df_a
    kind = canonical_vce(vce) if vce else "cluster" if cluster else "iid"
    df_resid = max(n - k, 0)
    s = r[:, 1:] * e[:, None]
    if kind == "cluster":
        c, cl = pd.factorize(g[cluster])
        sums = np.stack([np.bincount(c, s[:, j], len(cl)) for j in range(len(x))], axis=1) if x else s
        meat = sums.T @ sums * (n - 1) / (n - k - any(info.nested_by_component)) * len(cl) / (len(cl) - 1)
        df_resid = min(df_resid, len(cl) - 1)
    else:
        meat = s.T @ s * n / max(n - k, 1)
    vcov = bread * (e @ e) / max(n - k, 1) if kind == "iid" else bread @ meat @ bread
    return Result(list(x), b, vcov, n, df_resid, "group-ols", kind, stats={"nobs": float(n), "df_absorbed": float(df_a), "rss": float(e @ e), "iterations": float(its)}, dof=info)


def _residuals(v: np.ndarray, ops: list[tuple], tol: float, max_iter: int) -> tuple[np.ndarray, int]:
    """What is left of columns after all effects, by conjugate gradients on their normal equations."""
    if not ops:
        return v, 0
    n, k = v.shape
    into = lambda op, q: np.stack([np.bincount(op[1], op[2] * q[op[0], j], op[3]) for j in range(q.shape[1])], axis=1)
    out_of = lambda op, p: np.stack([np.bincount(op[0], op[2] * p[op[1], j], n) for j in range(p.shape[1])], axis=1)
    diag = [np.maximum(np.bincount(op[1], op[2] ** 2, op[3]), 1e-300)[:, None] for op in ops]
    r = [into(op, v) for op in ops]
    x = [np.zeros_like(a) for a in r]
    z = [a / d for a, d in zip(r, diag, strict=True)]
    p = [a.copy() for a in z]
    dot = lambda a, b: sum((u * w).sum(axis=0) for u, w in zip(a, b, strict=True))
    rz = dot(r, z)
    start = np.maximum(rz, 1e-300)
    for it in range(1, max_iter + 1):
        q = sum(out_of(op, a) for op, a in zip(ops, p, strict=True))
        ap = [into(op, q) for op in ops]
        curve = dot(p, ap)
        a = np.where(curve > 0, rz / np.where(curve > 0, curve, 1), 0.0)
        x = [u + a * w for u, w in zip(x, p, strict=True)]
        r = [u - a * w for u, w in zip(r, ap, strict=True)]
        z = [u / d for u, d in zip(r, diag, strict=True)]
        new = dot(r, z)
        if (new <= tol**2 * start).all():
            return v - sum(out_of(op, u) for op, u in zip(ops, x, strict=True)), it
        p = [u + np.where(rz > 0, new / np.where(rz > 0, rz, 1), 0.0) * w for u, w in zip(z, p, strict=True)]
        rz = new
    raise ConvergenceError("the group system did not converge", code="convergence.absorption")

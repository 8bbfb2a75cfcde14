"""A regression problem on a Spark DataFrame: columns by role, checks, factor variables, sample, weights, absorption."""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.errors import CollinearityError, InvalidWeightError, OmittedVariableWarning, SpecificationError
from ..functions.linalg import ordered_rank
from ..functions.spec import Factor, FixedEffect, HDFEConfig, Interaction, Omit, normalize_absorb, terms_of
from ..sources.data import SampleHistory, numeric, ordered_projection, require
from .absorb import Absorbed, Term, absorb
from .moments import gram
from .structure import DofInfo, absorbed_dof, canonical, drop_singletons

#: Names of weight types and what else they are called (fixed values).
WEIGHTS = {"wls": ("wls", "generic"), "fweight": ("fweight", "fw", "frequency"), "aweight": ("aweight", "aw", "analytic"), "pweight": ("pweight", "pw", "probability")}


def weight_type(kind: str | None, given: bool) -> str:
    if not given:
        if kind:
            raise InvalidWeightError("a weight type needs weights=", code="weights.type")
        return "none"
    for k, known in WEIGHTS.items():
        if (kind or "wls").lower() in known:
            return k
    raise InvalidWeightError(f"unknown weight type {kind!r}", code="weights.type")


def group_key(df: DataFrame, parts: tuple[str, ...]) -> Column:
    """One column for a group: the column itself, or for a combination a text that names each part with its length."""
    if len(parts) == 1:
        c = F.col(f"`{parts[0]}`")
        return c if isinstance(df.schema[parts[0]].dataType, (T.IntegralType, T.StringType)) else c.cast("string")
    texts = [F.col(f"`{p}`").cast("string") for p in parts]
    return F.concat(*(x for t in texts for x in (F.length(t).cast("string"), F.lit(":"), t)))


@dataclass(frozen=True)
class Expanded:
    """A column of a design: its name, its expression on the input, and where it comes from."""

    name: str
    column: Column
    term: tuple = ()
    levels: tuple = ()


def factor_levels(df: DataFrame, f: Factor, most: int = 10_000) -> tuple[list, object]:
    """Sorted levels of a factor, and its base level (or None)."""
    rows = df.groupBy(F.col(f"`{f.variable}`").alias("l")).count().orderBy("l").limit(most + 1).collect()
    if len(rows) > most:
        raise SpecificationError(f"factor {f.variable!r} has more than {most} levels; absorb it instead", code="specification.levels")
    levels = [r["l"] for r in rows if r["l"] is not None]
    if not f.drop_base or f.base == "none" or not levels:
        return levels, None
    if f.base in (None, "first"):
        return levels, levels[0]
    if f.base == "last":
        return levels, levels[-1]
    if f.base == "freq":
        return levels, max(rows, key=lambda r: (r["count"], -levels.index(r["l"])))["l"]
    for x in levels:
        if x == f.base or str(x) == str(f.base):
            return levels, x
    raise SpecificationError(f"{f.base!r} is no level of {f.variable!r}", code="specification.base")


def expanded(df: DataFrame, x, omit: list[Omit] = ()) -> tuple[list[Expanded], list[str]]:
    """Design columns of regressors, and the names that the user omits. Cells without rows give no column."""
    out, omitted, known, used = [], [], {}, set()
    for term in terms_of(x):
        factors = [p for p in term if isinstance(p, Factor)]
        numbers = [p for p in term if not isinstance(p, Factor)]
        value = F.lit(1.0)
        for p in numbers:
            value = value * numeric(df, p)
        if not factors:
            out.append(Expanded("#".join(numbers), numeric(df, numbers[0]) if len(numbers) == 1 else value, term))
            continue
        for f in factors:
            if f not in known:
                known[f] = factor_levels(df, f)
        names = list(dict.fromkeys(f.variable for f in factors))
        cells = df.select(*(F.col(f"`{n}`") for n in names)).distinct().limit(100_001).collect()
        if len(cells) > 100_000:
            raise SpecificationError("an interaction has more than 100000 cells; absorb it instead", code="specification.levels")
        cells = [c for c in cells if all(c[f.variable] is not None and c[f.variable] != known[f][1] for f in factors)]
        for c in sorted(cells, key=lambda c: [known[f][0].index(c[f.variable]) for f in factors]):
            is_cell = F.lit(True)
            for f in factors:
                is_cell = is_cell & (F.col(f"`{f.variable}`") == F.lit(c[f.variable]))
            name = "#".join([f"{f.root}[{c[f.variable]}]" for f in factors] + numbers)
            out.append(Expanded(name, F.when(is_cell, value).otherwise(0.0), term, tuple((f.variable, c[f.variable]) for f in factors)))
    names = [e.name for e in out]
    if len(set(names)) < len(names):
        out = list({e.name: e for e in out}.values())
    keep = []
    for e in out:
        label = "#".join(f"i({p.variable})" if isinstance(p, Factor) else p for p in e.term)
        hit = [o for o in omit if (o.kind == "column" and o.what == e.name) or (o.kind == "term" and o.what in (label, "#".join(p.variable if isinstance(p, Factor) else p for p in e.term))) or (o.kind == "level" and any(v == o.what and str(lv) == str(o.level) for v, lv in e.levels) and o.term in (None, label))]
        used.update(hit)
        if hit:
            omitted.append(e.name)
        else:
            keep.append(e)
    for o in omit:
        if o not in used:
            raise SpecificationError(f"nothing matches the omission {o}", code="specification.omit")
    return keep, omitted


@dataclass
class Problem:
    """The rows and columns of a fit. frame has y, x<i>, g<i> (absorbed keys), s<i> (slopes), c<i> (clusters), w, t, p, r<name>."""

    frame: DataFrame
    names: dict[str, list[str]]
    columns: dict[str, list[str]]
    terms: list[Term]
    requested: list[Term]
    clusters: list[str]
    weights: str
    n: int
    n_eff: float
    history: SampleHistory
    config: HDFEConfig
    canonical_dropped: list[tuple[str, str]] = field(default_factory=list)
    omitted: dict[str, str] = field(default_factory=dict)
    held: list[DataFrame] = field(default_factory=list)

    @property
    def w(self) -> Column:
        return F.col("w")

    def keep(self, df: DataFrame) -> DataFrame:
        """df kept in memory or on disk until the fit is done."""
        df = df.persist(StorageLevel.MEMORY_AND_DISK)
        self.held.append(df)
        return df

    def release(self) -> None:
        for df in self.held:
            df.unpersist()
        self.held.clear()

    def absorbed(self, columns: list[str], tol: float | None = None) -> Absorbed:
        return absorb(self.frame, self.terms, columns, "w" if self.weights != "none" else None, self.config, tol)

    def dof(self, method: str | None = None) -> DofInfo:
        return absorbed_dof(self.frame, self.requested, self.clusters, method or self.config.dof_method)


def prepare(data: DataFrame, *, y: str, roles: dict[str, object], absorb=None, weights: str | None = None, kind: str | None = None, cluster=None, time: str | None = None, panel: str | None = None, extra: dict[str, str] | None = None, drop: bool = True, config: HDFEConfig | None = None, omit: list[Omit] = (), nonnegative: tuple[str, ...] = (), positive: tuple[str, ...] = (), normalize: bool = True) -> Problem:
    """Selects the needed columns, refuses missing values, expands factors, drops singletons, and weighs rows.

    roles: regressors by role (for example x, or exog, endog and instruments). extra: further numeric columns (name in the
    frame: column). Missing or non-finite values raise; rows are never dropped for them.
    """
    config = config or HDFEConfig()
    wanted = normalize_absorb(absorb)
    design = {r: expanded(data, x, [o for o in omit]) if r == next(iter(roles)) else expanded(data, x) for r, x in roles.items()}
    cols: dict[str, Column] = {"y": numeric(data, y, "outcome")}
    names, columns = {}, {}
    for r, (es, _) in design.items():
        names[r] = [e.name for e in es]
        columns[r] = [f"{r}{i}" for i in range(len(es))]
        cols |= dict(zip(columns[r], (e.column for e in es), strict=True))
    for name, c in (extra or {}).items():
        cols[f"r{name}"] = numeric(data, c, name)
    requested, keys, slope_names = [], {}, {}
    for f in wanted:
        ordered_projection(data, [*f.group, *f.slopes])
        key = keys.setdefault(f.group, f"g{len(keys)}")
        cols[key] = group_key(data, f.group)
        for s in f.slopes:
            cols[slope_names.setdefault(s, f"s{len(slope_names)}")] = numeric(data, s, "slope")
        requested.append(Term(key, f.intercept, tuple(slope_names[s] for s in f.slopes), f))
    clusters = []
    for c in [cluster] if isinstance(cluster, (str, Interaction)) else cluster or []:
        parts = c.parts if isinstance(c, Interaction) else (c,) if isinstance(c, str) else tuple(c)
        ordered_projection(data, parts)
        clusters.append(f"c{len(clusters)}")
        cols[clusters[-1]] = group_key(data, parts)
    for name, c in (("t", time), ("p", panel)):
        if c is not None:
            ordered_projection(data, [c])
            cols[name] = F.col(f"`{c}`")
    kind = weight_type(kind, weights is not None)
    if weights:
        cols["w"] = numeric(data, weights, "weight")
    df = data.select(*(c.alias(n) for n, c in cols.items()))
    label = {"y": y, "w": weights or "w"} | {c: n for r in names for c, n in zip(columns[r], names[r], strict=True)} | {f"r{k}": v for k, v in (extra or {}).items()}
    numbers = {c: label.get(c, c) for c in df.columns if c in label or c.startswith("s")}
    identifiers = {c: c for c in df.columns if c not in numbers}
    identifiers |= {keys[g]: "#".join(g) for g in keys}
    n = require(df, numbers, identifiers, nonnegative, (*positive, *(["w"] if weights and kind != "wls" else [])))
    if not n:
        raise SpecificationError("no rows", code="data.empty")
    if weights:
        low, high, whole = df.agg(F.min("w"), F.max("w"), F.max(F.abs(F.col("w") - F.round("w")))).first()
        if low < 0 or high <= 0:
            raise InvalidWeightError("weights are negative or all zero", code="weights.sign")
        if kind == "fweight" and whole > 1e-12:
            raise InvalidWeightError("frequency weights are whole numbers", code="weights.integer")
    history = SampleHistory()
    if drop and requested:
        df, gone, _ = drop_singletons(df, [t.key for t in requested if t.intercept], "w" if kind == "fweight" else None)
        history.note("singletons", gone)
        n -= gone
    terms, lost = canonical(df, requested) if config.canonicalize and len(requested) > 1 else (requested, [])
    n_eff = float(n)
    if not weights:
        df = df.withColumn("w", F.lit(1.0))
    elif kind == "fweight":
        df = df.withColumn("w", F.round("w"))
        n_eff = float(df.agg(F.sum("w")).first()[0] or 0)
    elif kind in ("aweight", "pweight") and normalize and n:
        total = df.agg(F.sum("w")).first()[0]
        df = df.withColumn("w", F.col("w") * (n / total))
    return Problem(df, names, columns, terms, requested, clusters, kind, n, n_eff, history, config, [(a.effect.label, b.effect.label) for a, b in lost], {x: "selected_by_user" for _, (_, om) in design.items() for x in om})


def independent(p: Problem, frame: DataFrame, columns: list[str], names: list[str], mode: str, tol: float = 1e-9, base: list[str] = ()) -> list[int]:
    """Which columns to keep, in order; others are named in p.omitted, with a warning (warn), silently (drop) or as an error (raise)."""
    if mode not in ("warn", "drop", "raise"):
        raise SpecificationError("collinearity is warn, drop or raise", code="specification.collinearity")
    if not columns:
        return []
    g = gram(frame, [F.col(f"_r_{c}") for c in columns], F.col("w"))
    mean = [F.avg(c) for c in columns]
    means = frame.agg(*mean).first()
    total = frame.agg(*(F.sum(F.col("w") * (F.col(c) - (m if p.terms else 0.0)) ** 2) for c, m in zip(columns, means, strict=True))).first()
    raw = frame.agg(*(F.sum(F.col("w") * F.col(c) ** 2) for c in columns)).first()
    keep, gone = ordered_rank(g, tol, np.array([max(a, 1e-12 * b) if b else 0.0 for a, b in zip(total, raw, strict=True)]))
    for j, (why, by) in gone.items():
        p.omitted[names[j]] = why + (f" ({', '.join(names[i] for i in by)})" if by else "")
    if gone:
        text = "; ".join(f"{names[j]}: {p.omitted[names[j]]}" for j in gone)
        if mode == "raise":
            raise CollinearityError(f"collinear regressors: {text}", details={names[j]: gone[j][0] for j in gone})
        if mode == "warn":
            warnings.warn(f"omitted: {text}", OmittedVariableWarning, stacklevel=3)
    return keep


def effect_frames(p: Problem, effects: list[DataFrame]) -> list[tuple[FixedEffect, DataFrame]]:
    return [(t.effect, e) for t, e in zip(p.terms, effects, strict=True)]

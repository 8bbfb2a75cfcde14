"""Recovering fixed effects: what is identified, and level coefficients under a normalization."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.errors import IdentificationError, SpecificationError
from .absorb import Term, effect_name
from .report import Result
from .structure import _union_find, categorical_rank, collected_codes, nested_within

NORMALIZATIONS = ("canonical", "mean_zero", "weighted_mean_zero", "reference", "solver")


@dataclass(frozen=True)
class Identification:
    """Rank and nullity of intercept effects: nullity is one shift for each component and effect after the first, and extra."""

    levels: tuple[int, ...]
    rank: int
    nullity: int
    components: int
    shifts: int
    extra: int

    @property
    def identified(self) -> bool:
        return self.extra == 0


def _graph(codes: list[np.ndarray]) -> np.ndarray:
    """Component of each cell in the graph that joins all its levels."""
    sizes = [int(c.max()) + 1 if len(c) else 0 for c in codes]
    starts = np.cumsum([0, *sizes[:-1]])
    a = np.concatenate([codes[0] + starts[0]] * (len(codes) - 1)) if len(codes) > 1 else codes[0]
    b = np.concatenate([c + s for c, s in zip(codes[1:], starts[1:], strict=True)]) if len(codes) > 1 else codes[0]
    label = _union_find(a, b, sum(sizes))
    return label[codes[0]]


def identification_structure(df: DataFrame, keys: list[str]) -> Identification:
    codes = collected_codes(df, keys)
    levels = tuple(int(c.max()) + 1 if len(c) else 0 for c in codes)
    rank = categorical_rank(codes)
    comps = len(np.unique(_graph(codes))) if len(codes) > 1 else levels[0]
    shifts = (len(keys) - 1) * comps if len(keys) > 1 else 0
    return Identification(levels, rank, sum(levels) - rank, comps, shifts, sum(levels) - rank - shifts)


def diagnose(result: Result) -> dict:
    """Issues of recovering a result's effects, with codes: disconnected components, nested effects, extra nullity."""
    p = result.problem
    pure = [t for t in p.terms if not t.slopes]
    issues = []
    if len(pure) > 1:
        s = identification_structure(p.frame, [t.key for t in pure])
        if s.components > 1:
            issues.append({"code": "effects.disconnected", "fatal": False, "components": s.components})
        if s.extra:
            issues.append({"code": "effects.extra_nullity", "fatal": True, "extra": s.extra})
        for a in pure:
            for b in pure:
                if a is not b and nested_within(p.frame, a.key, b.key):
                    issues.append({"code": "effects.nested", "fatal": True, "fine": a.effect.label, "coarse": b.effect.label})
    return {"issues": issues, "identified": not any(i["fatal"] for i in issues)}


def raise_for_identification(d: dict) -> None:
    if not d["identified"]:
        raise IdentificationError("the effects are not identified: " + ", ".join(i["code"] for i in d["issues"] if i["fatal"]), details=d)


def recover(result: Result, normalization: str = "canonical", baseline: int = 0, most_cells: int = 20_000_000) -> DataFrame:
    """Level coefficients of a fit: term, level, coef, component, mass and, where a reduced identification leaves doubt, identified.

    The sum of a row's coefficients is what the fit has for its effects. Within each component the other terms have mean
    zero over levels (canonical, mean_zero), over rows (weighted_mean_zero), or zero at their smallest level (reference);
    the baseline term takes the shifts. solver leaves the coefficients as the solver has them.
    """
    if normalization not in NORMALIZATIONS:
        raise SpecificationError(f"normalization is one of {NORMALIZATIONS}", code="specification.normalization")
    p = result.problem
    if any(t.slopes for t in p.terms):
        raise SpecificationError("coefficients of slopes are in result.effects; only intercepts are normalized", code="specification.slopes")
    spark = p.frame.sparkSession
    terms = p.terms
    keys = [t.key for t in terms]
    cells = p.frame.groupBy(*keys).agg(F.sum("w").alias("_w"))
    if cells.limit(most_cells + 1).count() > most_cells:
        raise IdentificationError("too many cells to recover effects on the driver", code="identification.rank_size")
    data = cells.toArrow().to_pandas()
    codes, levels = zip(*(pd.factorize(data[k]) for k in keys), strict=True)
    comp = _graph(list(codes)) if len(keys) > 1 else np.zeros(len(data), np.int64)
    values = [_coefficients(result, n, t, lv) for n, (t, lv) in enumerate(zip(terms, levels, strict=True))]
    mass = [np.bincount(c, data["_w"], len(lv)) for c, lv in zip(codes, levels, strict=True)]
    own = []
    for c, lv in zip(codes, levels, strict=True):
        x = np.zeros(len(lv), np.int64)
        x[c] = comp
        own.append(x)
    names = np.unique(comp)
    if normalization != "solver" and len(keys) > 1:
        base = values[baseline].copy()
        for n in range(len(keys)):
            if n == baseline:
                continue
            at = np.searchsorted(names, own[n])
            if normalization == "reference":
                order = np.argsort(levels[n].astype(str) if levels[n].dtype == object else levels[n], kind="stable")
                first = np.full(len(names), -1)
                for j in order[::-1]:
                    first[at[j]] = j
                shift = values[n][first]
            else:
                w = mass[n] if normalization == "weighted_mean_zero" else np.ones(len(values[n]))
                shift = np.bincount(at, w * values[n], len(names)) / np.bincount(at, w, len(names))
            values[n] = values[n] - shift[at]
            base += shift[np.searchsorted(names, own[baseline])]
        values[baseline] = base
    extra = identification_structure(p.frame, keys).extra if len(keys) > 2 else 0
    frames = [pd.DataFrame({"term": t.effect.label, "level": pd.Series(lv).astype(str), "coef": v, "component": np.searchsorted(names, o), "mass": m, "identified": extra == 0}) for t, lv, v, o, m in zip(terms, levels, values, own, mass, strict=True)]
    return spark.createDataFrame(pd.concat(frames, ignore_index=True))


def _coefficients(result: Result, n: int, t: Term, levels) -> np.ndarray:
    e = result.effects[n]
    if result.model.startswith(("ppml", "ivppml")):
        col = F.col(effect_name(t, 0, 0))
    else:
        col = F.col(effect_name(t, 0, 0))
        place = {c: k for k, c in enumerate(result.notes["absorbed"])}
        for c, b in zip(result.notes["columns"], result.coef, strict=True):
            col = col - F.lit(float(b)) * F.col(effect_name(t, 0, place[c]))
    got = e.select("_key", col.alias("v")).toArrow().to_pandas().set_index("_key")["v"]
    return got.reindex(levels).to_numpy(float)

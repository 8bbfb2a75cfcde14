"""Poisson pseudo-maximum likelihood with absorbed fixed effects, with and without instruments."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dist
from ..functions.errors import ConvergenceError, DivergenceError, InputError, SpecificationError, UnderidentifiedError, error_boundary
from ..functions.linalg import equilibrated_gram_inverse, ordered_rank, wald
from ..functions.spec import PPMLConfig
from ..sources.scratch import written
from .absorb import Absorbed, Term, absorb, effect_name
from .linear import Moments, combined
from .moments import canonical_vce, gram, multiway_meat, sandwich, score_covariance
from .problem import Problem, independent, prepare
from .report import Result

#: exp() neither overflows nor vanishes between these.
LOW, HIGH = -745.0, 709.0


def mean_of(eta: Column) -> Column:
    return F.exp(F.greatest(F.least(eta, F.lit(HIGH)), F.lit(LOW)))


def log_gamma(x: Column) -> Column:
    """lgamma for x >= 1: Stirling's series at x + 7, less the logarithms between."""
    z = x + 7
    series = 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - 1 / (1680 * z**7)
    step = F.log(x)
    for k in range(1, 7):
        step = step + F.log(x + k)
    return (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + series - step


def deviance_of(y: Column, mu: Column, eta: Column, w: Column) -> Column:
    return F.sum(2 * w * (mu - y + F.when(y > 0, y * (F.log(y) - eta)).otherwise(0.0)))


@dataclass
class State:
    """A linear predictor: coefficients and level effects; start: the first guess, from y alone."""

    b: np.ndarray
    effects: list[DataFrame]
    start: Column | None = None


def with_eta(frame: DataFrame, terms: list[Term], x: list[str], s: State) -> DataFrame:
    """frame with eta, mu, the working weight v and the working response z."""
    out, keep = frame, frame.columns
    if s.start is not None:
        eta = s.start
    else:
        eta = F.col("off") + combined([F.col(c) for c in x], s.b)
        for n, (t, e) in enumerate(zip(terms, s.effects, strict=True)):
            e = e.select(*(F.col(c).alias(f"_t{n}{c}") for c in e.columns))
            out = out.join(e, F.col(t.key) == F.col(f"_t{n}_key"), "left")
            for m, z in enumerate(t.parts):
                v = F.coalesce(F.col(f"_t{n}{effect_name(t, m, 0)}"), F.lit(0.0))
                eta = eta + (v if z is None else v * F.col(z))
    out = out.select(*(F.col(c) for c in keep), F.greatest(F.least(eta, F.lit(HIGH)), F.lit(LOW)).alias("eta"))
    mu = F.exp("eta")
    return out.select(*(F.col(c) for c in keep), "eta", mu.alias("mu"), F.greatest(F.col("w") * mu, F.lit(1e-20)).alias("v"), (F.col("eta") - F.col("off") - 1 + F.when(F.col("y") > 0, F.col("y") / mu).otherwise(0.0)).alias("z"))


def _predictor(a: Absorbed, terms: list[Term], b: np.ndarray, at: list[int]) -> list[DataFrame]:
    """Effects of the predictor: those of the working response (column 0) less those of the regressors at their columns."""
    out = []
    for t, e in zip(terms, a.effects, strict=True):
        cols = []
        for m in range(len(t.parts)):
            v = F.col(effect_name(t, m, 0))
            for k, c in zip(at, b, strict=True):
                v = v - F.lit(float(c)) * F.col(effect_name(t, m, k))
            cols.append(v.alias(effect_name(t, m, 0)))
        out.append(e.select("_key", *cols))
    return out


def _blend(old: list[DataFrame], new: list[DataFrame], share: float) -> list[DataFrame]:
    out = []
    for o, n in zip(old, new, strict=True):
        names = [c for c in n.columns if c != "_key"]
        o = o.select(F.col("_key"), *(F.col(c).alias(f"o{c}") for c in names))
        out.append(written(n.join(o, "_key").select("_key", *((share * F.col(f"o{c}") + (1 - share) * F.col(c)).alias(c) for c in names))))
    return out


# -------------------------------------------------------------------------------------------------------- separation


def fe_separated(df: DataFrame, keys: list[str]) -> tuple[DataFrame, int]:
    """Rows in levels of an effect where no outcome is positive go, again and again."""
    gone = 0
    while keys:
        empty = [df.groupBy(k).agg(F.max("y").alias("_m")).where("_m <= 0").select(k) for k in dict.fromkeys(keys)]
        if not any(e.limit(1).count() for e in empty):
            break
        before = df.count()
        for k, e in zip(dict.fromkeys(keys), empty, strict=True):
            df = df.join(e, k, "left_anti")
        df = written(df)
        gone += before - df.count()
    return df, gone


def sign_separated(df: DataFrame, terms: list[Term], x: list[str], config: PPMLConfig) -> tuple[DataFrame, int]:
    """Regressors that are redundant where y > 0 leave directions on the other rows; a direction of one sign separates its non-zero rows."""
    if not x:
        return df, 0
    tagged = df.withColumn("_pos", F.when(F.col("y") > 0, F.col("w")).otherwise(0.0))
    a = absorb(tagged, terms, x, "_pos", config.hdfe, 1e-11)
    r = [F.col(f"_r_{c}") for c in x]
    frame = written(a.frame)
    g = gram(frame, r, F.col("_pos"))
    total = np.diag(gram(frame, [F.col(c) for c in x], F.col("_pos")))
    keep, gone = ordered_rank(g, 1e-8, np.maximum(total, 1e-300))
    flag, scale = F.lit(False), frame.agg(*(F.max(F.abs(c)) for c in x)).first()
    for j in gone:
        b = np.linalg.lstsq(g[np.ix_(keep, keep)], g[keep, j], rcond=None)[0] if keep else np.zeros(0)
        d = r[j] - combined([r[i] for i in keep], b)
        tol = 1e-7 * max(scale[j] or 0.0, 1.0)
        low, high = frame.where("y = 0").agg(F.min(d), F.max(d)).first()
        if low is not None and low >= -tol and high > tol:
            flag = flag | ((F.col("y") == 0) & (d > tol))
        elif low is not None and high <= tol and low < -tol:
            flag = flag | ((F.col("y") == 0) & (d < -tol))
    n = frame.where(flag).count() if gone else 0
    return (written(frame.where(~flag).select(*df.columns)), n) if n else (df, 0)


def relu_separated(df: DataFrame, terms: list[Term], x: list[str], config: PPMLConfig) -> tuple[DataFrame, int]:
    """Rows that some combination of regressors and effects separates, by regressions of a rectified certificate.

    The certificate lives on the rows with y = 0; those with y > 0 get a weight so large that fits vanish there.
    """
    if not df.where("y = 0").limit(1).count():
        return df, 0
    big = float(math.ceil(np.finfo(float).eps ** -0.5))
    tol = config.relu_tol
    cur = written(df.select("*", F.when(F.col("y") == 0, 1.0).otherwise(big).alias("_rw"), F.when(F.col("y") == 0, 1.0).otherwise(0.0).alias("_u")))
    zero = F.col("y") == 0
    for _ in range(config.relu_max_iter):
        a = absorb(cur, terms, ["_u", *x], "_rw", config.hdfe, 1e-12)
        frame = a.frame
        r = [F.col(f"_r_{c}") for c in x]
        if x:
            m = gram(frame, [F.col("_r__u"), *r], F.col("_rw"))
            b = equilibrated_gram_inverse(m[1:, 1:], 1e-12)[0] @ m[1:, 0]
            resid = F.col("_r__u") - combined(r, b)
        else:
            resid = F.col("_r__u")
        norm = cur.where(zero).agg(F.sum(F.col("_u") ** 2)).first()[0] or 0.0
        delta = max(norm / big, 1e-8) + tol
        fit = F.when(zero, F.col("_u") - F.when(F.abs(resid) <= config.relu_zero_tol, 0.0).otherwise(resid)).otherwise(0.0)
        fit = F.when((fit >= -0.1 * delta) & (fit <= delta), 0.0).otherwise(fit)
        frame = written(frame.select(*cur.columns, fit.alias("_fit"), resid.alias("_e")))
        low, low_e = frame.where(zero).agg(F.min("_fit"), F.min(F.when(F.abs("_e") <= config.relu_zero_tol, 0.0).otherwise(F.col("_e")))).first()
        if low >= 0 or low_e >= 0:
            bad = zero & (F.col("_fit") > 0) & ((F.lit(low >= 0)) | (F.col("_e") <= delta))
            n = frame.where(bad).count()
            return (written(frame.where(~bad).select(*df.columns)), n) if n else (df, 0)
        cur = frame.select(*(c for c in cur.columns if c != "_u"), F.when(zero, F.greatest(F.col("_fit"), F.lit(0.0))).otherwise(0.0).alias("_u"))
    return df, 0


def separated_rows(x: np.ndarray, tol: float = 1e-10, max_iter: int = 1_000) -> np.ndarray:
    """Rows of a small matrix that some combination g with x g >= 0 makes positive: the rectified certificate on the driver."""
    u = np.ones(len(x))
    for _ in range(max_iter):
        fit = x @ np.linalg.lstsq(x, u, rcond=None)[0] if x.size else np.zeros(len(x))
        fit[np.abs(fit) <= tol] = 0.0
        if (fit >= 0).all():
            return fit > tol
        u = np.maximum(fit, 0.0)
        if not u.any():
            break
    return np.zeros(len(x), bool)


# ---------------------------------------------------------------------------------------------------------------- fit


@error_boundary("ppml")
def ppmlhdfe(data: DataFrame, *, y: str, x=(), absorb=None, offset: str | None = None, exposure: str | None = None, weights: str | None = None, cluster=None, vce: str | None = None, drop_singletons: bool = True, collinearity: str = "warn", config: PPMLConfig | None = None, level: float = 0.95) -> Result:
    """Poisson pseudo-maximum likelihood of y on x after absorbing fixed effects.

    Rows that y = 0 makes perfectly predictable are found and left out before the fit. Each step of iteratively reweighted
    least squares is three aggregations over the rows; level effects travel back by a join.
    """
    config = config or PPMLConfig()
    p = _prepared(data, y, {"x": x}, absorb, offset, exposure, weights, None, cluster, drop_singletons, config, True)
    return _fit(p, config, vce, collinearity, level, False)


@error_boundary("ivppml")
def ivppmlhdfe(data: DataFrame, *, y: str, exog=(), endog=(), instruments=(), absorb=None, offset: str | None = None, exposure: str | None = None, weights: str | None = None, weight_type: str | None = None, cluster=None, vce: str | None = None, drop_singletons: bool = True, collinearity: str = "warn", config: PPMLConfig | None = None, level: float = 0.95) -> Result:
    """Poisson with additive moments of instruments: each step is two-stage least squares on the working response."""
    config = config or PPMLConfig()
    if weight_type and weight_type.lower() in ("aweight", "aw", "analytic"):
        raise InputError("analytic weights have no meaning here", code="weights.type")
    p = _prepared(data, y, {"exog": exog, "endog": endog, "instruments": instruments}, absorb, offset, exposure, weights, weight_type, cluster, drop_singletons, config, False)
    return _fit(p, config, vce, collinearity, level, True)


def _prepared(data, y, roles, absorb, offset, exposure, weights, kind, cluster, drop, config, normalize) -> Problem:
    if offset and exposure:
        raise SpecificationError("either offset or exposure", code="specification.offset")
    extra = {"off": offset or exposure} if offset or exposure else {}
    p = prepare(data, y=y, roles=roles, absorb=absorb, weights=weights, kind=kind, cluster=cluster, extra=extra, drop=drop, config=config.hdfe, nonnegative=("y",), positive=(("roff",) if exposure else ()), normalize=False)
    off = F.log("roff") if exposure else F.col("roff") if offset else F.lit(0.0)
    p.frame = p.frame.withColumn("off", off)
    if not p.terms:  # a constant, as an effect of one level
        p.frame = p.frame.withColumn("g_all", F.lit(1))
        p.terms = p.requested = [Term("g_all")]
        p.requested = []
    return p


def _fit(p: Problem, config: PPMLConfig, vce: str | None, collinearity: str, level: float, iv: bool) -> Result:
    roles = ("exog", "endog", "instruments") if iv else ("x",)
    every = [c for r in roles for c in p.columns[r]]
    label = dict(zip(every, (n for r in roles for n in p.names[r]), strict=True))
    df = p.frame
    keys = [t.key for t in p.terms if t.intercept]
    for method in config.separation:
        rule = {"fe": lambda: fe_separated(df, keys), "simplex": lambda: sign_separated(df, p.terms, every, config), "relu": lambda: relu_separated(df, p.terms, every, config), "mu": lambda: (df, 0)}.get(method)
        if rule is None:
            raise SpecificationError(f"unknown separation method {method!r}", code="specification.separation")
        df, n = rule()
        p.history.note(f"separation:{method}", n)
    p.frame = df = p.keep(df)
    p.n = df.count()
    if not p.n or (df.agg(F.max("y")).first()[0] or 0) <= 0:
        raise SpecificationError("no positive outcome is left", code="data.separated")
    first = p.absorbed(every).frame if every else None
    xs = p.columns["x"] if not iv else p.columns["exog"] + p.columns["endog"]
    kept = {xs[i] for i in independent(p, first, xs, [label[c] for c in xs], collinearity)} if xs else set()
    if iv:
        q = [c for c in p.columns["exog"] if c in kept] + p.columns["instruments"]
        kept |= {q[i] for i in independent(p, first, q, [label[c] for c in q], collinearity)} if q else set()
    x = [c for c in xs if c in kept]
    ins = [c for c in p.columns["instruments"] if c in kept] if iv else []
    nc = len([c for c in p.columns["exog"] if c in kept]) if iv else len(x)
    if iv and len(ins) < len(x) - nc:
        raise UnderidentifiedError(f"{len(x) - nc} endogenous regressors and {len(ins)} instruments")

    for _ in range(6):
        state, info = _irls(p, df, x, ins, nc, config, iv)
        if "mu" not in config.separation:
            break
        full = with_eta(df, p.terms, x, state)
        low = full.where("y > 0").agg(F.min("eta")).first()[0]
        bad = (F.col("y") == 0) & (F.col("eta") <= math.log(config.mu_tol) + min(low + 5, 0.0))
        n = full.where(bad).count()
        if not n:
            break
        p.history.note("separation:mu", n)
        df = p.keep(written(full.where(~bad).select(*df.columns)))
        p.frame, p.n = df, df.count()

    full = p.keep(with_eta(df, p.terms, x, state))
    a = absorb(full, p.terms, ["z", *x, *ins], "v", config.hdfe, 1e-11)
    frame = p.keep(a.frame)
    mo = Moments(gram(frame, [F.col(f"_r_{c}") for c in ["z", *x, *ins]], F.col("v")), nc, len(x) - nc, len(ins))
    dof = p.dof(config.dof_method)
    # Frequency weights count rows in the mean only; nobs are rows.
    n, kind = float(p.n), canonical_vce(vce) if vce else "cluster" if p.clusters else "robust"
    r = [F.col(f"_r_{c}") for c in x]
    if iv:
        proj = np.linalg.pinv(mo.of(mo.q, mo.q), hermitian=True) @ mo.of(mo.q, mo.x) if x else np.zeros((0, 0))
        q = [F.col(f"_r_{c}") for c in [*x[:nc], *ins]]
        hat = [combined(q, proj[:, j]) for j in range(len(x))]
        bread, rank = equilibrated_gram_inverse(proj.T @ mo.of(mo.q, mo.q) @ proj) if x else (np.zeros((0, 0)), 0)
        resid = F.col("_r_z") - combined(r, state.b)
        scale = F.col("v") / F.sqrt("w") if p.weights == "fweight" and kind != "cluster" else F.col("v")
        scores = [h * resid * scale for h in hat]
        n_eff = p.frame.agg(F.sum("w")).first()[0] if p.weights == "fweight" else n
        sizes = []
        if not x:
            v = np.zeros((0, 0))
        elif kind == "cluster":
            meat, sizes = multiway_meat(frame, scores, p.clusters, by_subset=True)
            v = sandwich(bread, meat, len(p.clusters) > 1)
        else:
            kind = "robust"
            v = sandwich(bread, gram(frame, scores) * n_eff / max(n_eff - 1, 1), False)
    else:
        bread, rank = equilibrated_gram_inverse(mo.of(mo.x, mo.x)) if x else (np.zeros((0, 0)), 0)
        k = rank + dof.df_absorbed
        sizes = []
        if kind == "iid" or not x:
            v = bread
        else:
            meat, extra = score_covariance(frame, [c * F.col("w") * (F.col("y") - F.col("mu")) for c in r], kind, clusters=p.clusters, n=n, k=k, nested=int(any(dof.nested_by_component)))
            sizes = extra.get("clusters", [])
            v = sandwich(bread, meat, len(p.clusters) > 1)
    mean = full.agg(F.sum(F.col("w") * F.col("y")) / F.sum(F.col("w") * F.exp("off"))).first()[0]
    null = F.log(F.lit(mean)) + F.col("off")
    ll = lambda eta, mu: F.sum(F.col("w") * (F.col("y") * eta - mu - log_gamma(F.col("y") + 1)))
    one, zero = full.agg(ll(F.col("eta"), F.col("mu")), ll(null, F.exp(null))).first()
    chi2 = wald(state.b, v) if x else math.nan
    df_resid = min(sizes) - 1 if sizes else max(n - rank - dof.df_absorbed, 0.0)
    stats = info | {"nobs": n, "loglike": one, "loglike_null": zero, "pseudo_r2": 1 - one / zero if zero else math.nan, "chi2": chi2, "chi2_pvalue": dist.chi2_sf(chi2, len(x)), "df_absorbed": float(dof.df_absorbed), "separated": float(sum(k for s, k in p.history.stages if s.startswith("separation")))}
    return Result([label[c] for c in x], state.b, v, int(n), df_resid, "ivppml" if iv else "ppml", kind, "normal", level, stats, dof, {}, p.omitted, p.history, p, full, state.effects, {"columns": x})


def _irls(p: Problem, df: DataFrame, x: list[str], ins: list[str], nc: int, config: PPMLConfig, iv: bool) -> tuple[State, dict]:
    y, w = F.col("y"), F.col("w")
    mean = df.agg(F.sum(w * y) / F.sum(w)).first()[0]
    state = State(np.zeros(len(x)), [], F.log(F.greatest(0.5 * (y + F.lit(mean)), 0.05 * y, F.lit(1e-3))))
    work = with_eta(df, p.terms, x, state)
    before = work.agg(deviance_of(y, F.col("mu"), F.col("eta"), w)).first()[0]
    # anchor: the predictor from which a run of halvings began; every halving mixes with it.
    halvings, anchor = 0, state
    for it in range(1, config.max_iter + 1):
        if not halvings:
            anchor = state
        # The bound holds for predictors that were accepted, after halving.
        if iv and it > 10 and work.agg(F.max(F.abs("eta"))).first()[0] > 30:
            raise DivergenceError(f"the fit diverged at iteration {it}", details={"iteration": it}, suggestion="try more separation methods or fewer effects")
        a = absorb(work, p.terms, ["z", *x, *ins], "v", config.hdfe, 1e-11)
        cols = [F.col(f"_r_{c}") for c in ["z", *x, *ins]]
        if x:
            mo = Moments(gram(a.frame, cols, F.col("v")), nc, len(x) - nc, len(ins))
            if iv:
                half = mo.of(mo.x, mo.q) @ np.linalg.pinv(mo.of(mo.q, mo.q), hermitian=True)
                left, right = half @ mo.of(mo.q, mo.x), half @ mo.of(mo.q, mo.y)
            else:
                left, right = mo.of(mo.x, mo.x), mo.of(mo.x, mo.y)
            b = (equilibrated_gram_inverse(left)[0] @ right).ravel()
        else:
            b = np.zeros(0)
        new = State(b, _predictor(a, p.terms, b, list(range(1, len(x) + 1))))
        work = with_eta(df, p.terms, x, new)
        dev = work.agg(deviance_of(y, F.col("mu"), F.col("eta"), w)).first()[0]
        if not math.isfinite(dev):
            raise DivergenceError(f"the fit diverged at iteration {it}", details={"iteration": it}, suggestion="try more separation methods or fewer effects")
        delta = before - dev
        gap = abs(dev if dev < 0.1 * delta else delta) / max(min(dev, before), 0.1)
        if gap < config.tolerance or dev == 0:
            return new, {"deviance": dev, "iterations": float(it)}
        if iv and delta < 0 and it > 1 and halvings < config.max_step_halving and anchor.effects:
            share = config.step_halving_memory
            new = State(share * anchor.b + (1 - share) * b, _blend(anchor.effects, new.effects, share))
            work = with_eta(df, p.terms, x, new)
            halvings += 1
            state = new
            continue
        halvings, before, state = 0, dev, new
    raise ConvergenceError(f"no convergence in {config.max_iter} iterations", code="convergence.irls", details={"gap": gap})


# ---------------------------------------------------------------------------------------------------- split panels


@dataclass(frozen=True)
class SPJPanel:
    """kind A: unit and time; B: exporter, importer and pair; C: those and time. Each kind has its own effects and clusters."""

    kind: str
    time: str | None = None
    unit: str | None = None
    exporter: str | None = None
    importer: str | None = None
    pair: str | None = None

    def __post_init__(self):
        need = {"A": ("unit", "time"), "B": ("exporter", "importer", "pair", "time"), "C": ("exporter", "importer", "pair", "time")}
        if self.kind not in need or any(getattr(self, n) is None for n in need[self.kind]):
            raise SpecificationError(f"panel {self.kind!r} needs {need.get(self.kind, 'kind A, B or C')}", code="specification.panel")

    @property
    def absorb(self) -> list:
        if self.kind == "A":
            return [self.unit, self.time]
        own = [(self.exporter, self.time), (self.importer, self.time)]
        return own if self.kind == "B" else [*own, self.pair]


def _halves(data: DataFrame, columns: list[str], seed: int) -> dict[str, Column]:
    """A half, 0 or 1, for each level of the columns' common dictionary, by a hash with the seed (tried until both occur)."""
    levels = data.select(F.col(columns[0]).alias("l"))
    for c in columns[1:]:
        levels = levels.union(data.select(c))
    levels = levels.distinct()
    for k in range(32):
        low, high = levels.agg(F.min(F.pmod(F.xxhash64(F.lit(seed), F.lit(k), "l"), F.lit(2))), F.max(F.pmod(F.xxhash64(F.lit(seed), F.lit(k), "l"), F.lit(2)))).first()
        if low != high:
            return {c: F.pmod(F.xxhash64(F.lit(seed), F.lit(k), F.col(c)), F.lit(2)) for c in columns}
    raise SpecificationError("a split needs two units at least", code="resampling.spj_split")


@dataclass
class SPJResult:
    names: list[str]
    coef: np.ndarray
    full: np.ndarray
    components: dict[str, np.ndarray]
    fits: int

    @property
    def bias(self) -> np.ndarray:
        return self.full - self.coef


def ivppml_spj(data: DataFrame, *, panel: SPJPanel, y: str, exog=(), endog=(), instruments=(), seed: int = 0, config: PPMLConfig | None = None, **more) -> SPJResult:
    """Split-panel jackknife: the full fit corrected by fits on halves of units, of time, and of both."""
    data = written(data)
    fits = 0

    def fit(df: DataFrame) -> tuple[list[str], np.ndarray]:
        nonlocal fits
        fits += 1
        cluster = None if panel.kind == "A" else panel.pair
        r = ivppmlhdfe(df, y=y, exog=exog, endog=endog, instruments=instruments, absorb=panel.absorb, cluster=cluster, vce="robust" if panel.kind == "A" else "cluster", config=config, collinearity="drop", **more)
        out = r.names, r.coef
        r.release()
        return out

    names, full = fit(data)

    def mean(masks: list[Column]) -> np.ndarray:
        parts = []
        for m in masks:
            n, b = fit(data.where(m))
            if n != names:
                raise SpecificationError("a part of the panel has other coefficients", code="resampling.coefficient_set_changed")
            parts.append(b)
        return np.mean(parts, axis=0)

    low, high = data.agg(F.min(panel.time), F.max(panel.time)).first()
    early = F.col(panel.time) <= math.floor((low + high) / 2)
    parts: dict[str, np.ndarray] = {"full": full}
    if panel.kind == "A":
        parts["time_half"] = mean([early, ~early])
        h = _halves(data, [panel.unit], seed)[panel.unit]
        parts["unit_half"] = mean([h == 0, h == 1])
        coef = 3 * full - parts["time_half"] - parts["unit_half"]
    else:
        h = _halves(data, [panel.exporter, panel.importer], seed)
        e, i = h[panel.exporter], h[panel.importer]
        parts["country_mean"] = mean([(e == a) & (i == b) for a in (0, 1) for b in (0, 1)])
        coef = 2 * full - parts["country_mean"]
        if panel.kind == "C":
            parts["time_mean"] = mean([~early, early])
            parts["cross_mean"] = mean([(e == a) & (i == b) & (early if t else ~early) for a in (0, 1) for b in (0, 1) for t in (0, 1)])
            coef = 4 * full - 2 * parts["country_mean"] - 2 * parts["time_mean"] + parts["cross_mean"]
    return SPJResult(names, coef, full, parts, fits)

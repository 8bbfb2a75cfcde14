"""Linear models with absorbed fixed effects: OLS, 2SLS, LIML, k-class and two-step GMM."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.errors import InferenceError, SpecificationError, UnderidentifiedError, error_boundary
from ..functions.linalg import equilibrated_gram_inverse
from ..functions.spec import HDFEConfig
from .moments import canonical_vce, gram, sandwich, score_covariance
from .problem import Problem, independent, prepare
from .report import Result, linear_statistics


@dataclass
class Inference:
    """How covariances are made: what score_covariance needs besides frame and scores."""

    kind: str
    clusters: list[str]
    n: float
    nested: int
    time: str | None
    panel: str | None
    bandwidth: float | None
    kernel: str
    fweight: bool
    df_absorbed: float

    def scale(self) -> Column:
        """Scores of frequency weights stand for w equal rows in a robust covariance."""
        return F.sqrt(F.col("w")) if self.fweight and self.kind == "robust" else F.col("w")

    def covariance(self, frame: DataFrame, scores: list[Column], k: float, small: bool = True, center: bool = False, kernel: str | None = None, kind: str | None = None) -> tuple[np.ndarray, dict]:
        return score_covariance(frame, scores, kind or self.kind, clusters=self.clusters, n=self.n, k=k, nested=self.nested, small=small, time=self.time, panel=self.panel, bandwidth=self.bandwidth, kernel=kernel or self.kernel, center=center)


def inference(p: Problem, vce: str | None, time, panel, bandwidth, kernel, df_absorbed: float, nested: int) -> Inference:
    kind = canonical_vce(vce) if vce else "cluster" if p.clusters else "robust" if p.weights == "pweight" else "iid"
    if p.weights == "pweight" and kind == "iid":
        kind = "robust"
    if kind == "dkraay" and time is None:
        raise InferenceError("Driscoll and Kraay's covariance needs time=", code="inference.time")
    return Inference(kind, p.clusters, p.n_eff, nested, "t" if time else None, "p" if panel else None, bandwidth, kernel, p.weights == "fweight", df_absorbed)


def combined(columns: list[Column], b: np.ndarray) -> Column:
    out = F.lit(0.0)
    for c, v in zip(columns, b, strict=True):
        out = out + c * F.lit(float(v))
    return out


def _sums(frame: DataFrame) -> tuple[float, float, float]:
    """Weighted total sum of squares around the mean and around zero, and within."""
    mean = frame.agg(F.sum(F.col("w") * F.col("y")) / F.sum("w")).first()[0]
    return tuple(x or 0.0 for x in frame.agg(F.sum(F.col("w") * (F.col("y") - F.lit(mean)) ** 2), F.sum(F.col("w") * F.col("y") ** 2), F.sum(F.col("w") * F.col("_r_y") ** 2)).first())


@error_boundary("ols")
def olshdfe(data: DataFrame, *, y: str, x=(), absorb=None, weights: str | None = None, weight_type: str | None = None, cluster=None, vce: str | None = None, time: str | None = None, panel: str | None = None, bandwidth: float | None = None, kernel: str = "bartlett", drop_singletons: bool = True, collinearity: str = "warn", omit=(), config: HDFEConfig | None = None, level: float = 0.95) -> Result:
    """Ordinary or weighted least squares of y on x after absorbing fixed effects.

    Without absorb= the model has no intercept unless x has one. Two passes over the rows make the cells' sums and the
    within moments; a clustered or lagged covariance takes one more for each subset of cluster variables.
    """
    p = prepare(data, y=y, roles={"x": x}, absorb=absorb, weights=weights, kind=weight_type, cluster=cluster, time=time, panel=panel, drop=drop_singletons, config=config, omit=list(omit))
    return fit_ols(p, collinearity, vce, time, panel, bandwidth, kernel, level)


def fit_ols(p: Problem, collinearity="warn", vce=None, time=None, panel=None, bandwidth=None, kernel="bartlett", level=0.95) -> Result:
    cols, names = p.columns["x"], p.names["x"]
    a = p.absorbed(["y", *cols])
    frame = p.keep(a.frame)
    keep = independent(p, frame, cols, names, collinearity)
    x = [F.col(f"_r_{cols[i]}") for i in keep]
    m = gram(frame, [F.col("_r_y"), *x], F.col("w"))
    bread, rank = equilibrated_gram_inverse(m[1:, 1:]) if keep else (np.zeros((0, 0)), 0)
    b = bread @ m[1:, 0]
    dof = p.dof()
    nested = int(any(dof.nested_by_component))
    frame = frame.withColumn("_e", F.col("_r_y") - combined(x, b))
    i = inference(p, vce, time, panel, bandwidth, kernel, dof.df_absorbed, nested)
    k = rank + dof.df_absorbed
    rss = frame.agg(F.sum(F.col("w") * F.col("_e") ** 2)).first()[0] or 0.0
    info: dict = {}
    if i.kind == "iid" or not keep:
        v = bread * rss / max(p.n_eff - k, 1)
        if i.kind == "cluster":
            info["clusters"] = [frame.select(c).distinct().count() for c in p.clusters]
    else:
        meat, info = i.covariance(frame, [c * F.col("_e") * i.scale() for c in x], k)
        v = sandwich(bread, meat, len(p.clusters) > 1 and i.kind == "cluster")
    df_resid = max(p.n_eff - k, 0.0)
    if i.kind == "cluster":
        df_resid = min(df_resid, min(info["clusters"]) - 1)
    has = any(t.intercept for t in p.requested)
    tss, tss0, within = _sums(frame)
    stats = linear_statistics(rss, tss if has else tss0, within, b, v, n=p.n_eff, rank=rank, df_absorbed=dof.df_absorbed, nested=nested, df_resid=df_resid, intercept=has)
    stats |= {"nobs": float(p.n), "df_absorbed": float(dof.df_absorbed), "k_total": float(k), "iterations": float(a.iterations)}
    return Result([names[j] for j in keep], b, v, p.n, df_resid, "ols", i.kind, "t", level, stats, dof, {}, p.omitted, p.history, p, frame, a.effects, {"keep": keep, "bread": bread, "inference": i, "k": k, "columns": [cols[j] for j in keep], "absorbed": ["y", *cols], "method": a.method} | info)


reghdfe = olshdfe


# ----------------------------------------------------------------------------------------------------- instruments


@dataclass
class Moments:
    """Sums of products of y, controls C, endogenous E and instruments Z, with C partialled out where asked."""

    m: np.ndarray
    nc: int
    ne: int
    nz: int

    def __post_init__(self):
        at = np.cumsum([1, self.nc, self.ne, self.nz])
        self.y, self.c, self.e, self.z = [0], list(range(1, at[1])), list(range(at[1], at[2])), list(range(at[2], at[3]))
        self.x, self.q = self.c + self.e, self.c + self.z

    def of(self, a, b) -> np.ndarray:
        return self.m[np.ix_(a, b)]

    def partial(self) -> tuple[np.ndarray, np.ndarray]:
        """Moments of (y, E, Z) without C, and the coefficients of C in each."""
        other = self.y + self.e + self.z
        if not self.c:
            return self.of(other, other), np.zeros((0, len(other)))
        b = equilibrated_gram_inverse(self.of(self.c, self.c))[0] @ self.of(self.c, other)
        return self.of(other, other) - self.of(other, self.c) @ b, b


def _inverse(a: np.ndarray) -> np.ndarray:
    return equilibrated_gram_inverse(a)[0]


def _liml_kappa(mo: Moments) -> float:
    """The smallest eigenvalue of residual products of (y, E) on C relative to those on C and Z."""
    part, _ = mo.partial()
    ne = mo.ne
    w = part[: 1 + ne, : 1 + ne]
    z = part[: 1 + ne, 1 + ne :]
    inner = w - z @ _inverse(part[1 + ne :, 1 + ne :]) @ z.T
    chol = np.linalg.cholesky((inner + inner.T) / 2)
    half = np.linalg.solve(chol, np.linalg.solve(chol, w).T)
    return float(np.linalg.eigvalsh((half + half.T) / 2).min())


@error_boundary("iv")
def ivhdfe(data: DataFrame, *, y: str, exog=(), endog=(), instruments=(), absorb=None, weights: str | None = None, weight_type: str | None = None, cluster=None, vce: str | None = None, estimator: str = "2sls", kappa: float | None = None, fuller: float = 0.0, center: bool = False, time: str | None = None, panel: str | None = None, bandwidth: float | None = None, kernel: str = "bartlett", drop_singletons: bool = True, collinearity: str = "warn", diagnostics: bool = True, config: HDFEConfig | None = None, level: float = 0.95) -> Result:
    """Linear instrumental variables after absorbing fixed effects; estimator is 2sls, liml, kclass or gmm2s."""
    p = prepare(data, y=y, roles={"exog": exog, "endog": endog, "instruments": instruments}, absorb=absorb, weights=weights, kind=weight_type, cluster=cluster, time=time, panel=panel, drop=drop_singletons, config=config)
    return fit_iv(p, estimator, kappa, fuller, center, collinearity, vce, time, panel, bandwidth, kernel, diagnostics, level)


def fit_iv(p: Problem, estimator="2sls", kappa=None, fuller=0.0, center=False, collinearity="warn", vce=None, time=None, panel=None, bandwidth=None, kernel="bartlett", diagnostics=True, level=0.95) -> Result:
    from .ivdiag import all_diagnostics, stock_yogo

    if estimator not in ("2sls", "iv", "liml", "kclass", "gmm2s"):
        raise SpecificationError("the estimator is 2sls, liml, kclass or gmm2s", code="specification.estimator")
    every = [c for r in ("exog", "endog", "instruments") for c in p.columns[r]]
    label = dict(zip(every, (n for r in ("exog", "endog", "instruments") for n in p.names[r]), strict=True))
    a = p.absorbed(["y", *every])
    frame = p.keep(a.frame)
    # Controls come first, then endogenous regressors; instruments are tested against the controls alone.
    xe = p.columns["exog"] + p.columns["endog"]
    kept = {xe[i] for i in independent(p, frame, xe, [label[c] for c in xe], collinearity)}
    cq = [c for c in p.columns["exog"] if c in kept] + p.columns["instruments"]
    kept |= {cq[i] for i in independent(p, frame, cq, [label[c] for c in cq], collinearity)}
    c, e, z = ([x for x in p.columns[r] if x in kept] for r in ("exog", "endog", "instruments"))
    if len(z) < len(e):
        raise UnderidentifiedError(f"{len(e)} endogenous regressors and {len(z)} instruments")
    col = lambda xs: [F.col(f"_r_{x}") for x in xs]
    mo = Moments(gram(frame, [F.col("_r_y"), *col(c), *col(e), *col(z)], F.col("w")), len(c), len(e), len(z))
    dof = p.dof()
    nested = int(any(dof.nested_by_component))
    i = inference(p, vce, time, panel, bandwidth, kernel, dof.df_absorbed, nested)
    x, q = col(c + e), col(c + z)
    proj = _inverse(mo.of(mo.q, mo.q)) @ mo.of(mo.q, mo.x)
    xpx, xpy = mo.of(mo.x, mo.q) @ proj, proj.T @ mo.of(mo.q, mo.y)
    meta: dict = {"estimator": estimator}

    def solved(k: float) -> tuple[np.ndarray, np.ndarray, int]:
        left = (1 - k) * mo.of(mo.x, mo.x) + k * xpx
        right = (1 - k) * mo.of(mo.x, mo.y) + k * xpy
        bread, rank = equilibrated_gram_inverse((left + left.T) / 2) if len(left) else (np.zeros((0, 0)), 0)
        return (bread @ right).ravel(), bread, rank

    if estimator == "gmm2s":
        b, bread, rank = solved(1.0)
        meta["first_step"] = b
        first = frame.withColumn("_e", F.col("_r_y") - combined(x, b))
        if i.kind == "iid":
            mean, second = first.agg(F.sum(F.col("_e") * F.sqrt("w")) / i.n, F.sum(F.col("w") * F.col("_e") ** 2) / i.n).first()
            s = (second - mean**2) * mo.of(mo.q, mo.q)
        else:
            s, _ = i.covariance(first, [v * F.col("_e") * i.scale() for v in q], 0, small=False, center=center)
        w = np.linalg.pinv((s + s.T) / 2, hermitian=True)
        xz = mo.of(mo.x, mo.q)
        bread, rank = equilibrated_gram_inverse(xz @ w @ xz.T)
        b = (bread @ xz @ w @ mo.of(mo.q, mo.y)).ravel()
        meta["weight_matrix"] = w
    else:
        if estimator == "kclass" and kappa is None:
            raise SpecificationError("estimator='kclass' needs kappa=", code="specification.kappa")
        k = kappa if kappa is not None else _liml_kappa(mo) if estimator == "liml" else 1.0
        if estimator == "liml":
            meta["liml_kappa"] = k if kappa is None else _liml_kappa(mo)
        k -= fuller / max(p.n - len(q), 1) if fuller else 0.0
        meta |= {"kappa": k, "fuller": fuller}
        b, bread, rank = solved(k)
    frame = frame.withColumn("_e", F.col("_r_y") - combined(x, b))
    rss = frame.agg(F.sum(F.col("w") * F.col("_e") ** 2)).first()[0] or 0.0
    kt = rank + dof.df_absorbed
    info: dict = {}
    if estimator == "gmm2s":
        if i.kind == "iid":
            s2 = rss / max(p.n_eff - kt, 1) * mo.of(mo.q, mo.q)
        else:
            s2, info = i.covariance(frame, [v * F.col("_e") * i.scale() for v in q], kt, center=center)
        half = bread @ xz @ w
        v = sandwich(half, s2, len(p.clusters) > 1)
    elif i.kind == "iid":
        v = bread * rss / max(p.n_eff - kt, 1)
    else:
        fitted = [combined(q, proj[:, j]) for j in range(len(x))]
        meat, info = i.covariance(frame, [f * F.col("_e") * i.scale() for f in fitted], kt)
        v = sandwich(bread, meat, len(p.clusters) > 1 and i.kind == "cluster")
    df_resid = max(p.n_eff - kt, 0.0)
    if i.kind == "cluster":
        sizes = info.get("clusters") or [frame.select(k).distinct().count() for k in p.clusters]
        df_resid = min(df_resid, min(sizes) - 1)
    has = any(t.intercept for t in p.requested)
    tss, tss0, within = _sums(frame)
    stats = linear_statistics(rss, tss if has else tss0, within, b, v, n=p.n_eff, rank=rank, df_absorbed=dof.df_absorbed, nested=nested, df_resid=df_resid, intercept=has)
    stats |= {"nobs": float(p.n), "df_absorbed": float(dof.df_absorbed), "k_total": float(kt)} | {k: float(x) for k, x in meta.items() if isinstance(x, (int, float))}
    tests = all_diagnostics(frame, mo, c, e, z, i, meta, estimator) if diagnostics and e else {}
    if diagnostics and e:
        tests["stock_yogo"] = stock_yogo(len(z), len(e), estimator)
    return Result([label[n] for n in c + e], b, v, p.n, df_resid, f"iv-{estimator}", i.kind, "t", level, stats, dof, tests, p.omitted, p.history, p, frame, a.effects, meta | info | {"columns": c + e, "absorbed": ["y", *every]})


ivreghdfe = ivhdfe

"""Results and what is reported of them."""

from __future__ import annotations

import math
import platform
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from ..functions import dist
from ..functions.linalg import wald

TABLE = "variable string, estimate double, std_error double, statistic double, p_value double, ci_low double, ci_high double, stars string"


def inference_table(names: list[str], coef: np.ndarray, se: np.ndarray, level: float = 0.95, df: float | None = None, distribution: str = "normal") -> list[tuple]:
    """(name, estimate, error, statistic, p, interval, stars); t without valid degrees of freedom gives nan, never normal values."""
    if distribution == "t":
        ok = df is not None and df > 0
        crit, tail = (dist.t_ppf((1 + level) / 2, df), lambda x: dist.t_sf(x, df)) if ok else (math.nan, lambda x: math.nan)
    else:
        crit, tail = dist.normal_ppf((1 + level) / 2), dist.normal_sf
    out = []
    for n, b, s in zip(names, coef, se, strict=True):
        stat = b / s if s > 0 else math.nan
        p = 2 * tail(abs(stat)) if not math.isnan(stat) else math.nan
        stars = "***" if p < 0.01 else "**" if p < 0.05 else "*" if p < 0.1 else ""
        out.append((n, float(b), float(s), float(stat), float(p), float(b - crit * s), float(b + crit * s), stars))
    return out


def r2_statistics(rss: float, tss: float, tss_within: float, n: float, rank: int, df_absorbed: float, nested: float, intercept: bool) -> dict[str, float]:
    """R2 overall and within, plain and adjusted; the fit's degrees of freedom are n less absorbed, nested and rank."""
    tiny, nan = np.finfo(float).eps, math.nan
    fit = n - df_absorbed - nested - rank
    total = n - (1 if intercept else 0)
    ok = fit > 0
    return {
        "r2": 1 - rss / tss if tss > tiny else nan,
        "r2_within": 1 - rss / tss_within if tss_within > tiny else nan,
        "r2_adjusted": 1 - (rss / fit) / (tss / total) if ok and tss > tiny and total > 0 else nan,
        "r2_adjusted_within": 1 - (rss / fit) / (tss_within / (fit + rank)) if ok and tss_within > tiny and fit + rank > 0 else nan,
        "df_resid_fit": fit,
    }


def model_f(b: np.ndarray, v: np.ndarray, df_resid: float) -> tuple[float, float]:
    f = wald(b, v) / max(len(b), 1)
    return f, dist.f_sf(f, len(b), df_resid) if len(b) else math.nan


def linear_statistics(rss, tss, tss_within, b, v, *, n, rank, df_absorbed, nested, df_resid, intercept=True) -> dict[str, float]:
    base = r2_statistics(rss, tss, tss_within, n, rank, df_absorbed, nested, intercept)
    fit = base["df_resid_fit"]
    likelihood = lambda s: -0.5 * n * (1 + math.log(2 * math.pi) + math.log(s / n)) if n > 0 and s > np.finfo(float).eps else math.nan
    f, p = model_f(b, v, df_resid)
    return base | {
        "rss": rss, "tss": tss, "tss_within": tss_within, "mss": tss - rss, "rmse": math.sqrt(rss / fit) if fit > 0 and rss >= 0 else math.nan,
        "loglike": likelihood(rss), "loglike_null": likelihood(tss_within), "f_statistic": f, "f_pvalue": p, "df_model": float(rank),
    }


@dataclass
class Result:
    """Coefficients, their covariance and statistics of a fit; frame has the rows' fitted parts where they are kept."""

    names: list[str]
    coef: np.ndarray
    vcov: np.ndarray
    n: int
    df_resid: float
    model: str
    vce: str
    distribution: str = "t"
    level: float = 0.95
    stats: dict = field(default_factory=dict)
    dof: object = None
    diagnostics: dict = field(default_factory=dict)
    omitted: dict = field(default_factory=dict)
    history: object = None
    problem: object = None
    frame: DataFrame | None = None
    effects: list = field(default_factory=list)
    notes: dict = field(default_factory=dict)

    @property
    def stderr(self) -> np.ndarray:
        return np.sqrt(np.maximum(np.diag(self.vcov), 0)) if len(self.coef) else np.zeros(0)

    @property
    def params(self) -> dict[str, float]:
        return dict(zip(self.names, map(float, self.coef), strict=True))

    def rows(self, level: float | None = None) -> list[tuple]:
        return inference_table(self.names, self.coef, self.stderr, level or self.level, self.df_resid, self.distribution)

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows(), TABLE)

    def vcov_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(a, b, float(self.vcov[i, j])) for i, a in enumerate(self.names) for j, b in enumerate(self.names)], "row string, col string, value double")

    def stats_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(k, float(v)) for k, v in self.stats.items() if isinstance(v, (int, float))], "statistic string, value double")

    def wald_test(self, r: np.ndarray, q=0.0) -> dict[str, float]:
        """H0: r b = q."""
        r = np.atleast_2d(r)
        chi2 = wald(r @ self.coef - q, r @ self.vcov @ r.T)
        f = chi2 / len(r)
        return {"chi2": chi2, "f": f, "df": len(r), "p_value": dist.f_sf(f, len(r), self.df_resid) if self.distribution == "t" else dist.chi2_sf(chi2, len(r))}

    def release(self) -> None:
        if self.problem is not None:
            self.problem.release()


def publication_output(r: Result, level: float | None = None, diagnostics: bool = True) -> dict:
    keys = ("variable", "estimate", "std_error", "statistic", "p_value", "ci_low", "ci_high", "stars")
    return {
        "coefficients": [dict(zip(keys, row, strict=True)) for row in r.rows(level)],
        "model": {"model": r.model, "vce": r.vce, "nobs": r.n, "df_resid": r.df_resid, "omitted": r.omitted, **{k: v for k, v in r.stats.items() if isinstance(v, (int, float, str))}},
        "tests": r.diagnostics if diagnostics else {},
    }


def reproducibility(**settings) -> dict:
    import pyspark

    from .. import __version__

    return {"engine": __version__, "python": platform.python_version(), "pyspark": pyspark.__version__, "numpy": np.__version__} | settings


def error_report(error: Exception, **context) -> str:
    """A Markdown report of an error: its kind, code, stage and parameters, and never data values."""
    info = error.to_dict() if hasattr(error, "to_dict") else {"type": type(error).__name__, "code": "unexpected", "stage": None}
    lines = ["# Error report", ""] + [f"- {k}: {info.get(k)}" for k in ("type", "code", "stage")]
    lines += ["", "## Settings", ""] + [f"- {k}: {v if isinstance(v, (int, float, bool)) or v is None else type(v).__name__ if not isinstance(v, str) else v}" for k, v in sorted(context.items())]
    lines += ["", "## Versions", ""] + [f"- {k}: {v}" for k, v in reproducibility().items()]
    return "\n".join(lines) + "\n"


def write_error_report(path: str, error: Exception, **context) -> str:
    with open(path, "w") as f:
        f.write(error_report(error, **context))
    return path

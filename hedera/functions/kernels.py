"""Lag kernels of heteroskedasticity- and autocorrelation-consistent covariances."""

from __future__ import annotations

import math

from .errors import SpecificationError

#: Names of kernels and what else they are called (fixed values).
ALIASES = {
    "bartlett": ("bartlett", "bar", "newey_west", "neweywest"),
    "truncated": ("truncated", "tru"),
    "parzen": ("parzen", "par"),
    "tukey_hanning": ("tukey_hanning", "thann", "tukey-hanning"),
    "tukey_hamming": ("tukey_hamming", "thamm", "tukey-hamming"),
    "quadratic_spectral": ("quadratic_spectral", "qs", "quadratic-spectral"),
    "daniell": ("daniell", "dan"),
    "tent": ("tent", "ten"),
}
SPECTRAL = ("quadratic_spectral", "daniell", "tent")


def canonical_kernel(kernel: str) -> str:
    name = str(kernel).strip().lower().replace(" ", "_")
    for k, known in ALIASES.items():
        if name in known:
            return k
    raise SpecificationError(f"unknown kernel {kernel!r}", code="inference.kernel", details={"kernel": kernel})


def kernel_type(kernel: str) -> str:
    return "spectral" if canonical_kernel(kernel) in SPECTRAL else "lag"


def automatic_bandwidth(n_periods: int) -> int:
    return max(1, math.floor(4 * (n_periods / 100) ** (2 / 9)) + 1)


def kernel_weight(lag: float, bandwidth: float, kernel: str = "bartlett") -> float:
    """Weight of a lag. Lag kernels vanish beyond the bandwidth; spectral ones do not."""
    k, lag = canonical_kernel(kernel), abs(int(lag))
    if lag == 0:
        return 1.0
    if not (math.isfinite(bandwidth) and bandwidth > 0):
        raise SpecificationError("the bandwidth must be positive", code="inference.bandwidth")
    x = lag / bandwidth
    if k in ("quadratic_spectral", "daniell"):
        z = math.pi * x
        return math.sin(z) / z if k == "daniell" else 3 / (1.2 * z) ** 2 * (math.sin(1.2 * z) / (1.2 * z) - math.cos(1.2 * z))
    if k == "tent":
        return 2 * (1 - math.cos(lag * x)) / x**2
    if x > 1:
        return 0.0
    if k == "parzen":
        return 1 - 6 * x**2 + 6 * x**3 if x <= 0.5 else 2 * (1 - x) ** 3
    if k in ("tukey_hanning", "tukey_hamming"):
        a = 0.5 if k == "tukey_hanning" else 0.54
        return a + (1 - a) * math.cos(math.pi * x)
    return 1 - x if k == "bartlett" else 1.0


def max_lag(n_periods: int, bandwidth: float, kernel: str, span: float | None = None) -> int:
    """The largest lag with a weight: the bandwidth for lag kernels, the whole span for spectral ones."""
    most = n_periods - 1 if span is None else int(span)
    return max(0, most if kernel_type(kernel) == "spectral" else min(math.floor(bandwidth), most))

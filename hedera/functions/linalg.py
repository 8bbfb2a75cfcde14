"""Small dense algebra on the driver: inverses of moment matrices, ranks, repairs."""

from __future__ import annotations

import numpy as np


def equilibrated_gram_inverse(g: np.ndarray, cutoff: float = 1e-15) -> tuple[np.ndarray, int]:
    """The (pseudo-)inverse of a moment matrix after scaling it to a unit diagonal, and its rank."""
    g = np.atleast_2d(np.asarray(g, float))
    d = np.sqrt(np.maximum(np.diag(g), 0))
    d = np.where(d > 0, d, 1.0)
    values, vectors = np.linalg.eigh((g + g.T) / 2 / np.outer(d, d))
    keep = values > cutoff * max(values.max(initial=0), 0) * len(values)
    inverse = (vectors[:, keep] / values[keep]) @ vectors[:, keep].T
    return inverse / np.outer(d, d), int(keep.sum())


def fix_psd(v: np.ndarray) -> np.ndarray:
    """A symmetric matrix with its negative eigenvalues set to 0."""
    v = (v + v.T) / 2
    values, vectors = np.linalg.eigh(v)
    return v if values.min(initial=0) >= 0 else (vectors * np.maximum(values, 0)) @ vectors.T


def ordered_rank(gram: np.ndarray, tol: float = 1e-10, total: np.ndarray | None = None) -> tuple[list[int], dict[int, tuple[str, tuple[int, ...]]]]:
    """Columns to keep, in order, and for each other one why it goes and what determines it.

    gram: moments of the columns after absorption; total: their sums of squares before. A column goes if next to nothing of
    it is left after absorption, or if the columns kept so far determine it.
    """
    k = len(gram)
    total = np.diag(gram) if total is None else np.asarray(total, float)
    keep: list[int] = []
    gone: dict[int, tuple[str, tuple[int, ...]]] = {}
    basis = np.zeros((0, k))  # coefficients of orthonormal directions
    for j in range(k):
        size = gram[j, j]
        if size <= tol**2 * max(total[j], 0) or size <= 0 or size <= 1e-14 * total[j]:
            gone[j] = ("absorbed_or_zero", ())
            continue
        c = np.zeros(k)
        c[j] = 1.0
        for _ in range(2):
            c = c - basis.T @ (basis @ gram @ c)
        left = float(c @ gram @ c)
        if left <= max(tol**2, 1e-13) * size:
            b = np.linalg.lstsq(gram[np.ix_(keep, keep)], gram[keep, j], rcond=None)[0]
            scale = np.abs(b) * np.sqrt(np.diag(gram)[keep]) / np.sqrt(size)
            by = tuple(i for i, s in zip(keep, scale, strict=True) if s > 1e-6)
            gone[j] = ("duplicate_or_scaled" if len(by) == 1 else "linear_combination", by)
            continue
        basis = np.vstack([basis, c / np.sqrt(left)])
        keep.append(j)
    return keep, gone


def wald(b: np.ndarray, v: np.ndarray) -> float:
    """b' V^-1 b, nan if V has no full rank."""
    b = np.atleast_1d(b)
    inverse, rank = equilibrated_gram_inverse(v, 1e-12)
    return float(b @ inverse @ b) if rank == len(b) and len(b) else float("nan")

"""Moments of a stream: a fit with one absorbed effect from sums that a streaming aggregation keeps."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.linalg import equilibrated_gram_inverse


def running_moments(stream: DataFrame, key: str, y: str, x: list[str]) -> DataFrame:
    """For each level of key the count, sums and sums of products of y and x; write it in complete or update mode."""
    cols = [F.col(c).cast("double") for c in (y, *x)]
    sums = [F.sum(c).alias(f"s{i}") for i, c in enumerate(cols)]
    products = [F.sum(cols[i] * cols[j]).alias(f"p{i}_{j}") for i in range(len(cols)) for j in range(i, len(cols))]
    return stream.groupBy(F.col(key).alias("level")).agg(F.count(F.lit(1)).alias("n"), *sums, *products)


def ols_from_moments(moments: DataFrame, k: int) -> dict:
    """Coefficients and unadjusted covariance within levels, from running_moments with k regressors."""
    pairs = [(i, j) for i in range(k + 1) for j in range(i, k + 1)]
    row = moments.agg(F.sum("n"), F.count(F.lit(1)), *(F.sum(F.col(f"p{i}_{j}") - F.col(f"s{i}") * F.col(f"s{j}") / F.col("n")) for i, j in pairs)).first()
    m = np.zeros((k + 1, k + 1))
    for (i, j), v in zip(pairs, row[2:], strict=True):
        m[i, j] = m[j, i] = v or 0.0
    bread, rank = equilibrated_gram_inverse(m[1:, 1:])
    b = bread @ m[1:, 0]
    rss = m[0, 0] - b @ m[1:, 0]
    return {"coef": b, "vcov": bread * rss / max(row[0] - row[1] - rank, 1), "n": row[0], "levels": row[1]}

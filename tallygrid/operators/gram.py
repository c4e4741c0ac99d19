"""Cross-product matrices from one aggregate pass; only p×p numbers reach the driver."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Moments:
    """Count, means and centred cross-products of the listed columns."""

    names: tuple[str, ...]
    n: int
    mean: np.ndarray
    cross: np.ndarray

    def pick(self, names: Sequence[str]) -> "Moments":
        at = [self.names.index(c) for c in names]
        return Moments(tuple(names), self.n, self.mean[at], self.cross[np.ix_(at, at)])

    def raw(self) -> np.ndarray:
        """Uncentred cross-products."""
        return self.cross + self.n * np.outer(self.mean, self.mean)

    def design(self) -> np.ndarray:
        """X'X with a leading column of ones."""
        p = len(self.names)
        out = np.empty((p + 1, p + 1))
        out[0, 0] = self.n
        out[0, 1:] = out[1:, 0] = self.n * self.mean
        out[1:, 1:] = self.raw()
        return out


def complete_rows(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows in which every listed column is a number."""
    ok = None
    for c in cols:
        here = F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
        ok = here if ok is None else ok & here
    return df.filter(ok)


def moments(df: DataFrame, cols: Sequence[str]) -> Moments:
    """Means and centred cross-products over rows complete in ``cols``.

    The covariance aggregates merge central moments, so large means cost no digits.
    """
    cols = list(cols)
    num = [F.col(c).cast("double") for c in cols]
    aggs: list[Column] = [F.count(F.lit(1)).alias("n")]
    aggs += [F.avg(c).alias(f"m{i}") for i, c in enumerate(num)]
    for i in range(len(num)):
        for j in range(i, len(num)):
            aggs.append(F.covar_pop(num[i], num[j]).alias(f"c{i}_{j}"))
    row = complete_rows(df, cols).agg(*aggs).first()
    n, p = row["n"], len(cols)
    mean, cross = np.zeros(p), np.zeros((p, p))
    if n:
        mean = np.array([row[f"m{i}"] for i in range(p)])
        for i in range(p):
            for j in range(i, p):
                cross[i, j] = cross[j, i] = row[f"c{i}_{j}"] * n
    return Moments(tuple(cols), n, mean, cross)


def linear(names: Sequence[str], coefs: Sequence[float], intercept: float = 0.0) -> Column:
    out = F.lit(float(intercept))
    for c, b in zip(names, coefs):
        out = out + F.lit(float(b)) * F.col(c)
    return out


def quadratic_form(names: Sequence[str], centre: Sequence[float], matrix: np.ndarray) -> Column:
    """(x − centre)' M (x − centre) as a column expression."""
    d = [F.col(c).cast("double") - F.lit(float(m)) for c, m in zip(names, centre)]
    out = F.lit(0.0)
    for i in range(len(d)):
        for j in range(i, len(d)):
            out = out + F.lit(float(matrix[i, j] * (1 if i == j else 2))) * d[i] * d[j]
    return out


def solve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Solution of a symmetric system; an error when the columns are collinear."""
    scale = np.sqrt(np.clip(np.diag(a), 0, None))
    if np.any(scale == 0):
        raise ValueError("a predictor is constant or empty")
    scaled = a / np.outer(scale, scale)
    rank = np.linalg.matrix_rank(scaled, tol=1e-11)
    if rank < len(a):
        raise ValueError(f"predictors are collinear: rank {rank} of {len(a)}")
    b2 = b / (scale if b.ndim == 1 else scale[:, None])
    x = np.linalg.solve(scaled, b2)
    return x / (scale if b.ndim == 1 else scale[:, None])

"""Least squares with robust errors and diagnostics, median regression, group fits."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallygrid.functions.distributions import Z975, chi2_tail, f_tail, normal_two_sided
from tallygrid.functions.scalars import ratio
from tallygrid.operators.frames import double_array
from tallygrid.operators.gram import Moments, complete_rows, linear, moments, quadratic_form, solve
from tallygrid.operators.ordered import attach_scalars, exact_quantiles
from tallygrid.operators.topk import n_largest


@dataclass(frozen=True)
class Fit:
    """Ordinary least squares from moments: y on a constant and ``xs``."""

    y: str
    xs: tuple[str, ...]
    n: int
    intercept: float
    coefs: np.ndarray
    mean: np.ndarray
    inverse: np.ndarray
    rss: float
    tss: float

    @property
    def p(self) -> int:
        return len(self.xs) + 1

    @property
    def df_resid(self) -> int:
        return self.n - self.p

    def predicted(self) -> Column:
        return linear(self.xs, self.coefs, self.intercept)

    def residual(self) -> Column:
        return F.col(self.y).cast("double") - self.predicted()

    def leverage(self) -> Column:
        return F.lit(1.0 / self.n) + quadratic_form(self.xs, self.mean, self.inverse)


def fit_from_moments(m: Moments, y: str, xs: Sequence[str]) -> Fit:
    xs = tuple(xs)
    m = m.pick([*xs, y])
    k = len(xs)
    if m.n <= k + 1:
        raise ValueError(f"{m.n} complete rows are too few for {k + 1} coefficients")
    sxx, sxy, syy = m.cross[:k, :k], m.cross[:k, k], m.cross[k, k]
    inverse = solve(sxx, np.eye(k))
    coefs = inverse @ sxy
    rss = max(float(syy - coefs @ sxy), 0.0)
    return Fit(y, xs, m.n, float(m.mean[k] - coefs @ m.mean[:k]), coefs, m.mean[:k], inverse, rss, float(syy))


def fit_ols(df: DataFrame, y: str, xs: Sequence[str]) -> Fit:
    return fit_from_moments(moments(df, [*xs, y]), y, xs)


def with_fit(df: DataFrame, fit: Fit, fitted: str = "fitted", resid: str = "resid") -> DataFrame:
    """Complete rows with prediction and residual: narrow, the coefficients are literals."""
    return complete_rows(df, [*fit.xs, fit.y]).withColumns({fitted: fit.predicted(), resid: fit.residual()})


def ols_hc3(df: DataFrame, y: str, xs: Sequence[str]) -> DataFrame:
    """One row per term with HC3 standard error, 95 % interval and p, and the fit's summary.

    Two aggregate passes: moments, then the centred sandwich Σ x x' e²/(1−h)².
    Robust inference uses the normal distribution and a χ²/F Wald test of all slopes.
    """
    xs = list(xs)
    fit = fit_ols(df, y, xs)
    k, n = len(xs), fit.n
    z = [F.lit(1.0)] + [F.col(c).cast("double") - F.lit(float(m)) for c, m in zip(xs, fit.mean)]
    e = fit.residual()
    w = e * e / ((1 - fit.leverage()) * (1 - fit.leverage()))
    weighted = complete_rows(df, [*xs, y]).withColumn("__w", w)
    aggs = [F.sum(F.col("__w") * z[i] * z[j]).alias(f"s{i}_{j}") for i in range(k + 1) for j in range(i, k + 1)]
    row = weighted.agg(*aggs).first()
    meat = np.zeros((k + 1, k + 1))
    for i in range(k + 1):
        for j in range(i, k + 1):
            meat[i, j] = meat[j, i] = row[f"s{i}_{j}"]
    bread = np.zeros((k + 1, k + 1))
    bread[0, 0], bread[1:, 1:] = 1.0 / n, fit.inverse
    cov_c = bread @ meat @ bread
    # Back from centred to plain predictors: the intercept moves by −mean·slopes.
    shift = np.eye(k + 1)
    shift[0, 1:] = -fit.mean
    cov = shift @ cov_c @ shift.T
    slopes_cov = cov[1:, 1:]
    wald = float(fit.coefs @ solve(slopes_cov, fit.coefs)) / k
    r2 = 1 - fit.rss / fit.tss if fit.tss > 0 else math.nan
    adj = 1 - (1 - r2) * (n - 1) / fit.df_resid
    rows = []
    for i, term in enumerate(["const", *xs]):
        coef = fit.intercept if i == 0 else float(fit.coefs[i - 1])
        se = math.sqrt(max(cov[i, i], 0.0))
        t = coef / se if se > 0 else math.nan
        rows.append((term, coef, se, coef - Z975 * se, coef + Z975 * se, normal_two_sided(t), r2, adj, f_tail(wald, k, fit.df_resid), n))
    schema = "term string, coef double, se double, ci_low double, ci_high double, p double, r2 double, r2_adj double, f_p double, n bigint"
    return df.sparkSession.createDataFrame(rows, schema)


def standardized_beta(df: DataFrame, y: str, xs: Sequence[str]) -> DataFrame:
    """Slopes in population standard deviations of y per one of x."""
    m = moments(df, [*xs, y])
    fit = fit_from_moments(m, y, xs)
    sd = np.sqrt(np.diag(m.cross) / m.n)
    rows = [(x, float(b), float(b * sd[i] / sd[-1])) for i, (x, b) in enumerate(zip(xs, fit.coefs))]
    return df.sparkSession.createDataFrame(rows, "term string, coef double, beta double")


def breusch_pagan(df: DataFrame, y: str, xs: Sequence[str]) -> DataFrame:
    """LM statistic n·R² of the squared residuals on the predictors, and the F form."""
    fit = fit_ols(df, y, xs)
    squared = with_fit(df, fit).withColumn("__e2", F.col("resid") * F.col("resid"))
    aux = fit_ols(squared, "__e2", xs)
    r2 = 1 - aux.rss / aux.tss
    k = len(xs)
    f = (r2 / k) / ((1 - r2) / aux.df_resid)
    row = (float(aux.n * r2), chi2_tail(aux.n * r2, k), float(f), f_tail(f, k, aux.df_resid))
    return df.sparkSession.createDataFrame([row], "lm double, lm_p double, f double, f_p double")


def reset_test(df: DataFrame, y: str, xs: Sequence[str], power: int = 3) -> DataFrame:
    """F-test of the added powers 2…power of the fitted value; NULL below 5 residual degrees."""
    fit = fit_ols(df, y, xs)
    schema = "f double, df1 int, df2 int, p double"
    if fit.df_resid < 5:
        return df.sparkSession.createDataFrame([(None, power - 1, None, None)], schema)
    # Standardizing the fitted value spans the same columns with stable powers.
    base = with_fit(df, fit)
    spread = math.sqrt((fit.tss - fit.rss) / fit.n) or 1.0
    centre = float(fit.intercept + fit.coefs @ fit.mean)
    z = (F.col("fitted") - F.lit(centre)) / F.lit(spread)
    powers = {f"__z{i}": F.pow(z, F.lit(float(i))) for i in range(2, power + 1)}
    full = fit_ols(base.withColumns(powers), y, [*xs, *powers])
    q = power - 1
    f = ((fit.rss - full.rss) / q) / (full.rss / full.df_resid)
    row = (float(f), q, full.df_resid, f_tail(f, q, full.df_resid))
    return df.sparkSession.createDataFrame([row], schema)


def jarque_bera(df: DataFrame, col: str) -> DataFrame:
    """n/6·(skewness² + excess kurtosis²/4) with its χ² tail; one pass."""
    row = complete_rows(df, [col])
    stats = row.agg(F.count(F.lit(1)).alias("n"), F.skewness(col).alias("skewness"), F.kurtosis(col).alias("kurtosis"))
    jb = F.col("n") / 6.0 * (F.col("skewness") * F.col("skewness") + F.col("kurtosis") * F.col("kurtosis") / 4.0)
    return stats.select(F.col("n").cast("bigint").alias("n"), "skewness", "kurtosis", jb.alias("jb"), F.exp(-jb / 2).alias("p"))


def jarque_bera_residuals(df: DataFrame, y: str, xs: Sequence[str]) -> DataFrame:
    fit = fit_ols(df, y, xs)
    return jarque_bera(with_fit(df, fit), "resid")


def variance_inflation(df: DataFrame, xs: Sequence[str]) -> DataFrame:
    """Inflation per predictor; auxiliary regressions have no constant, so R² is uncentred."""
    if len(xs) < 2:
        raise ValueError("needs at least two predictors")
    raw = moments(df, xs).raw()
    inverse = solve(raw, np.eye(len(xs)))
    rows = [(x, float(raw[i, i] * inverse[i, i])) for i, x in enumerate(xs)]
    return df.sparkSession.createDataFrame(rows, "term string, vif double")


def influence(df: DataFrame, y: str, xs: Sequence[str]) -> DataFrame:
    """Rows with leverage, external studentized residual, Cook's D and threshold flags. No shuffle."""
    fit = fit_ols(df, y, xs)
    p, dof = fit.p, fit.df_resid
    out = with_fit(df, fit).withColumn("leverage", fit.leverage())
    e, h = F.col("resid"), F.col("leverage")
    s2 = F.lit(fit.rss / dof)
    rest = (F.lit(fit.rss) - e * e / (1 - h)) / F.lit(float(dof - 1))
    return out.withColumns(
        {
            "student": e / F.sqrt(F.nullif(rest * (1 - h), F.lit(0.0))),
            "cooks_d": e * e * h / (F.nullif(s2, F.lit(0.0)) * p * (1 - h) * (1 - h)),
        }
    ).withColumns(
        {
            "high_leverage": h > F.lit(2.0 * p / fit.n),
            "large_residual": F.abs("student") > 2,
        }
    )


def most_influential(df: DataFrame, y: str, xs: Sequence[str], row_id: str, k: int = 3) -> DataFrame:
    return n_largest(influence(df, y, xs), "cooks_d", k, row_id)


def _weighted_passes(
    data: DataFrame, xs: Sequence[str], tried: Sequence[np.ndarray], tau: float
) -> list[tuple[float, np.ndarray, np.ndarray]]:
    """Check loss and reweighted normal equations at each candidate, in one aggregate."""
    p = len(xs) + 1
    z = ["1", *xs]
    work = data.withColumn("b", double_array(np.concatenate(tried)))
    resid = [f"__y - ({' + '.join(f'b[__at + {c * p + i}] * {z[i]}' for i in range(p))}) AS r{c}" for c in range(len(tried))]
    work = work.selectExpr("__y", *xs, *resid)
    tilt = [f"(CASE WHEN r{c} < 0 THEN {1 - tau}D ELSE {tau}D END)" for c in range(len(tried))]
    weights = [f"{tilt[c]} / greatest(abs(r{c}), 1e-6D) AS w{c}" for c in range(len(tried))]
    work = work.selectExpr("*", *weights)
    aggs = []
    for c in range(len(tried)):
        aggs.append(f"sum({tilt[c]} * abs(r{c}))")
        aggs += [f"sum(w{c} * {z[i]} * {z[j]})" for i in range(p) for j in range(i, p)]
        aggs += [f"sum(w{c} * {z[i]} * __y)" for i in range(p)]
    row = iter(work.selectExpr(*[f"{e} AS s{n}" for n, e in enumerate(aggs)]).first())
    out = []
    for _ in tried:
        loss, a = next(row), np.zeros((p, p))
        for i in range(p):
            for j in range(i, p):
                a[i, j] = a[j, i] = next(row)
        out.append((loss, a, np.array([next(row) for _ in range(p)])))
    return out


#: Rows nearest to the line that the driver takes for the exact solution, at most (distinct ones, beyond ties).
BAND_ROWS = 20_000
MAX_BANDS = 12


def _band(data: DataFrame, names: Sequence[str], beta: np.ndarray, tau: float, n: int):
    """Distinct rows near the line with their numbers, and the sum of τ-weighted rows beyond; the width of the band."""
    line = sum((F.col(c) * F.lit(float(b)) for c, b in zip(names, beta[1:])), F.lit(float(beta[0])))
    placed = data.select(*names, "__y", (F.col("__y") - line).alias("__r"))
    width = math.inf
    if n > BAND_ROWS:
        width = exact_quantiles(placed.select(F.abs("__r").alias("r")), ["r"], [BAND_ROWS / n]).first()[0][0]
    near = placed.where(F.abs("__r") <= width).groupBy(*names, "__y").agg(F.count(F.lit(1)).alias("w")).limit(4 * BAND_ROWS + 1).collect()
    pull = F.when(F.col("__r") > 0, F.lit(tau)).otherwise(F.lit(tau - 1))
    beyond = placed.where(F.abs("__r") > width)
    far = beyond.agg(*[F.coalesce(F.sum(pull * c), F.lit(0.0)) for c in (F.lit(1.0), *(F.col(c) for c in names))]).first()
    rows = np.array([[1.0, *r[:-1]] for r in near], float)
    return rows[:, :-1], rows[:, -1], np.array([r[-1] for r in near], float), np.array(far, float), beyond


def _vertex(x: np.ndarray, y: np.ndarray, w: np.ndarray, far: np.ndarray, start: np.ndarray, tau: float) -> tuple[np.ndarray, bool]:
    """Exact minimum of the weighted τ-loss of the rows plus the linear term ``far``, by descent from vertex to vertex.

    True if the dual certificate holds: multipliers of the rows on the line between w(τ-1) and wτ balance all other rows.
    """
    m, k = x.shape
    basis: list[int] = []
    for i in np.argsort(np.abs(y - x @ start), kind="stable"):
        if np.linalg.matrix_rank(x[[*basis, i]], tol=1e-9) > len(basis):
            basis.append(int(i))
            if len(basis) == k:
                break
    if len(basis) < k:
        return start, False
    beta = start
    for _ in range(200 + 20 * k + m):
        beta = np.linalg.solve(x[basis], y[basis])
        r = y - x @ beta
        r[np.abs(r) < 1e-13 * (1 + np.abs(y))] = 0.0
        pull = w * np.where(r >= 0, tau, tau - 1)
        pull[basis] = 0
        s = -np.linalg.solve(x[basis].T, far + x.T @ pull)
        over = np.maximum(s - w[basis] * tau, w[basis] * (tau - 1) - s)
        j = int(np.argmax(over))
        if over[j] <= 1e-9 * max(1.0, w.sum() * 1e-6):
            return beta, True
        sign = -1.0 if s[j] > w[basis][j] * tau else 1.0
        unit = np.zeros(k)
        unit[j] = sign
        along = x @ np.linalg.solve(x[basis], unit)
        along[basis] = 0
        hit = np.flatnonzero(((r >= 0) & (along > 1e-12)) | ((r < 0) & (along < -1e-12)))
        order = hit[np.argsort(r[hit] / along[hit], kind="stable")]
        slope = -over[j] + np.cumsum(w[order] * np.abs(along[order]))
        at = int(np.searchsorted(slope, 0.0))
        if at == len(order):
            return beta, False
        basis[j] = int(order[at])
    return beta, False


def _exact_line(data: DataFrame, names: Sequence[str], beta: np.ndarray, tau: float, n: int) -> tuple[np.ndarray, bool]:
    """The exact τ-line near ``beta``: rows far from it count by their side only, which is verified on all of them afterwards."""
    for _ in range(MAX_BANDS):
        x, y, w, far, beyond = _band(data, names, beta, tau, n)
        if len(y) > 4 * BAND_ROWS:
            return beta, False
        new, optimal = _vertex(x, y, w, far, beta, tau)
        line = sum((F.col(c) * F.lit(float(b)) for c, b in zip(names, new[1:])), F.lit(float(new[0])))
        moved = n > BAND_ROWS and not beyond.where((F.col("__y") - line > 0) != (F.col("__r") > 0)).isEmpty()
        beta = new
        if not moved:
            return beta, optimal
    return beta, False


def quantile_regression(
    df: DataFrame, y: str, xs: Sequence[str], tau: float = 0.5, tol: float = 1e-6, max_iter: int = 500
) -> DataFrame:
    """Coefficients of the τ-quantile line: reweighted least squares to come near, then the exact optimum.

    The exact part takes the rows nearest to the line to the driver, a bounded number, and all others as two sums by their side of it.
    ``converged`` says that the sides held for every row and that the dual certificate of the optimum did; otherwise the line is only near it.
    The needed columns are centred, scaled and kept in the cluster's memory or disk
    for the iterations. Each pass scores the plain update and a few longer steps in
    its direction at once and goes on from the best, which saves most of the passes.
    """
    xs = list(xs)
    m = moments(df, [*xs, y])
    fit = fit_from_moments(m, y, xs)
    sd = np.sqrt(np.diag(m.cross) / m.n)
    sd[sd == 0] = 1.0
    names = [f"__x{i}" for i in range(len(xs))] + ["__y"]
    scaled = [
        ((F.col(c).cast("double") - F.lit(float(mu))) / F.lit(float(s))).alias(a)
        for a, c, mu, s in zip(names, [*xs, y], m.mean, sd)
    ]
    k = len(xs)
    # Coefficients are read from an array at a stored position: they stay out of the
    # generated code, which is then compiled once instead of once per iteration.
    data = complete_rows(df, [*xs, y]).select(*scaled, (F.col(y) * 0).cast("int").alias("__at"))
    data = data.persist(StorageLevel.MEMORY_AND_DISK)
    beta = np.concatenate([[0.0], fit.coefs * sd[:k] / sd[k]])
    step = np.zeros(k + 1)
    iterations = 0
    try:
        for iterations in range(1, max_iter + 1):
            stretches = (1.0,) if iterations == 1 else (1.0, 2.0, 4.0, 10.0, 30.0)
            tried = [beta + s * step for s in stretches]
            passes = _weighted_passes(data, names[:k], tried, tau)
            best = min(range(len(tried)), key=lambda c: (passes[c][0], c))
            _, a, b = passes[best]
            beta = tried[best]
            new = solve(a, b)
            step = new - beta
            if float(np.max(np.abs(step))) < tol:
                beta = new
                break
        beta, converged = _exact_line(data, names[:k], beta, tau, m.n)
    finally:
        data.unpersist()
    slopes = beta[1:] * sd[k] / sd[:k]
    const = float(m.mean[k] + sd[k] * beta[0] - slopes @ m.mean[:k])
    rows = [(t, float(c), tau, m.n, iterations, converged) for t, c in zip(["const", *xs], [const, *slopes])]
    return df.sparkSession.createDataFrame(rows, "term string, coef double, tau double, n bigint, iterations int, converged boolean")


def _both(x: str, y: str) -> tuple[Column, Column]:
    ok = F.col(x).isNotNull() & F.col(y).isNotNull()
    return F.when(ok, F.col(x).cast("double")), F.when(ok, F.col(y).cast("double"))


def line_aggregates(x: str, y: str) -> list[Column]:
    """Slope, intercept and R² of y on x as built-in aggregates."""
    a, b = _both(x, y)
    return [
        F.regr_count(b, a).cast("bigint").alias("n"),
        F.regr_slope(b, a).alias("slope"),
        F.regr_intercept(b, a).alias("intercept"),
        F.regr_r2(b, a).alias("r2"),
    ]


def group_ols(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    return df.groupBy(*keys).agg(*line_aggregates(x, y))


def smearing_fit(df: DataFrame, x: str, y: str) -> DataFrame:
    """Line through ln y and Duan's factor: prediction exp(b0 + b1·x)·factor."""
    logs = df.filter(F.col(y) > 0).select(F.col(x).cast("double").alias("x"), F.log(F.col(y)).alias("ly")).dropna()
    line = logs.agg(*line_aggregates("x", "ly"))
    d = attach_scalars(logs, line, "f")
    factor = d.agg(
        F.avg(F.exp(F.col("ly") - F.col("f.intercept") - F.col("f.slope") * F.col("x"))).alias("smearing")
    )
    out = attach_scalars(line, factor, "s")
    return out.select("n", "slope", "intercept", "r2", F.col("s.smearing").alias("smearing"))


def predict_smeared(df: DataFrame, fit: DataFrame, x: str, out: str = "y_hat") -> DataFrame:
    d = attach_scalars(df, fit, "__f")
    return d.withColumn(out, F.exp(F.col("__f.intercept") + F.col("__f.slope") * F.col(x)) * F.col("__f.smearing")).drop("__f")


def quartile_fits(df: DataFrame, x: str, y: str) -> DataFrame:
    """Lines within the lower (≤ q25) and upper (≥ q75) quarter of x, with the shared axis limits."""
    both = df.dropna(subset=[x, y])
    facts = exact_quantiles(
        both, [x], [0.25, 0.75],
        extra=[F.min(x).alias("x_min"), F.max(x).alias("x_max"), F.min(y).alias("y_min"), F.max(y).alias("y_max")],
    )
    d = attach_scalars(both, facts, "f")
    q = F.col(f"f.q_{x}")
    sides = F.filter(
        F.array(F.when(F.col(x) <= q[0], F.lit("Q1")), F.when(F.col(x) >= q[1], F.lit("Q4"))), lambda s: s.isNotNull()
    )
    fits = d.withColumn("group", F.explode(sides)).groupBy("group").agg(*line_aggregates(x, y))
    out = attach_scalars(fits, facts, "f")
    return out.select("group", "n", "slope", "intercept", "r2", *[F.col(f"f.{c}").alias(c) for c in ("x_min", "x_max", "y_min", "y_max")])

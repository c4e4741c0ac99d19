import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallygrid.functions import distributions as dist
from tallygrid.functions import geo
from tallygrid.operators import correlation, gram, linalg, panel, regression, resampling, smoothing


@pytest.fixture(scope="module")
def sample():
    rng = np.random.default_rng(5)
    x = rng.normal(10, 3, 200)
    z = 0.5 * x + rng.normal(0, 2, 200)
    y = 2 + 0.7 * x - 0.3 * z + rng.normal(0, 1, 200) * (0.5 + np.abs(x - 10) / 3)
    return x, z, y


@pytest.fixture(scope="module")
def table(spark, sample):
    x, z, y = sample
    return spark.createDataFrame([(i, float(a), float(b), float(c)) for i, (a, b, c) in enumerate(zip(x, z, y))] + [(900, None, 1.0, 1.0), (901, 1.0, 1.0, float("nan"))], "id int, x double, z double, y double").cache()


def _ols(X, y):
    X = np.column_stack([np.ones(len(y)), X])
    inv = np.linalg.inv(X.T @ X)
    b = inv @ X.T @ y
    e = y - X @ b
    h = np.einsum("ij,jk,ik->i", X, inv, X)
    return X, inv, b, e, h


def test_tails():
    assert dist.t_two_sided(2.0, 10) == pytest.approx(0.07338803, abs=1e-7)
    assert dist.f_tail(3.0, 2, 20) == pytest.approx(0.07253815028640571, abs=1e-9)
    assert dist.chi2_tail(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-9)
    assert dist.chi2_tail(5.0, 2) == pytest.approx(math.exp(-2.5))
    assert dist.t_quantile(0.975, 10) == pytest.approx(2.2281388520, abs=1e-8)
    assert dist.normal_two_sided(dist.Z975) == pytest.approx(0.05)


def test_densities(spark):
    df = spark.createDataFrame([(0,), (3,), (11,), (-1,)], "k int")
    k = F.col("k")
    rows = df.select(dist.binom_pmf(k, 10, 0.3), dist.poisson_pmf(k, 2.5), dist.normal_pdf(k.cast("double")), dist.normal_cdf(k.cast("double"))).collect()
    assert rows[0][0] == pytest.approx(0.7**10)
    assert rows[1][0] == pytest.approx(math.comb(10, 3) * 0.3**3 * 0.7**7)
    assert (rows[2][0], rows[3][0], rows[3][1]) == (0.0, 0.0, 0.0)
    assert rows[1][1] == pytest.approx(math.exp(-2.5) * 2.5**3 / 6)
    assert rows[0][2] == pytest.approx(1 / math.sqrt(2 * math.pi))
    assert rows[0][3] == 0.5 and rows[3][3] == pytest.approx(0.15865525393)


def test_pearson(table, sample, spark):
    x, _, y = sample
    r = correlation.pearson_ci(table, "x", "y").first()
    want = np.corrcoef(x, y)[0, 1]
    assert r["n"] == 200 and r["r"] == pytest.approx(want)
    half = dist.Z975 / math.sqrt(197)
    assert r["ci_low"] == pytest.approx(math.tanh(math.atanh(want) - half))
    flat = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "x double, y double")
    assert correlation.pearson_ci(flat, "x", "y").first()["r"] is None


def test_spearman(table, sample, plans):
    x, _, y = sample
    rank = lambda v: np.argsort(np.argsort(v))
    r = correlation.spearman(table, "x", "y").first()
    assert r["rho"] == pytest.approx(np.corrcoef(rank(x), rank(y))[0, 1])
    assert 0 <= r["p"] <= 1


def test_partial_corr(table, sample):
    x, z, y = sample
    ex, ey = _ols(z, x)[3], _ols(z, y)[3]
    assert correlation.partial_corr(table, "y", "x", ["z"]).first()["r"] == pytest.approx(np.corrcoef(ex, ey)[0, 1])


def test_permutation(spark):
    rng = random.Random(1)
    rows = [(i, float(i), i + rng.gauss(0, 3)) for i in range(30)]
    df = spark.createDataFrame(rows, "id int, x double, y double")
    strong = correlation.permutation_corr_test(df, "x", "y", "id", B=199).first()
    assert strong["p"] == pytest.approx(1 / 200)
    noise = spark.createDataFrame([(i, float(i), rng.gauss(0, 1)) for i in range(30)], "id int, x double, y double")
    a = correlation.permutation_corr_test(noise, "x", "y", "id", B=400).first()["p"]
    r = abs(float(np.corrcoef([x["x"] for x in noise.collect()], [x["y"] for x in noise.collect()])[0, 1]))
    t = r * math.sqrt(28 / (1 - r * r))
    assert abs(a - dist.t_two_sided(t, 28)) < 0.08


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 97, 1000])
def test_permuted_is_a_bijection(spark, n):
    copies = spark.range(n).select(F.col("id").alias("pos"), F.explode(F.sequence(F.lit(0), F.lit(59))).alias("b"))
    rows = correlation.permuted(copies, "pos", "b", n, 123, "at").collect()
    at = np.zeros((60, n), int)
    for r in rows:
        at[r["b"], r["pos"]] = r["at"]
    assert (np.sort(at, 1) == np.arange(n)).all()
    if n >= 97:
        assert len({tuple(row) for row in at}) == 60
        # Places are as good as independent: correlations with the old place, and pairs that stay neighbours, are as chance has them.
        assert max(abs(np.corrcoef(row, np.arange(n))[0, 1]) for row in at) < 4.5 / math.sqrt(n)
        assert np.mean(np.abs(np.diff(at, axis=1)) == 1) < 3 / n + 0.01 and np.mean(at == np.arange(n)) < 2.5 / n


def test_permutation_pairs_every_row(spark, plans, monkeypatch):
    monkeypatch.setattr(correlation, "PAIRED_ROWS", 100)
    df = spark.createDataFrame([(i, float(i), float(i)) for i in range(12)], "id int, x double, y double")
    out = correlation.permutation_corr_test(df, "x", "y", "id", B=40).first()
    assert out["p"] == pytest.approx(1 / 41)


@pytest.mark.parametrize("n, tile, piece", [(2, 1, 1), (12, 100, 100), (90, 20, 10), (97, 1, 1), (1000, 300, 64), (1000, 5000, 64)])
def test_permuted_sums_by_tiles(spark, n, tile, piece):
    """The tables of rounds and the tiles give the sums of the places that are computed column by column."""
    rng = np.random.default_rng(n)
    x, y = rng.normal(size=n), rng.normal(size=n)
    placed = spark.createDataFrame([(i, float(x[i]), float(y[i])) for i in range(n)], "pos long, x double, y double")
    got = {r["b"]: r["s"] for r in correlation.permuted_sums(placed, n, 40, 123, tile, piece).collect()}
    copies = spark.range(n).select(F.col("id").alias("pos"), F.explode(F.sequence(F.lit(0), F.lit(39))).alias("b"))
    want = np.zeros(40)
    for r in correlation.permuted(copies, "pos", "b", n, 123, "at").collect():
        want[r["b"]] += x[r["pos"]] * y[r["at"]]
    assert sorted(got) == list(range(40))
    assert [got[b] for b in range(40)] == pytest.approx(want, abs=1e-9)


def test_ols_hc3(table, sample):
    x, z, y = sample
    X, inv, b, e, h = _ols(np.column_stack([x, z]), y)
    cov = inv @ (X.T * (e / (1 - h)) ** 2) @ X @ inv
    out = {r["term"]: r for r in regression.ols_hc3(table, "y", ["x", "z"]).collect()}
    for i, t in enumerate(["const", "x", "z"]):
        assert out[t]["coef"] == pytest.approx(b[i])
        assert out[t]["se"] == pytest.approx(math.sqrt(cov[i, i]))
    r2 = 1 - e @ e / ((y - y.mean()) ** 2).sum()
    assert out["x"]["r2_adj"] == pytest.approx(1 - (1 - r2) * 199 / 197)


def test_residuals_orthogonal(table):
    fit = regression.fit_ols(table, "y", ["x", "z"])
    r = regression.with_fit(table, fit).agg(F.sum("resid"), F.sum(F.col("resid") * F.col("x"))).first()
    assert r[0] == pytest.approx(0, abs=1e-8) and r[1] == pytest.approx(0, abs=1e-7)


def test_influence(table, sample):
    x, z, y = sample
    X, inv, b, e, h = _ols(np.column_stack([x, z]), y)
    n, p = X.shape
    s2 = e @ e / (n - p)
    cooks = e**2 * h / (p * s2 * (1 - h) ** 2)
    ext = e / np.sqrt((e @ e - e**2 / (1 - h)) / (n - p - 1) * (1 - h))
    rows = {r["id"]: r for r in regression.influence(table, "y", ["x", "z"]).collect()}
    for i in (0, 17, 99, 199):
        assert rows[i]["leverage"] == pytest.approx(h[i])
        assert rows[i]["cooks_d"] == pytest.approx(cooks[i])
        assert rows[i]["student"] == pytest.approx(ext[i])
    top = [r["id"] for r in regression.most_influential(table, "y", ["x", "z"], "id").collect()]
    assert top == list(np.argsort(-cooks)[:3])


def test_reset_and_breusch_pagan(table, sample):
    x, _, y = sample
    e = _ols(x, y)[3]
    e2 = _ols(np.column_stack([x, x**2, x**3]), y)[3]  # spans the same columns as the fitted powers
    f = ((e @ e - e2 @ e2) / 2) / (e2 @ e2 / (200 - 4))
    out = regression.reset_test(table, "y", ["x"]).first()
    assert out["f"] == pytest.approx(f, rel=1e-6)
    assert out["p"] == pytest.approx(dist.f_tail(f, 2, 196), rel=1e-6)
    aux = _ols(x, e**2)[3]
    lm = 200 * (1 - aux @ aux / (((e**2) - (e**2).mean()) ** 2).sum())
    assert regression.breusch_pagan(table, "y", ["x"]).first()["lm"] == pytest.approx(lm)


def test_reset_small(spark):
    df = spark.createDataFrame([(float(i), float(i % 3)) for i in range(6)], "x double, y double")
    assert regression.reset_test(df, "y", ["x"]).first()["p"] is None


def test_collinear(spark):
    df = spark.createDataFrame([(float(i), 2.0 * i, float(i % 4)) for i in range(20)], "a double, b double, y double")
    with pytest.raises(ValueError, match="collinear"):
        regression.fit_ols(df, "y", ["a", "b"])


def test_large_means_keep_digits(spark):
    df = spark.createDataFrame([(1e9 + i, 3.0 * i + 5) for i in range(50)], "x double, y double")
    assert regression.fit_ols(df, "y", ["x"]).coefs[0] == pytest.approx(3.0, rel=1e-6)
    assert gram.moments(df, ["x"]).cross[0, 0] == pytest.approx(np.var(np.arange(50)) * 50)


def test_median_regression(spark):
    rows = [(i, float(i), 3.0 + 2.0 * i + (1000.0 if i % 10 == 0 else 0.0)) for i in range(1, 60)]
    df = spark.createDataFrame(rows, "id int, x double, y double")
    out = {r["term"]: r["coef"] for r in regression.quantile_regression(df, "y", ["x"]).collect()}
    assert out["x"] == pytest.approx(2.0, abs=1e-2) and out["const"] == pytest.approx(3.0, abs=0.3)


@pytest.mark.parametrize("tau,band", [(0.5, 20_000), (0.5, 40), (0.2, 40)])
def test_quantile_regression_is_exact(spark, monkeypatch, tau, band):
    """The best line through two points, also where most rows count by their side only."""
    monkeypatch.setattr(regression, "BAND_ROWS", band)
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(0, 2, 150), 1)
    y = 3 + 0.7 * x + rng.standard_cauchy(150) + (x > 2) * 5
    x, y = np.append(x, x[:30]), np.append(y, y[:30])
    got = regression.quantile_regression(spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double"), "y", ["x"], tau).collect()
    loss = lambda a, b: np.sum(np.where(y > a + b * x, tau, tau - 1) * (y - a - b * x))
    pairs = [(i, j) for i in range(150) for j in range(i) if x[i] != x[j]]
    best = min(loss(y[i] - b * x[i], b) for i, j in pairs for b in [(y[i] - y[j]) / (x[i] - x[j])])
    const, slope = (r["coef"] for r in got)
    assert all(r["converged"] for r in got) and loss(const, slope) == pytest.approx(best, rel=1e-10)


def test_quantile_regression_splits_rows(table):
    for tau in (0.25, 0.8):
        out = {r["term"]: r["coef"] for r in regression.quantile_regression(table, "y", ["x"], tau).collect()}
        below = gram.complete_rows(table, ["x", "y"]).filter(F.col("y") < out["const"] + out["x"] * F.col("x")).count()
        assert below / 200 == pytest.approx(tau, abs=0.02)


def _panel_rows():
    rng = np.random.default_rng(11)
    rows = []
    for e in range(12):
        for t in range(2000, 2008):
            if (e * 7 + t) % 9 == 0:
                continue
            x = rng.normal() + e * 0.2
            rows.append((f"e{e}", t, float(x), float(1.5 * x + e + 0.1 * t + rng.normal(0, 0.3))))
    return rows


def test_panel_unbalanced_matches_dummies(spark):
    rows = _panel_rows()
    df = spark.createDataFrame(rows, "e string, t int, x double, y double")
    names, years = sorted({r[0] for r in rows}), sorted({r[1] for r in rows})
    D = np.zeros((len(rows), len(names) + len(years) - 1))
    for i, r in enumerate(rows):
        D[i, names.index(r[0])] = 1
        if years.index(r[1]):
            D[i, len(names) + years.index(r[1]) - 1] = 1
    x, y = np.array([r[2] for r in rows]), np.array([r[3] for r in rows])
    res = lambda v: v - D @ np.linalg.lstsq(D, v, rcond=None)[0]
    xr, yr = res(x), res(y)
    beta = xr @ yr / (xr @ xr)
    e = yr - beta * xr
    meat = sum((xr[k] @ e[k]) ** 2 for k in ([i for i, r in enumerate(rows) if r[0] == n] for n in names))
    out = panel.panel_fe(df, "y", "x", "e", "t").first()
    assert out["beta"] == pytest.approx(beta)
    assert out["se"] == pytest.approx(math.sqrt(meat) / (xr @ xr))
    assert (out["n"], out["n_entities"], out["n_periods"]) == (len(rows), 12, 8)
    fe = {r["e"]: r for r in panel.fixed_effects(df, "y", "x", "e", "t", ["e3"]).collect()}
    full = np.linalg.lstsq(np.column_stack([x, D]), y, rcond=None)[0]
    alpha, lam = full[1 : 1 + len(names)], np.concatenate([[0], full[1 + len(names) :]])
    for i, n in enumerate(names):
        assert fe[n]["effect"] == pytest.approx(alpha[i] + lam.mean())
    assert fe["e3"]["highlight"] and not fe["e4"]["highlight"]


def _within(values, groups, rounds=4000):
    """Residuals after group means have been taken out in turn until nothing changes."""
    out = np.array(values, float)
    for _ in range(rounds):
        last = out
        for g in groups:
            out = out - (np.bincount(g, out) / np.bincount(g))[g]
        if np.abs(out - last).max() < 1e-14:
            break
    return out


@pytest.mark.parametrize("blocks", [1, 2])
def test_panel_with_thousands_of_periods(spark, blocks):
    """Daily, unbalanced, with a hot entity; two blocks share no period."""
    rng = np.random.default_rng(blocks)
    cells = [(e, t + 3000 * (e % blocks)) for e in range(8) for t in range(3000) if e == 0 or rng.random() < 0.3]
    e, t = (np.array(c) for c in zip(*cells))
    x = rng.normal(0, 1, len(e)) + 0.3 * e + np.sin(t / 50)
    y = 2.5 * x + e - np.cos(t / 40) + rng.normal(0, 1, len(e))
    df = spark.createDataFrame([(f"e{a}", int(b), float(c), float(d)) for a, b, c, d in zip(e, t, x, y)], "e string, t int, x double, y double")
    got = panel.panel_fe(df, "y", "x", "e", "t").first()
    _, day = np.unique(t, return_inverse=True)
    wx, wy = _within(x, [e, day]), _within(y, [e, day])
    beta = wx @ wy / (wx @ wx)
    se = math.sqrt((np.bincount(e, wx * (wy - beta * wx)) ** 2).sum()) / (wx @ wx)
    assert got["beta"] == pytest.approx(beta, rel=1e-9) and got["se"] == pytest.approx(se, rel=1e-7)
    assert got["n_periods"] == len(set(t)) and got["n"] == len(e)
    assert got["p"] == pytest.approx(dist.t_two_sided(beta / se, len(e) - 8 - len(set(t))), rel=1e-6, abs=1e-300)


def test_lowess_reproduces_a_line(spark, plans):
    df = spark.createDataFrame([(float(i), 2.0 * i + 1) for i in range(60)], "x double, y double")
    for r in smoothing.lowess_grid(df, "x", "y", n_grid=7, robust=1).collect():
        assert r["y_hat"] == pytest.approx(2 * r["x"] + 1)


def test_lowess_neighbourhoods(spark, plans):
    rng = np.random.default_rng(8)
    xs = np.round(rng.normal(0, 1, 500), 2)
    rows = spark.createDataFrame([(float(x),) for x in xs], "x double")
    points = [-2.0, -0.5, 0.0, 0.7, 3.0]
    for k in (1, 50, 300, 500):
        want = [float(np.sort(np.abs(xs - g))[k - 1]) for g in points]
        assert smoothing._bandwidths(rows, points, k, 500) == pytest.approx(want)


def test_lowess_resists_outliers(spark):
    df = spark.createDataFrame([(float(i), 2.0 * i + (500.0 if i % 20 == 7 else 0.0)) for i in range(100)], "x double, y double")
    fit = smoothing.lowess_grid(df, "x", "y", n_grid=9, robust=3).collect()
    assert max(abs(r["y_hat"] - 2 * r["x"]) for r in fit) < 1.0


def test_spline(spark):
    xs = np.linspace(8, 18, 200)
    df = spark.createDataFrame([(float(x), float(45 * math.tanh(x / 1.9 - 7) + 57)) for x in xs], "x double, y double")
    rows = smoothing.spline_fit(df, "x", "y", 12, n_grid=50).collect()
    assert rows[0]["df"] == pytest.approx(12, abs=1e-3)
    assert max(abs(r["y_hat"] - (45 * math.tanh(r["x"] / 1.9 - 7) + 57)) for r in rows) < 2.5
    line = spark.createDataFrame([(float(x), float(3 * x - 1)) for x in xs], "x double, y double")
    assert all(r["y_hat"] == pytest.approx(3 * r["x"] - 1, abs=1e-6) for r in smoothing.spline_fit(line, "x", "y", 4).collect())


def test_resampling(spark):
    df = spark.createDataFrame([(i, i % 2, int(i % 2 == 0 if i % 5 == 0 else i % 2)) for i in range(200)], "id int, y int, pred int")
    r = resampling.bootstrap_ci(df, "y", "pred").first()
    assert r["ci_low"] < r["mean"] < r["ci_high"] and r["mean"] == pytest.approx(0.8, abs=0.02)
    with pytest.raises(ValueError):
        resampling.bootstrap_ci(df, "y", "pred", "auc")
    d = spark.createDataFrame([(i, float(i % 10)) for i in range(2000)], "id int, v double")
    est = [x["estimate"] for x in resampling.bootstrap_means(d, "v", "id", 50).collect()]
    assert len(est) == 50 and np.mean(est) == pytest.approx(4.5, abs=0.05)
    assert np.std(est) == pytest.approx(2.872 / math.sqrt(2000), rel=0.4)
    b = resampling.bias_variance(spark.createDataFrame([(1.0, 2.0), (3.0, 2.0), (5.0, 2.0)], "e double, t double"), "e", "t").first()
    assert (b["bias2"], b["variance"]) == (1.0, 4.0)


def test_linalg(spark):
    a = spark.createDataFrame([(0, 0, 1.0), (1, 1, 1.0)], "i int, k int, v double")
    b = spark.createDataFrame([(0, 0, 1.0), (1, 0, 1.0)], "k int, j int, v double")
    assert {tuple(r) for r in linalg.matmul(a, b).collect()} == {(0, 0, 1.0), (1, 0, 1.0)}
    d = spark.createDataFrame([(1.0, 2.0, 0), (3.0, 4.0, 1)], "a double, b double, y int")
    assert {r[0]: r[1] for r in linalg.logistic_gradient(d, ["a", "b"], "y", [0, 0]).collect()} == {"a": -0.5, "b": -0.5}


def test_geodesic_near_antipodes():
    """Known lengths in metres: near-antipodal pairs, and half a meridian between antipodes and from pole to pole."""
    rows = [(0.0, 0.0, 0.5, 179.5, 19936288.579), (0.0, 0.0, 0.5, 179.7, 19944127.421), (0.0, 0.0, 0.0, 180.0, 20003931.458625), (30.0, 10.0, -30.0, -170.0, 20003931.458625), (90.0, 5.0, -90.0, 40.0, 20003931.458625), (0.5, 179.7, 0.0, 0.0, 19944127.421)]
    *points, metres = (np.array(c) for c in zip(*rows))
    assert geo.vincenty_km(*points) * 1000 == pytest.approx(metres, abs=2e-3)


def test_geodesic_across_the_date_line():
    """The shorter way round, whatever the longitudes are written as."""
    one = np.ones(1)
    for lat1, lat2, west, east in ((10, -20, 170, -175), (0, 0, -179, 179), (45, 50, 5, 340)):
        turned = east - 360 if east > west else east + 360
        assert geo.vincenty_km(lat1 * one, west * one, lat2 * one, east * one) == pytest.approx(geo.vincenty_km(lat1 * one, west * one, lat2 * one, turned * one), abs=1e-9)
        assert geo.vincenty_km(lat1 * one, west * one, lat2 * one, east * one) == pytest.approx(geo.bisected_km(lat1 * one, west * one, lat2 * one, east * one), abs=1e-6)


def test_geodesic_ways_agree():
    rng = np.random.default_rng(2)
    points = [rng.uniform(-90, 90, 400), rng.uniform(-180, 180, 400), rng.uniform(-90, 90, 400), rng.uniform(-180, 180, 400)]
    assert geo.bisected_km(*points) == pytest.approx(geo.vincenty_km(*points), abs=1e-6)
    anti = [points[0], points[1], -points[0] + rng.uniform(-0.3, 0.3, 400), points[1] + 180 + rng.uniform(-0.3, 0.3, 400)]
    anti[2] = np.clip(anti[2], -90, 90)
    back = geo.vincenty_km(anti[2], anti[3], anti[0], anti[1])
    assert np.isfinite(back).all() and back == pytest.approx(geo.vincenty_km(*anti), abs=1e-6)


def test_geo(spark):
    rows = [(0, -15.7797, -47.9297, 35.6895, 139.6917), (1, 0.0, 0.0, 0.0, 0.0), (2, 91.0, 0.0, 0.0, 0.0), (3, None, 0.0, 0.0, 0.0), (4, 0.0, 0.0, 0.0, 180.0), (5, 10.0, 20.0, 30.0, 20.0)]
    df = spark.createDataFrame(rows, "id int, a double, b double, c double, d double")
    got = {}
    for m in ("cosine", "haversine", "geodesic"):
        out = geo.add_geo_features(df, "a", "b", "c", "d", m, ("distance_km", "bearing_deg", "delta_lat", "delta_lon"))
        got[m] = {r["id"]: r for r in out.collect()}
    la, lb, dl = math.radians(-15.7797), math.radians(35.6895), math.radians(139.6917 + 47.9297)
    arc = math.acos(math.sin(la) * math.sin(lb) + math.cos(la) * math.cos(lb) * math.cos(dl))
    assert got["cosine"][0]["geo_distance_km"] == pytest.approx(arc * geo.COSINE_RADIUS_KM)
    assert got["cosine"][0]["geo_distance_km"] * geo.HAVERSINE_RADIUS_KM / geo.COSINE_RADIUS_KM == pytest.approx(got["haversine"][0]["geo_distance_km"], abs=1e-3)
    assert got["haversine"][1]["geo_distance_km"] == 0.0 and got["geodesic"][1]["geo_distance_km"] == 0.0
    for m in got:
        assert got[m][2]["geo_distance_km"] is None and got[m][3]["geo_distance_km"] is None
    assert got["geodesic"][5]["geo_distance_km"] == pytest.approx(2214.6, abs=1.5)
    assert got["haversine"][5]["geo_bearing_deg"] == pytest.approx(0.0)
    assert got["haversine"][5]["geo_delta_lat"] == 20.0
    back = geo.add_geo_features(df, "c", "d", "a", "b").filter("id = 0").first()["geo_distance_km"]
    assert back == pytest.approx(got["haversine"][0]["geo_distance_km"])
    with pytest.raises(ValueError, match="cosine"):
        geo.add_geo_features(df, "a", "b", "c", "d", "flat")
    with pytest.raises(Exception, match="out of range"):
        geo.add_geo_features(df, "a", "b", "c", "d", on_invalid="error").collect()
    own = geo.add_geo_features(df, "a", "b", "c", "d", lambda a, b, c, d: F.abs(a - c), ("distance_km",), None)
    assert own.filter("id = 5").first()["distance_km"] == 20.0


def test_vincenty_known_line():
    # Flinders Peak to Buninyong, the classic check of the inverse formula: 54.972271 km on another ellipsoid; WGS-84 within metres.
    km = geo.vincenty_km(*(np.array([v]) for v in (-37.95103341666667, 144.42486788888888, -37.65282113888889, 143.92649552777777)))
    assert km[0] == pytest.approx(54.972271, abs=0.01)


def test_vincenty_takes_the_last_longitude():
    """The fourth decimal of these turned when the arc was that of the step before the last."""
    lines = [(11.18, 150.4, -16.92, 90.64, 7272.2754), (9.37, 67.46, -16.92, 90.64, 3868.5594), (69.83, 132.86, 45.79, -23.29, 7034.7826), (34.84, 109.83, 5.34, -64.3, 15514.6988)]
    points = np.array(lines).T
    assert np.round(geo.vincenty_km(*points[:4]), 4).tolist() == points[4].tolist()

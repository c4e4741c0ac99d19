"""Correlation, regression, panel, smoothing and resampling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallygrid.catalog.registry import (
    SQL_CUSTOMERS,
    SQL_PANEL,
    customer_facts,
    nation_panel,
    query,
    rnd,
    scored_orders,
)
from tallygrid.operators import correlation, panel, regression, resampling, smoothing
from tallygrid.sources.files import load

_FIT = f"""WITH {SQL_CUSTOMERS}, f AS (SELECT regr_slope(log_spend, acctbal) AS b, regr_intercept(log_spend, acctbal) AS a, avg(acctbal) AS mx, count(*) AS n, regr_sxx(log_spend, acctbal) AS sxx, regr_syy(log_spend, acctbal) AS syy FROM cust),
r AS (SELECT c_custkey, acctbal AS x, log_spend AS y, log_spend - a - b * acctbal AS e, 1.0::DOUBLE / n + (acctbal - mx) * (acctbal - mx) / sxx AS h FROM cust, f)"""


@query("j1_pearson_ci", f"WITH {SQL_CUSTOMERS}, s AS (SELECT count(*)::BIGINT AS n, corr(acctbal, log_spend) AS r FROM cust) SELECT n, round(r, 10) AS r, round(tanh(atanh(r) - 1.959963984540054::DOUBLE / sqrt(n - 3)), 10) AS ci_low, round(tanh(atanh(r) + 1.959963984540054::DOUBLE / sqrt(n - 3)), 10) AS ci_high FROM s")
def _(spark, d):
    return rnd(correlation.pearson_ci(customer_facts(spark, d), "acctbal", "log_spend"), r=10, ci_low=10, ci_high=10)


@query("j2_spearman", f"""WITH {SQL_CUSTOMERS}, k AS (SELECT rank() OVER (ORDER BY n_orders) + (count(*) OVER (PARTITION BY n_orders) - 1) / 2.0::DOUBLE AS a, rank() OVER (ORDER BY acctbal) + (count(*) OVER (PARTITION BY acctbal) - 1) / 2.0::DOUBLE AS b FROM cust) SELECT count(*)::BIGINT AS n, round(corr(a, b), 9) AS rho FROM k""")
def _(spark, d):
    return rnd(correlation.spearman(customer_facts(spark, d), "n_orders", "acctbal").select("n", "rho"), rho=9)


def _sql_permuted(source: str) -> str:
    """SQL of one application of the bijection to place p of replicate k, its rounds as nested selects; ``e`` has n and the bases na, nb."""
    prime, sql = (1 << 31) - 1, f"SELECT pos, k, (p - p % nb) // nb AS l, p % nb AS r FROM {source}, e"
    for i in range(6):
        sql = f"SELECT pos, k, l, r, (k * 1000003 + 123 + {i * 7368787}) % {prime} AS key FROM ({sql})"
        sql = f"SELECT *, ({'l' if i % 2 else 'r'} + key) % {prime} AS t FROM ({sql})"
        sql = f"SELECT *, (t * t + key * 48271 + {'l' if i % 2 else 'r'}) % {prime} AS u FROM ({sql})"
        digits = f"l, (r + (u * u + 69621) % {prime}) % nb AS r" if i % 2 else f"(l + (u * u + 69621) % {prime}) % na AS l, r"
        sql = f"SELECT pos, k, {digits} FROM ({sql}), e"
    return f"SELECT pos, k, l * nb + r AS p FROM ({sql}), e"


@query("j3_permutation_test", f"""WITH RECURSIVE {SQL_CUSTOMERS}, m AS (SELECT count(*) AS n, avg(acctbal) AS mx, avg(log_spend) AS my, corr(acctbal, log_spend) AS r FROM cust),
e AS MATERIALIZED (SELECT n, nb, (n + nb - 1) // nb AS na FROM (SELECT n, CAST(ceil(sqrt(n)) AS BIGINT) AS nb FROM m)),
placed AS MATERIALIZED (SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS pos, acctbal - mx AS x, log_spend - my AS y FROM cust, m),
walk AS ({_sql_permuted("(SELECT pos, k, pos AS p FROM placed, range(10000) AS g(k))")} UNION ALL {_sql_permuted("(SELECT walk.* FROM walk, e WHERE p >= n)")}),
s AS (SELECT k, sum(i.x * j.y) AS s FROM walk JOIN placed i ON walk.pos = i.pos JOIN placed j ON walk.p = j.pos GROUP BY k), c AS (SELECT abs(sum(x * y)) * (1 - 1e-12) AS cut FROM placed)
SELECT n::BIGINT AS n, round(r, 10) AS r, 10000 AS "B", (1 + (SELECT count(*) FROM s, c WHERE abs(s) >= cut)) / 10001::DOUBLE AS p FROM m""")
def _(spark, d):
    return rnd(correlation.permutation_corr_test(customer_facts(spark, d), "acctbal", "log_spend", "c_custkey"), r=10)


@query("j4_partial_corr", f"""WITH {SQL_CUSTOMERS}, c AS (SELECT count(*)::BIGINT AS n, corr(log_spend, acctbal) AS yx, corr(log_spend, n_orders) AS yz, corr(acctbal, n_orders) AS xz FROM cust) SELECT n, round((yx - yz * xz) / sqrt((1 - yz * yz) * (1 - xz * xz)), 9) AS r FROM c""")
def _(spark, d):
    return rnd(correlation.partial_corr(customer_facts(spark, d), "log_spend", "acctbal", ["n_orders"]).select("n", "r"), r=9)


@query("j5_ols_hc3", f"""{_FIT}, m AS (SELECT sum(e * e / ((1 - h) * (1 - h)) * (x - mx) * (x - mx)) AS meat FROM r, f)
SELECT 'acctbal' AS term, round(b * 1e6, 6) AS coef_ppm, round(sqrt(meat) / sxx * 1e6, 6) AS se_ppm, round((b - 1.959963984540054::DOUBLE * sqrt(meat) / sxx) * 1e6, 6) AS low_ppm, round((b + 1.959963984540054::DOUBLE * sqrt(meat) / sxx) * 1e6, 6) AS high_ppm, round(1 - (1 - b * b * sxx / syy) * (n - 1) / (n - 2), 9) AS r2_adj, n::BIGINT AS n FROM f, m""")
def _(spark, d):
    fit = regression.ols_hc3(customer_facts(spark, d), "log_spend", ["acctbal"]).filter("term = 'acctbal'")
    ppm = {f"{a}_ppm": F.round(F.col(b) * 1e6, 6).alias(f"{a}_ppm") for a, b in (("coef", "coef"), ("se", "se"), ("low", "ci_low"), ("high", "ci_high"))}
    return fit.select("term", *ppm.values(), F.round("r2_adj", 9).alias("r2_adj"), "n")


@query("j6_standardized_beta", f"WITH {SQL_CUSTOMERS} SELECT 'acctbal' AS term, round(regr_slope(log_spend, acctbal) * stddev_pop(acctbal) / stddev_pop(log_spend), 9) AS beta FROM cust")
def _(spark, d):
    return rnd(regression.standardized_beta(customer_facts(spark, d), "log_spend", ["acctbal"]).select("term", "beta"), beta=9)


@query("j7_breusch_pagan", f"{_FIT}, c AS (SELECT corr(e * e, x) AS r, count(*) AS n FROM r) SELECT round(n * r * r, 7) AS lm, round(r * r / ((1 - r * r) / (n - 2)), 7) AS f FROM c")
def _(spark, d):
    return rnd(regression.breusch_pagan(customer_facts(spark, d), "log_spend", ["acctbal"]).select("lm", "f"), lm=7, f=7)


# x² and x³ span the same columns as the fitted value's powers; they are orthogonalized in turn.
@query("j8_reset_test", f"""{_FIT}, z AS (SELECT e, (x - mx) / sqrt(sxx / n) AS u, n FROM r, f), c AS (SELECT avg(u * u) AS a0, avg(u * u * u) AS a1, avg(u * u * u) AS b0, avg(u * u * u * u) AS b1 FROM z),
q AS (SELECT e, n, u * u - a0 - a1 * u AS p, u * u * u - b0 - b1 * u AS k FROM z, c), g AS (SELECT sum(p * k) / sum(p * p) AS w FROM q), t AS (SELECT e, n, p, k - w * p AS k FROM q, g),
s AS (SELECT pow(sum(e * p), 2) / sum(p * p) + pow(sum(e * k), 2) / sum(k * k) AS gain, sum(e * e) AS rss, max(n) AS n FROM t)
SELECT round((gain / 2) / ((rss - gain) / (n - 4)), 7) AS f, 2::INTEGER AS df1, (n - 4)::INTEGER AS df2 FROM s""")
def _(spark, d):
    return rnd(regression.reset_test(customer_facts(spark, d), "log_spend", ["acctbal"]).drop("p"), f=7)


@query("j9_jarque_bera", f"""{_FIT}, m AS (SELECT count(*) AS n, avg(e) AS mu FROM r), k AS (SELECT max(n) AS n, avg(pow(e - mu, 2)) AS m2, avg(pow(e - mu, 3)) AS m3, avg(pow(e - mu, 4)) AS m4 FROM r, m)
SELECT n::BIGINT AS n, round(m3 / pow(m2, 1.5), 8) AS skewness, round(m4 / (m2 * m2) - 3, 8) AS kurtosis, round(n / 6.0::DOUBLE * (pow(m3 / pow(m2, 1.5), 2) + pow(m4 / (m2 * m2) - 3, 2) / 4), 6) AS jb, round(exp(-n / 12.0::DOUBLE * (pow(m3 / pow(m2, 1.5), 2) + pow(m4 / (m2 * m2) - 3, 2) / 4)), 9) AS p FROM k""")
def _(spark, d):
    out = regression.jarque_bera_residuals(customer_facts(spark, d), "log_spend", ["acctbal"])
    return rnd(out, skewness=8, kurtosis=8, jb=6, p=9)


@query("j10_variance_inflation", f"""WITH {SQL_CUSTOMERS}, s AS (SELECT sum(acctbal * acctbal) AS aa, sum(acctbal * n_orders) AS ab, sum(n_orders * n_orders::DOUBLE) AS bb FROM cust)
SELECT 'acctbal' AS term, round(1 / (1 - ab * ab / (aa * bb)), 9) AS vif FROM s UNION ALL SELECT 'n_orders', round(1 / (1 - ab * ab / (aa * bb)), 9) FROM s""")
def _(spark, d):
    return rnd(regression.variance_inflation(customer_facts(spark, d), ["acctbal", "n_orders"]), vif=9)


@query("j11_influence", f"""{_FIT}, t AS (SELECT sum(e * e) AS rss, count(*) AS n FROM r)
SELECT c_custkey, round(h, 10) AS leverage, round(e / sqrt((rss - e * e / (1 - h)) / (n - 3) * (1 - h)), 7) AS student, round(e * e * h / (rss / (n - 2) * 2 * (1 - h) * (1 - h)), 9) AS cooks_d, h > 4.0::DOUBLE / n AS high_leverage, abs(e / sqrt((rss - e * e / (1 - h)) / (n - 3) * (1 - h))) > 2 AS large_residual FROM r, t""")
def _(spark, d):
    out = regression.influence(customer_facts(spark, d), "log_spend", ["acctbal"])
    return rnd(out.select("c_custkey", "leverage", "student", "cooks_d", "high_leverage", "large_residual"), leverage=10, student=7, cooks_d=9)


@query("j12_quantile_regression")
def _(spark, d):
    return regression.quantile_regression(customer_facts(spark, d), "log_spend", ["acctbal"])


# A median line goes through two of the points: the best of all such lines is the optimum.
@query("j12_median_line", f"""WITH {SQL_PANEL}, pts AS MATERIALIZED (SELECT row_number() OVER (ORDER BY n_name, year) AS i, x, y FROM panel),
lines AS (SELECT row_number() OVER () AS k, b, y1 - b * x1 AS a FROM (SELECT p.x AS x1, p.y AS y1, (q.y - p.y) / (q.x - p.x) AS b FROM pts p JOIN pts q ON p.i < q.i AND p.x <> q.x)),
loss AS (SELECT k, any_value(a) AS a, any_value(b) AS b, sum(abs(y - a - b * x)) AS loss FROM lines, pts GROUP BY k), best AS (SELECT a, b FROM loss ORDER BY loss LIMIT 1), n AS (SELECT count(*)::BIGINT AS n FROM pts)
SELECT 'const' AS term, round(a, 6) AS coef, n, true AS converged FROM best, n UNION ALL SELECT 'x', round(b, 6), n, true FROM best, n""")
def _(spark, d):
    return rnd(regression.quantile_regression(nation_panel(spark, d), "y", ["x"]).select("term", "coef", "n", "converged"), coef=6)


_DEMEANED = f"""WITH {SQL_PANEL}, w AS (SELECT *, x - avg(x) OVER (PARTITION BY n_name) - avg(x) OVER (PARTITION BY year) + avg(x) OVER () AS dx, y - avg(y) OVER (PARTITION BY n_name) - avg(y) OVER (PARTITION BY year) + avg(y) OVER () AS dy FROM panel),
b AS (SELECT sum(dx * dy) / sum(dx * dx) AS beta, sum(dx * dx) AS sxx, count(*) AS n, count(DISTINCT n_name) AS e, count(DISTINCT year) AS t FROM w)"""


@query("j13_panel_fe", f"""{_DEMEANED}, s AS (SELECT n_name, sum(dx * (dy - beta * dx)) AS score FROM w, b GROUP BY 1), m AS (SELECT sum(score * score) AS meat FROM s)
SELECT round(beta, 6) AS beta, round(sqrt(meat) / sxx, 6) AS se, n::BIGINT AS n, e::BIGINT AS n_entities, t::BIGINT AS n_periods FROM b, m""")
def _(spark, d):
    out = panel.panel_fe(nation_panel(spark, d), "y", "x", "n_name", "year")
    return rnd(out.select("beta", "se", "n", "n_entities", "n_periods"), beta=6, se=6)


@query("j14_fixed_effects", f"{_DEMEANED} SELECT n_name, count(*)::BIGINT AS n, round(avg(y) - max(beta) * avg(x), 6) AS effect, n_name IN ('NATION_3', 'BRAZIL', 'GERMANY') AS highlight FROM panel, b GROUP BY 1")
def _(spark, d):
    return rnd(panel.fixed_effects(nation_panel(spark, d), "y", "x", "n_name", "year", ["NATION_3", "BRAZIL", "GERMANY"]), effect=6)


@query("j15_lowess_grid")
def _(spark, d):
    return smoothing.lowess_grid(customer_facts(spark, d), "acctbal", "log_spend")


@query("j15_local_lines", f"""WITH {SQL_CUSTOMERS}, e AS (SELECT min(acctbal) AS lo, max(acctbal) AS hi, CAST(floor(0.6::DOUBLE * count(*) + 1e-10) AS BIGINT) AS k FROM cust),
g AS (SELECT i, k, CASE WHEN i = 19 THEN hi ELSE lo + i * ((hi - lo) / 19) END AS g FROM range(20) r(i), e), d AS (SELECT i, g, k, acctbal AS x, log_spend AS y, abs(acctbal - g) AS d, row_number() OVER (PARTITION BY i ORDER BY abs(acctbal - g)) AS rn FROM g, cust),
h AS (SELECT i, max(d) AS h FROM d WHERE rn <= k GROUP BY 1), w AS (SELECT d.i, g, x - g AS u, y, pow(1 - pow(d / h, 3), 3) AS w FROM d JOIN h ON d.i = h.i WHERE d <= h),
s AS (SELECT i, max(g) AS x, sum(w) AS w, sum(w * u) / sum(w) AS mu, sum(w * y) / sum(w) AS my, sum(w * u * u) / sum(w) AS uu, sum(w * u * y) / sum(w) AS uy FROM w GROUP BY 1)
SELECT i::INTEGER AS i, round(x, 6) AS x, round(my - (uy - mu * my) / (uu - mu * mu) * mu, 7) AS y_hat FROM s""")
def _(spark, d):
    return rnd(smoothing.lowess_grid(customer_facts(spark, d), "acctbal", "log_spend", n_grid=20, robust=0), x=6, y_hat=7)


@query("j16_smearing_fit", f"""WITH {SQL_CUSTOMERS}, f AS (SELECT count(*)::BIGINT AS n, regr_slope(log_spend, acctbal) AS b, regr_intercept(log_spend, acctbal) AS a FROM cust)
SELECT max(n) AS n, round(max(b) * 1e6, 6) AS slope_ppm, round(max(a), 8) AS intercept, round(avg(exp(log_spend - a - b * acctbal)), 8) AS smearing FROM cust, f""")
def _(spark, d):
    out = regression.smearing_fit(customer_facts(spark, d), "acctbal", "spend")
    return out.select("n", F.round(F.col("slope") * 1e6, 6).alias("slope_ppm"), F.round("intercept", 8).alias("intercept"), F.round("smearing", 8).alias("smearing"))


@query("j17_quartile_fits", " ".join([f"WITH {SQL_CUSTOMERS}, q AS (SELECT quantile_cont(acctbal, 0.25) AS a, quantile_cont(acctbal, 0.75) AS b, min(acctbal) AS x1, max(acctbal) AS x2, min(log_spend) AS y1, max(log_spend) AS y2 FROM cust)", " UNION ALL ".join(
    f"""SELECT '{g}' AS "group", count(*)::BIGINT AS n, round(regr_slope(log_spend, acctbal) * 1e6, 5) AS slope_ppm, round(regr_intercept(log_spend, acctbal), 8) AS intercept, round(regr_r2(log_spend, acctbal), 9) AS r2, max(x1) AS x_min, max(x2) AS x_max, round(max(y1), 9) AS y_min, round(max(y2), 9) AS y_max FROM cust, q WHERE {c}""" for g, c in (("Q1", "acctbal <= a"), ("Q4", "acctbal >= b")))]))
def _(spark, d):
    out = regression.quartile_fits(customer_facts(spark, d), "acctbal", "log_spend")
    out = out.withColumn("slope_ppm", F.round(F.col("slope") * 1e6, 5)).drop("slope")
    return rnd(out, intercept=8, r2=9, y_min=9, y_max=9)


@query("j18_group_ols", "SELECT p_type, count(*)::BIGINT AS n, round(regr_slope(p_retailprice, p_size), 7) AS slope, round(regr_intercept(p_retailprice, p_size), 6) AS intercept, round(regr_r2(p_retailprice, p_size), 9) AS r2 FROM part GROUP BY 1")
def _(spark, d):
    return rnd(regression.group_ols(load(spark, d, "part"), ["p_type"], "p_size", "p_retailprice"), slope=7, intercept=6, r2=9)


@query("j19_bootstrap_ci")
def _(spark, d):
    return resampling.bootstrap_ci(scored_orders(spark, d), "y", "pred")


@query("j20_spline_fit")
def _(spark, d):
    return smoothing.spline_fit(load(spark, d, "lineitem"), "l_quantity", "l_extendedprice")


@query("j21_bias_variance", """WITH t AS (SELECT avg(o_totalprice) AS truth FROM orders), e AS (SELECT o_custkey, o_orderstatus, avg(o_totalprice) AS est FROM orders GROUP BY 1, 2)
SELECT o_orderstatus, count(*)::BIGINT AS n, round(pow(avg(est - truth), 2), 1) AS bias2, round(var_samp(est), 0) AS variance, round(avg((est - truth) * (est - truth)), 0) AS mse FROM e, t GROUP BY 1""")
def _(spark, d):
    from tallygrid.operators.joins import attach_global

    o = load(spark, d, "orders")
    est = o.groupBy("o_custkey", "o_orderstatus").agg(F.avg("o_totalprice").alias("est"))
    out = resampling.bias_variance(attach_global(est, o, truth=F.avg("o_totalprice")), "est", "truth", ["o_orderstatus"])
    return rnd(out, bias2=1, variance=0, mse=0)


@query("j21_bootstrap_means")
def _(spark, d):
    return resampling.bootstrap_means(load(spark, d, "orders"), "o_totalprice", "o_orderkey", 100)




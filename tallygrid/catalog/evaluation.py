"""Classifier evaluation and matrix queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallygrid.catalog.registry import SQL_CUSTOMERS, SQL_SCORED, customer_facts, query, rnd, scored_orders
from tallygrid.operators import evaluation as ev
from tallygrid.operators import linalg
from tallygrid.sources.files import load

BY = ["o_orderpriority"]
_COUNTS = "sum(CASE WHEN y = 1 AND pred = 1 THEN 1 ELSE 0 END)::BIGINT AS tp, sum(CASE WHEN y = 0 AND pred = 1 THEN 1 ELSE 0 END)::BIGINT AS fp, sum(CASE WHEN y = 0 AND pred = 0 THEN 1 ELSE 0 END)::BIGINT AS tn, sum(CASE WHEN y = 1 AND pred = 0 THEN 1 ELSE 0 END)::BIGINT AS fn"
_CURVE = f"""WITH {SQL_SCORED}, s AS (SELECT o_orderpriority, prob AS score, count(*) AS n, sum(y) AS pos FROM scored GROUP BY 1, 2),
c AS (SELECT *, sum(pos) OVER w AS tp, sum(n - pos) OVER w AS fp, sum(pos) OVER (PARTITION BY o_orderpriority) AS p, sum(n - pos) OVER (PARTITION BY o_orderpriority) AS q FROM s
 WINDOW w AS (PARTITION BY o_orderpriority ORDER BY score DESC ROWS UNBOUNDED PRECEDING))"""


def _grid(n: int, lo: str, hi: str) -> str:
    return f"""WITH {SQL_SCORED}, g AS (SELECT i, CASE WHEN i = {n - 1} THEN {hi}::DOUBLE ELSE {lo}::DOUBLE + i * (({hi}::DOUBLE - {lo}::DOUBLE) / {n - 1}) END AS t FROM range({n}) r(i)),
s AS (SELECT o_orderpriority, prob, count(*) AS n, sum(y) AS pos FROM scored GROUP BY 1, 2),
c AS (SELECT o_orderpriority, i, t, sum(CASE WHEN prob >= t THEN pos ELSE 0 END) AS tp, sum(CASE WHEN prob >= t THEN n - pos ELSE 0 END) AS fp, sum(CASE WHEN prob < t THEN n - pos ELSE 0 END) AS tn, sum(CASE WHEN prob < t THEN pos ELSE 0 END) AS fn FROM s, g GROUP BY 1, 2, 3)"""


@query("l1_confusion_counts", f"WITH {SQL_SCORED} SELECT o_orderpriority, {_COUNTS} FROM scored GROUP BY 1")
def _(spark, d):
    return ev.confusion_counts(scored_orders(spark, d), "y", "pred", BY)


@query("l2_classification_metrics", f"""WITH {SQL_SCORED}, c AS (SELECT o_orderpriority, {_COUNTS} FROM scored GROUP BY 1)
SELECT *, round((tp + tn) / (tp + fp + tn + fn)::DOUBLE, 9) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0), 9) AS precision, round(coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0), 9) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0), 9) AS f1,
 round((tp::DOUBLE * tn - fp::DOUBLE * fn) / sqrt((tp + fp)::DOUBLE * (tp + fn)::DOUBLE * (tn + fp)::DOUBLE * (tn + fn)::DOUBLE), 9) AS mcc FROM c""")
def _(spark, d):
    out = ev.classification_metrics(scored_orders(spark, d), "y", "pred", BY)
    return rnd(out, accuracy=9, precision=9, recall=9, f1=9, mcc=9)


@query("l3_roc_auc", f"{_CURVE} SELECT o_orderpriority, round((sum(pos * (q - fp + (n - pos) / 2.0::DOUBLE)) / max(p::DOUBLE * q))::DOUBLE, 9) AS roc_auc FROM c GROUP BY 1")
def _(spark, d):
    return rnd(ev.roc_auc(scored_orders(spark, d), "y", "prob", BY), roc_auc=9)


@query("l4_pr_auc", f"{_CURVE} SELECT o_orderpriority, round((sum(pos * (tp / (tp + fp)::DOUBLE)) / max(p))::DOUBLE, 9) AS pr_auc FROM c GROUP BY 1")
def _(spark, d):
    return rnd(ev.pr_auc(scored_orders(spark, d), "y", "prob", BY), pr_auc=9)


@query("l5_brier_log_loss", f"""WITH {SQL_SCORED}, k AS (SELECT *, least(greatest(prob, 1e-15::DOUBLE), 1 - 1e-15::DOUBLE) AS q FROM scored)
SELECT o_orderpriority, round(avg((prob - y) * (prob - y)), 9) AS brier, round(avg(-(y * ln(q) + (1 - y) * ln(1 - q))), 9) AS log_loss FROM k GROUP BY 1""")
def _(spark, d):
    return rnd(ev.probability_losses(scored_orders(spark, d), "y", "prob", BY), brier=9, log_loss=9)


@query("l6_roc_points", f"{_CURVE} SELECT o_orderpriority, score AS threshold, round((fp / q::DOUBLE)::DOUBLE, 9) AS fpr, round((tp / p::DOUBLE)::DOUBLE, 9) AS tpr FROM c")
def _(spark, d):
    return rnd(ev.roc_points(scored_orders(spark, d), "y", "prob", BY), fpr=9, tpr=9)


@query("l7_threshold_table", f"""{_grid(25, '0.1', '0.7')} SELECT o_orderpriority, t AS threshold, round(((tp + tn) / (tp + fp + tn + fn)::DOUBLE)::DOUBLE, 9) AS accuracy, round((tn / nullif(tn + fp, 0)::DOUBLE)::DOUBLE, 9) AS specificity,
 round((tp / nullif(tp + fn, 0)::DOUBLE)::DOUBLE, 9) AS sensitivity, round((tn / nullif(tn + fn, 0)::DOUBLE)::DOUBLE, 9) AS npv, round((tp / nullif(tp + fp, 0)::DOUBLE)::DOUBLE, 9) AS ppv FROM c""")
def _(spark, d):
    out = ev.threshold_table(scored_orders(spark, d), "y", "prob", by=BY)
    return rnd(out, accuracy=9, specificity=9, sensitivity=9, npv=9, ppv=9)


@query("l8_pr_points", f"{_CURVE} SELECT o_orderpriority, score AS threshold, round((tp / (tp + fp)::DOUBLE)::DOUBLE, 9) AS precision, round((tp / p::DOUBLE)::DOUBLE, 9) AS recall, round(((tp / (tp + fp)::DOUBLE) / (p / (p + q)::DOUBLE))::DOUBLE, 9) AS lift FROM c")
def _(spark, d):
    return rnd(ev.pr_points(scored_orders(spark, d), "y", "prob", BY), precision=9, recall=9, lift=9)


@query("l9_calibration_curve", f"WITH {SQL_SCORED}, b AS (SELECT *, (SELECT count(*) FROM range(1, 10) t(i) WHERE i * 0.1::DOUBLE < prob) AS bin FROM scored) SELECT o_orderpriority, bin::INTEGER AS bin, round(avg(prob), 9) AS mean_prob, round(avg(y), 9) AS frac_positive, count(*)::BIGINT AS n FROM b GROUP BY 1, 2")
def _(spark, d):
    return rnd(ev.calibration_curve(scored_orders(spark, d), "y", "prob", by=BY), mean_prob=9, frac_positive=9)


@query("l10_best_threshold", f"""{_grid(500, '0.01', '0.99')}, f AS (SELECT o_orderpriority, i, t, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0)::DOUBLE AS f1 FROM c), r AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY f1 DESC, i) AS rn FROM f)
SELECT o_orderpriority, t AS threshold, round(f1, 9) AS f1 FROM r WHERE rn = 1""")
def _(spark, d):
    return rnd(ev.best_threshold(scored_orders(spark, d), "y", "prob", by=BY), f1=9)


@query("l_evaluate_all", f"""{_CURVE},
k AS (SELECT *, least(greatest(prob, 1e-15::DOUBLE), 1 - 1e-15::DOUBLE) AS q FROM scored),
l AS (SELECT o_orderpriority, {_COUNTS}, avg((prob - y) * (prob - y)) AS brier, avg(-(y * ln(q) + (1 - y) * ln(1 - q))) AS log_loss FROM k GROUP BY 1),
a AS (SELECT o_orderpriority, sum(pos * (q - fp + (n - pos) / 2.0::DOUBLE)) / max(p::DOUBLE * q) AS roc_auc, sum(pos * (tp / (tp + fp)::DOUBLE)) / max(p) AS pr_auc FROM c GROUP BY 1)
SELECT o_orderpriority, tp, fp, tn, fn, round((tp + tn) / (tp + fp + tn + fn)::DOUBLE, 9) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0), 9) AS precision,
 round(coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0), 9) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0), 9) AS f1,
 round((tp::DOUBLE * tn - fp::DOUBLE * fn) / sqrt((tp + fp)::DOUBLE * (tp + fn)::DOUBLE * (tn + fp)::DOUBLE * (tn + fn)::DOUBLE), 9) AS mcc,
 round(roc_auc::DOUBLE, 9) AS roc_auc, round(pr_auc::DOUBLE, 9) AS pr_auc, round(brier, 9) AS brier, round(log_loss, 9) AS log_loss FROM l JOIN a USING (o_orderpriority)""")
def _(spark, d):
    out = ev.evaluate(scored_orders(spark, d), "y", "prob", "pred", BY)
    return rnd(out, accuracy=9, precision=9, recall=9, f1=9, mcc=9, roc_auc=9, pr_auc=9, brier=9, log_loss=9)


@query("m1_matmul", """WITH a AS (SELECT l_suppkey AS i, l_partkey AS k, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2), b AS (SELECT p_partkey AS k, p_size AS j, p_retailprice AS v FROM part)
SELECT i, j, round(sum(a.v * b.v), 2) AS v FROM a JOIN b USING (k) GROUP BY 1, 2""")
def _(spark, d):
    a = load(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("i"), F.col("l_partkey").alias("k")).agg(F.sum("l_quantity").alias("v"))
    b = load(spark, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("j"), F.col("p_retailprice").alias("v"))
    return rnd(linalg.matmul(a, b), v=2)


@query("m2_logistic_gradient", f"""WITH {SQL_CUSTOMERS}, e AS (SELECT acctbal / 1000 AS a, n_orders / 10.0::DOUBLE AS b, 1 / (1 + exp(-(acctbal / 1000 * 0.2::DOUBLE + n_orders / 10.0::DOUBLE * -0.5::DOUBLE))) - y AS err FROM cust)
SELECT 'a' AS feature, round(avg(a * err), 9) AS gradient FROM e UNION ALL SELECT 'b', round(avg(b * err), 9) FROM e""")
def _(spark, d):
    c = customer_facts(spark, d).select((F.col("acctbal") / 1000).alias("a"), (F.col("n_orders") / 10).alias("b"), "y")
    return rnd(linalg.logistic_gradient(c, ["a", "b"], "y", [0.2, -0.5]), gradient=9)

"""Nearest-neighbour, clustering and classifier queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallygrid.catalog.registry import SQL_CUSTOMERS, customer_facts, query, rnd
from tallygrid.operators import models, nearest, summary, windows
from tallygrid.operators.ordered import attach_scalars
from tallygrid.sources.files import load

FEATURES = ["acctbal_std", "n_orders_std", "log_spend_std"]
SPACE = {"logreg": {"C": [0.001, 0.1, 1.0, 10.0]}, "rf": {"n_estimators": [10, 20], "max_depth": [3, 5]}}


def scaled_customers(spark, d):
    return models.standardize(customer_facts(spark, d), ["acctbal", "n_orders", "log_spend"], ddof=1)


_LEVELS = ["MACHINERY", "HOUSEHOLD", "FURNITURE", "BUILDING"]


@query("k1_encode_formula", f"WITH {SQL_CUSTOMERS} SELECT c_custkey, acctbal, n_orders::DOUBLE AS n_orders, y::DOUBLE AS label, " + ", ".join(f"CASE WHEN c_mktsegment = '{v}' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS {v.lower()}" for v in _LEVELS) + " FROM cust")
def _(spark, d):
    from pyspark.ml.functions import vector_to_array

    c = customer_facts(spark, d).select("c_custkey", "y", "acctbal", "n_orders", "c_mktsegment")
    x = models.encode_formula(c, "y ~ acctbal + n_orders + c_mktsegment").withColumn("x", vector_to_array("features"))
    names = ["acctbal", "n_orders", *[v.lower() for v in _LEVELS]]
    return x.select("c_custkey", *[F.col("x")[i].alias(n) for i, n in enumerate(names)], "label")


@query("k2_standardize", f"""WITH {SQL_CUSTOMERS} SELECT c_custkey, round((acctbal - avg(acctbal) OVER ()) / stddev_pop(acctbal) OVER (), 8) AS acctbal_std, round((n_orders - avg(n_orders) OVER ()) / stddev_pop(n_orders) OVER (), 8) AS n_orders_std FROM cust""")
def _(spark, d):
    out = models.standardize(customer_facts(spark, d), ["acctbal", "n_orders"])
    return rnd(out.select("c_custkey", "acctbal_std", "n_orders_std"), acctbal_std=8, n_orders_std=8)


@query("k3_knn_regress", """WITH q AS (SELECT s_suppkey, 900 + abs(s_acctbal) / 10 AS x FROM supplier), d AS (SELECT s_suppkey, p_partkey, p_size, row_number() OVER (PARTITION BY s_suppkey ORDER BY abs(p_retailprice - x), p_partkey) AS rank FROM q, part)
SELECT s_suppkey, k::INTEGER AS k, round(avg(p_size), 8) AS y_hat FROM d, (VALUES (1), (2), (3), (25)) t(k) WHERE rank <= k GROUP BY 1, 2""")
def _(spark, d):
    train = load(spark, d, "part").select("p_partkey", F.col("p_retailprice").alias("x"), F.col("p_size").cast("double").alias("size"))
    ask = load(spark, d, "supplier").select("s_suppkey", (900 + F.abs(F.col("s_acctbal")) / 10).alias("x"))
    return rnd(nearest.knn_regress(train, ask, "x", "size", [1, 2, 3, 25], "p_partkey", "s_suppkey", "absolute"), y_hat=8)


_KNN = """WITH d AS (SELECT q.vec_id, q.label AS actual, t.label, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(q.embedding::DOUBLE[], t.embedding::DOUBLE[]), t.vec_id) AS rank FROM embeddings q, embeddings t WHERE q.vec_id % 4 <> t.vec_id % 4),
v AS (SELECT vec_id, actual, k, label, count(*) AS n FROM d, (VALUES (1), (3)) t(k) WHERE rank <= k GROUP BY 1, 2, 3, 4), p AS (SELECT *, row_number() OVER (PARTITION BY vec_id, k ORDER BY n DESC, label) AS rn FROM v)"""


def _folded(spark, d):
    return load(spark, d, "embeddings").withColumn("fold", (F.col("vec_id") % 4).cast("int"))


@query("k4_knn_cv", f"{_KNN} SELECT k::INTEGER AS k, round(avg(CASE WHEN label <> actual THEN 1.0 ELSE 0.0 END), 9) AS error, round(avg(CASE WHEN label <> actual THEN 0.0 ELSE 1.0 END), 9) AS accuracy FROM p WHERE rn = 1 GROUP BY 1")
def _(spark, d):
    return rnd(nearest.knn_cv(_folded(spark, d), "embedding", "label", "fold", [1, 3], "vec_id"), error=9, accuracy=9)


@query("k4_knn_confusion", f"{_KNN} SELECT k::INTEGER AS k, actual, label AS pred, count(*)::BIGINT AS n FROM p WHERE rn = 1 GROUP BY 1, 2, 3")
def _(spark, d):
    preds = nearest.knn_cv_predictions(_folded(spark, d), "embedding", "label", "fold", [1, 3], "vec_id")
    return summary.confusion_table(preds, "actual", "pred", ["k"])


@query("k5_logit_coefficients")
def _(spark, d):
    return models.fit_logit(customer_facts(spark, d), "y ~ acctbal + log_spend + c_mktsegment").coefficients()


@query("k6_logit_predict")
def _(spark, d):
    split = windows.stratified_split(customer_facts(spark, d), "y", "c_custkey", 0.7)
    model = models.fit_logit(split.filter("is_train"), "y ~ acctbal + log_spend")
    return model.predict(split.filter("not is_train")).select("c_custkey", "y", "prob")


@query("k7_gradient_boosting")
def _(spark, d):
    return models.fit_score(scaled_customers(spark, d), FEATURES, "y", "gboost", maxIter=10).select("c_custkey", "prob", "pred")


@query("k8_random_search")
def _(spark, d):
    return models.random_search(scaled_customers(spark, d), FEATURES, "y", "c_custkey", "logreg", SPACE["logreg"], n_iter=3)[1]


@query("k9_out_of_fold")
def _(spark, d):
    folded = windows.stratified_folds(scaled_customers(spark, d), "y", "c_custkey", 5)
    return models.oof_predict(folded, FEATURES, "y", "fold", "logreg").select("c_custkey", "fold", "prob")


@query("k9_cv_scores")
def _(spark, d):
    return models.cv_scores(scaled_customers(spark, d), FEATURES, "y", "c_custkey")


@query("k10_compare_models")
def _(spark, d):
    settings = {"rf": {"n_estimators": 20, "max_depth": 5}, "gboost": {"n_estimators": 5}}
    return models.compare_models(scaled_customers(spark, d), FEATURES, "y", "c_custkey", settings=settings)


@query("k11_fit_score")
def _(spark, d):
    return models.fit_score(scaled_customers(spark, d), FEATURES, "y").select("c_custkey", "prob", "pred")


@query("k12_kmeans_auto")
def _(spark, d):
    rows, table = models.kmeans_auto(customer_facts(spark, d), ["acctbal", "log_spend"], "c_custkey")
    clusters = summary.cluster_summary(rows, "cluster", "acctbal", ["log_spend"])
    out = attach_scalars(clusters, table.filter("chosen").select("k", "measure", "silhouette"), "t")
    return out.select("*", "t.k", "t.measure", "t.silhouette").drop("t")


@query("k13_mean_model", "SELECT s_suppkey, round((SELECT avg(p_retailprice) FROM part), 6) AS y_hat FROM supplier")
def _(spark, d):
    return rnd(models.mean_model(load(spark, d, "part"), load(spark, d, "supplier").select("s_suppkey"), "p_retailprice"), y_hat=6)

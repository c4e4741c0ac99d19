import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallygrid.operators import evaluation as ev
from tallygrid.operators import clusters, models, nearest, windows


@pytest.fixture(scope="module")
def scored(spark):
    """Twenty evenly spaced scores with a repeating pattern of outcomes."""
    pattern = [0, 0, 1, 0, 0, 1, 0, 0, 1, 1] * 2
    rows = [(i, 0.05 + i * 0.9 / 19, int(i >= 10), y) for i, y in enumerate(pattern)]
    return spark.createDataFrame(rows, "id int, prob double, pred int, y int").cache()


def _auc(rows):
    pos, neg = [p for p, y in rows if y], [p for p, y in rows if not y]
    return sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg))


def test_confusion_and_metrics(scored):
    r = ev.evaluate(scored, "y", "prob", "pred").first()
    assert (r["tp"], r["fp"], r["tn"], r["fn"]) == (4, 6, 6, 4)
    assert (r["accuracy"], r["precision"], r["recall"]) == (0.5, 0.4, 0.5)
    assert r["f1"] == pytest.approx(2 * 0.4 * 0.5 / 0.9)
    assert r["mcc"] == pytest.approx(0.0)
    rows = [(x["prob"], x["y"]) for x in scored.collect()]
    assert r["roc_auc"] == pytest.approx(_auc(rows))
    ordered = sorted(rows, reverse=True)
    hits, ap = 0, 0.0
    for k, (_, y) in enumerate(ordered, 1):
        hits += y
        ap += y * hits / k / 8
    assert r["pr_auc"] == pytest.approx(ap)
    assert r["brier"] == pytest.approx(np.mean([(p - y) ** 2 for p, y in rows]))


def test_zero_division(spark):
    df = spark.createDataFrame([(0, 0.1, 0), (0, 0.2, 0)], "y int, prob double, pred int")
    r = ev.evaluate(df, "y", "prob", "pred").first()
    assert (r["precision"], r["recall"], r["f1"], r["mcc"], r["roc_auc"]) == (0.0, 0.0, 0.0, 0.0, None)


def test_auc_with_ties_and_monotone(spark, plans):
    rng = random.Random(2)
    rows = [(i, "a" if i % 3 else "b", round(rng.random(), 1), int(rng.random() < 0.4)) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, m string, prob double, y int")
    got = {r["m"]: r["roc_auc"] for r in ev.roc_auc(df, "y", "prob", ["m"]).collect()}
    for m in "ab":
        assert got[m] == pytest.approx(_auc([(p, y) for _, g, p, y in rows if g == m]))
    cubed = df.withColumn("prob", F.pow("prob", F.lit(3.0)))
    again = {r["m"]: r["roc_auc"] for r in ev.roc_auc(cubed, "y", "prob", ["m"]).collect()}
    assert again == pytest.approx(got)


def test_threshold_table(scored):
    rows = [(r["prob"], r["y"]) for r in scored.collect()]
    table = ev.threshold_table(scored, "y", "prob").orderBy("threshold").collect()
    assert len(table) == 25
    for r in table:
        t = r["threshold"]
        tp = sum(p >= t and y for p, y in rows)
        tn = sum(p < t and not y for p, y in rows)
        assert r["accuracy"] == pytest.approx((tp + tn) / 20)
        assert r["sensitivity"] == pytest.approx(tp / 8) and r["specificity"] == pytest.approx(tn / 12)
    best = ev.best_threshold(scored, "y", "prob").first()
    grid = np.linspace(0.01, 0.99, 500)

    def f1(t):
        tp = sum(p >= t and y for p, y in rows)
        called = sum(p >= t for p, _ in rows)
        return 2 * tp / (8 + called)

    values = [f1(t) for t in grid]
    assert best["threshold"] == pytest.approx(grid[int(np.argmax(values))]) and best["f1"] == pytest.approx(max(values))


def test_calibration_edges(spark):
    df = spark.createDataFrame([(0.0, 0), (0.2, 1), (0.2000001, 1), (1.0, 1)], "prob double, y int")
    rows = ev.calibration_curve(df, "y", "prob", 5).orderBy("bin").collect()
    assert [(r["bin"], r["n"]) for r in rows] == [(0, 2), (1, 1), (4, 1)]


def test_calibration_bins_follow_the_edges(spark):
    edges = np.linspace(0, 1, 11)
    values = sorted({float(np.nextafter(e, d)) for e in edges[1:-1] for d in (0, 1)} | {float(e) for e in edges} | {i / 10 for i in range(11)})
    df = spark.createDataFrame([(v, 1) for v in values], "prob double, y int")
    got = {r["bin"]: r["n"] for r in ev.calibration_curve(df, "y", "prob", 10).collect()}
    want = np.bincount(np.searchsorted(edges[1:-1], values), minlength=10)
    assert [got.get(i, 0) for i in range(10)] == list(want)


def test_lift(scored, plans):
    rows = windows.cumulative_lift(scored, "prob", "y", "id").orderBy("rank").collect()
    assert rows[0]["lift"] == pytest.approx(1 / 0.4) and rows[-1]["lift"] == pytest.approx(1.0)


@pytest.mark.parametrize("shape", ["spread", "hot", "outside"])
def test_knn_on_line_matches_brute_force(spark, plans, shape):
    rng = random.Random(4)
    values = [3.0 if shape == "hot" and rng.random() < 0.5 else round(rng.random() * 20, 1) for _ in range(150)]
    asks = [round(rng.random() * 20 + (30 if shape == "outside" else 0), 1) for _ in range(60)]
    train = spark.createDataFrame([(i, v, float(i % 7)) for i, v in enumerate(values)], "id int, x double, y double")
    query = spark.createDataFrame(list(enumerate(asks)), "q int, x double")
    for k in (1, 4, 40):
        got = {}
        for r in nearest.nearest(train, query, "x", k, "id", "q", ["y"], "absolute").collect():
            got.setdefault(r["q"], {})[r["rank"]] = (r["neighbour"], r["y"])
        for j, a in enumerate(asks):
            want = sorted(range(len(values)), key=lambda i: (abs(values[i] - a), i))[:k]
            assert [got[j][n + 1] for n in range(k)] == [(i, float(i % 7)) for i in want]


def test_knn_1d(spark):
    train = spark.createDataFrame([(1, 1.0, 1.0), (2, 2.0, 4.0), (3, 3.0, 9.0)], "id int, x double, y double")
    query = spark.createDataFrame([(0, 0.5), (1, 2.1), (2, 4.0)], "q int, x double")
    want = {(0, 1): 1.0, (1, 1): 4.0, (2, 1): 9.0, (0, 2): 2.5, (1, 2): 6.5, (2, 2): 6.5}
    for blocks in ({}, {"train_block": 1, "query_block": 2}):
        got = {(r["q"], r["k"]): r["y_hat"] for r in nearest.knn_regress(train, query, "x", "y", [1, 2, 3], "id", "q", "absolute", **blocks).collect()}
        for key, v in want.items():
            assert got[key] == v
        assert got[(0, 3)] == pytest.approx(14 / 3)
    with pytest.raises(ValueError, match="distance"):
        nearest.knn_regress(train, query, "x", "y", [1], "id", "q", "cosine")


def test_knn_tie_by_id_in_blocks(spark):
    train = spark.createDataFrame([(i, 1.0 if i % 2 else -1.0, 0.0) for i in range(20)], "id int, x double, y double")
    query = spark.createDataFrame([(0, 0.0, 0.0)], "q int, x double, y double")
    for blocks in ({}, {"train_block": 3, "query_block": 1}):
        near = nearest.nearest(train, query, ["x", "y"], 4, "id", "q", **blocks).orderBy("rank").collect()
        assert [r["neighbour"] for r in near] == [0, 1, 2, 3]


# Twelve buyers with satisfaction, engagement and outcome.
BUYERS = [
    ("a", 0.71, 0.89, "sim"), ("b", 0.25, 0.57, "nao"), ("c", 0.39, 0.59, "sim"), ("d", 0.09, 0.37, "nao"),
    ("e", 0.96, 0.36, "sim"), ("f", 0.01, 0.59, "sim"), ("g", 0.57, 0.87, "nao"), ("h", 0.76, 0.68, "sim"),
    ("i", 0.87, 0.14, "nao"), ("j", 0.04, 0.55, "nao"), ("k", 0.66, 0.68, "nao"), ("l", 0.88, 0.53, "sim"),
]


def test_knn_cv_matches_brute_force(spark):
    rows = [(*b, i % 4) for i, b in enumerate(BUYERS)]
    df = spark.createDataFrame(rows, "ID string, satisf double, engage double, comprou string, fold int")
    preds = {(r["ID"], r["k"]): r["pred"] for r in nearest.knn_cv_predictions(df, ["satisf", "engage"], "comprou", "fold", [1, 3], "ID").collect()}
    for q in rows:
        near = sorted((((q[1] - t[1]) ** 2 + (q[2] - t[2]) ** 2) ** 0.5, t[0], t[3]) for t in rows if t[4] != q[4])
        for k in (1, 3):
            votes = [t[2] for t in near[:k]]
            assert preds[(q[0], k)] == min(set(votes), key=lambda v: (-votes.count(v), v))
    table = nearest.knn_cv(df, ["satisf", "engage"], "comprou", "fold", [1, 3], "ID").collect()
    assert all(r["error"] + r["accuracy"] == pytest.approx(1.0) for r in table)


@pytest.fixture(scope="module")
def classes(spark):
    rng = np.random.default_rng(7)
    rows = []
    for i in range(240):
        y = int(i % 3 == 0)
        rows.append((i, float(rng.normal(1.5 * y)), float(rng.normal(-y)), "ab"[i % 2], y))
    return spark.createDataFrame(rows, "id int, u double, v double, g string, y int").cache()


def test_logit(classes):
    model = models.fit_logit(classes, "y ~ u + v + g")
    table = {r["term"]: r for r in model.coefficients().collect()}
    assert set(table) == {"u", "v", "g_b", "const"}
    # Score equations: X'(y − p) = 0 at the maximum.
    pdf = classes.toPandas()
    X = np.column_stack([pdf["u"], pdf["v"], pdf["g"] == "b", np.ones(len(pdf))]).astype(float)
    w = np.array([table[t]["estimate"] for t in ("u", "v", "g_b", "const")])
    p = 1 / (1 + np.exp(-X @ w))
    assert np.abs(X.T @ (pdf["y"] - p)).max() < 1e-5
    se = np.sqrt(np.diag(np.linalg.inv((X.T * (p * (1 - p))) @ X)))
    assert [table[t]["std_error"] for t in ("u", "v", "g_b", "const")] == pytest.approx(list(se), rel=1e-4)
    scored = model.predict(classes).orderBy("id").collect()
    assert [r["prob"] for r in scored] == pytest.approx(list(p), abs=1e-6)


def test_encode_and_standardize(classes):
    d = models.encode_formula(classes, "y ~ u + g").select("features", "g").collect()
    assert all(r["features"][1] == (1.0 if r["g"] == "b" else 0.0) for r in d)
    for ddof, fn in ((0, F.stddev_pop), (1, F.stddev_samp)):
        r = models.standardize(classes, ["u"], ddof).agg(F.avg("u_std"), fn("u_std")).first()
        assert r[0] == pytest.approx(0, abs=1e-12) and r[1] == pytest.approx(1)


def test_build_model():
    with pytest.raises(ValueError, match="logreg"):
        models.build_model("svm")
    assert models.build_model("logreg", 100, C=2.0).getRegParam() == pytest.approx(1 / 200)
    assert models.build_model("gboost", learning_rate=0.2).getStepSize() == 0.2


def test_fit_and_tune(classes):
    out = models.fit_score(classes, ["u", "v"], "y")
    assert set(out.select("pred").distinct().toPandas()["pred"]) == {"yes", "no"}
    best, table, fitted = models.random_search(classes, ["u", "v"], "y", "id", "logreg", {"C": [0.01, 1.0, 10.0]}, n_iter=2)
    rows = table.collect()
    assert len(rows) == 2 and sum(r["best"] for r in rows) == 1 and set(best) == {"C"} and fitted.numFeatures == 2


def test_out_of_fold(classes):
    folded = windows.stratified_folds(classes, "y", "id", 3)
    out = models.oof_predict(folded, ["u", "v"], "y", "fold")
    assert out.count() == 240 and out.select("id").distinct().count() == 240
    table = models.compare_models(classes, ["u", "v"], "y", "id", models=["logreg", "xgb"], folds=3).collect()
    assert [r["model"] for r in table] == ["logreg"] and table[0]["roc_auc"] > 0.8
    with pytest.raises(ValueError):
        models.compare_models(classes, ["u", "v"], "y", "id", models=["xgb"])


def test_kmeans(spark):
    rng = np.random.default_rng(0)
    rows = [(i, float(rng.normal(20 * (i % 3), 0.5)), float(rng.normal(-10 * (i % 3), 0.5))) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, a double, b double")
    out, table = models.kmeans_auto(df, ["a", "b"], "id", (2, 3, 4))
    assert table.filter("chosen").first()["k"] == 3
    assert out.groupBy("cluster").count().filter("count = 20").count() == 3
    with pytest.raises(ValueError):
        models.kmeans_auto(df.limit(4), ["a", "b"], "id")


def test_shared_kmeans_passes(spark):
    """Steps against the same steps in numpy, silhouettes against their definition over all pairs; ties, repeated rows, a lone row."""
    rng = np.random.default_rng(5)
    data = np.vstack([rng.normal(0, 1, (60, 3)), rng.normal(4, 1, (50, 3)), np.zeros((10, 3)), [[40.0, 40.0, 40.0]]])
    x = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(data)], "id int, a double, b double, c double").repartition(4)
    start = {k: data[rng.choice(60, k, replace=False)] for k in (1, 2, 4)}
    got = clusters.Centres(start, ["a", "b", "c"]).sums(x)
    near = {k: ((data[:, None] - c) ** 2).sum(2).argmin(1) for k, c in start.items()}
    for k, own in near.items():
        want = [[(own == j).sum(), *data[own == j].sum(0), (data[own == j] ** 2).sum()] for j in range(k)]
        assert np.allclose(got[k], want)
    fitted = clusters.fit_centres(x, ["a", "b", "c"], "id", (1, 2, 3, 4), max_iter=50)
    scores = fitted.silhouettes(x)
    assert sorted(scores) == [2, 3, 4]
    gaps = ((data[:, None] - data) ** 2).sum(2)
    for k, score in scores.items():
        own = ((data[:, None] - fitted.models[k]) ** 2).sum(2).argmin(1)
        assert np.allclose([data[own == j].mean(0) for j in range(k)], fitted.models[k], atol=1e-3)
        values = []
        for i in range(len(data)):
            mean = [gaps[i, own == j].sum() / max((own == j).sum() - (own[i] == j), 1) for j in range(k)]
            a, b = mean[own[i]], min(m for j, m in enumerate(mean) if j != own[i])
            values.append(0.0 if (own == own[i]).sum() == 1 else (b - a) / max(a, b))
        assert score == pytest.approx(np.mean(values), abs=1e-9)
    assert 1 in [(((data[:, None] - fitted.models[3]) ** 2).sum(2).argmin(1) == j).sum() for j in range(3)]
    same = spark.createDataFrame([(i, 1.0) for i in range(9)], "id int, a double")
    assert len(clusters.fit_centres(same, ["a"], "id", (3,)).models[3]) == 1
    with pytest.raises(ValueError):
        models.kmeans_auto(same, ["a"], "id")


def test_scoring_keeps_every_row(classes, spark):
    odd = spark.createDataFrame([(9001, None, 1.0, "a", 1), (9002, float("nan"), 1.0, "a", 0), (9003, 0.5, 1.0, "never seen", None), (9004, 0.5, 1.0, None, 1)], "id int, u double, v double, g string, y int")
    kinds = dict(classes.dtypes)
    odd = odd.select(*[F.col(c).cast(kinds[c]).alias(c) for c in ("id", "u", "v", "g", "y")])
    every = classes.select("id", "u", "v", "g", "y").unionByName(odd)
    model = models.fit_logit(classes, "y ~ u + v + g")
    got = {r["id"]: r["prob"] for r in model.predict(every).filter("id > 9000").collect()}
    assert got == {9001: None, 9002: None, 9003: None, 9004: None}
    assert model.predict(every).count() == every.count() and model.predict(classes).filter("prob IS NULL").count() == 0
    facts = model.fit_facts().first()
    assert facts["null_deviance"] > facts["deviance"] > 0 and facts["aic"] > facts["deviance"]
    scored = {r["id"]: r["prob"] for r in models.fit_score(every, ["u", "v"], "y").collect()}
    assert len(scored) == every.count() and scored[9001] is None and scored[9002] is None and scored[9003] is not None
    table = models.cv_scores(every, ["u", "v"], "y", "id", folds=3).first()
    assert 0 <= table["accuracy"] <= 1

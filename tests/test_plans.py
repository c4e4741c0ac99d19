import math

import numpy as np
import pytest

from tallygrid.plans import comparison, study, survey


@pytest.fixture(scope="module")
def indicators(spark):
    rng = np.random.default_rng(3)
    years = list(range(2015, 2021))
    names = ["Brasil", "Estados Unidos", "Alemanha", *[f"Land {i}" for i in range(9)]]
    base = {f"C{i:02d}": n for i, n in enumerate(names)}
    edu = {c: [float(10 + 5 * i + rng.normal(0, 2)) for _ in years] for i, c in enumerate(base)}
    pc = {c: [math.exp(0.05 * e + rng.normal(0, 0.1)) for e in edu[c]] for c in base}
    values = {"gdp": lambda c, j: pc[c][j] * 100.0, "population": lambda c, j: 100.0, "area": lambda c, j: 10.0 + int(c[1:]), "higher_ed_pct": lambda c, j: edu[c][j]}
    schema = "iso string, country string, " + ", ".join(f"`{y}` double" for y in years)
    tables = {}
    for k, f in values.items():
        rows = [(c, n, *[None if (k == "gdp" and c == "C03" and j == 0) else float(f(c, j)) for j in range(len(years))]) for c, n in base.items()]
        tables[k] = spark.createDataFrame(rows, schema)
    return tables


def test_study(indicators):
    panel = study.build_panel(indicators, "iso", "country", 2020)
    assert panel.count() == 12 * 6 - 1
    out = study.run_study(indicators, "iso", "country", 2020, ["brasil", "ALEMANHA"], permutations=99)
    assert out["pearson"].first()["r"] > 0.9
    assert out["permutation"].first()["p"] == pytest.approx(0.01)
    assert {r["term"] for r in out["ols"].collect()} == {"const", "higher_ed_pct"}
    assert out["panel"].first()["n_entities"] == 12
    assert out["effects"].count() == 12
    assert {r["iso"] for r in out["paths"].select("iso").distinct().collect()} == {"C00", "C02"}
    assert out["codes"].count() == 12
    assert out["clusters"].agg({"n": "sum"}).first()[0] == 12
    assert out["influence"].count() == 3
    for name in ("spearman", "beta", "breusch_pagan", "reset", "jarque_bera", "median_line", "lowess", "quartiles", "labels", "cluster_scores", "cluster_landmarks"):
        assert out[name].count() > 0, name


def test_study_needs_rows(indicators):
    view = study.cross_section(study.build_panel(indicators, "iso", "country", 2020), "iso", "country").limit(3)
    with pytest.raises(ValueError, match="at least 4"):
        study.analyse_view(view, "iso")


def test_compare_versions(spark):
    a = spark.createDataFrame([("x", 1.0), ("y", 2.0)], "k string, v double")
    b = spark.createDataFrame([("x", 1.5), ("y", 2.0), ("z", 1.0)], "k string, v double")
    out = study.compare_versions(a, b, "k", "v")
    assert out["discrepancy"].first()["pct_discrepant"] == 50.0 and out["shared"].first()["n"] == 2


def test_comparison(spark):
    rng = np.random.default_rng(1)
    rows = [(i, float(rng.normal(2 * (i % 2))), i % 2) for i in range(120)]
    df = spark.createDataFrame(rows, "id int, u double, y int")

    out = comparison.compare(df, ["u"], "y", "id", ["logreg", "rf"], folds=2, settings={"rf": {"n_estimators": 5, "max_depth": 2}})
    scores = out["scores"].collect()
    assert len(scores) == 2 and scores[0]["roc_auc"] >= scores[1]["roc_auc"]
    assert all(r["tp"] + r["fp"] + r["tn"] + r["fn"] == 120 for r in scores)
    for name in ("roc", "precision_recall", "calibration", "best_threshold"):
        assert out[name].select("model").distinct().count() == 2


def test_survey(spark):
    rows = [("S" + str(i % 3), "K" + str(i % 2), "A" + str(i % 4), "B" + str(i % 5), i % 7 + 1, float(i) * 10) for i in range(70)]
    df = spark.createDataFrame(rows, "state string, kind string, age string, brand string, cups int, spend double")
    out = survey.survey_report(df, "state", "kind", "age", "brand", "cups", "spend")
    assert out["brand_stats"].agg({"n_people": "sum"}).first()[0] == 70
    segments = out["segment_brand_stats"].groupBy("segment").agg({"n_people": "sum"}).collect()
    assert sum(r[1] for r in segments) == 70
    assert out["heavy_brand_stats"].agg({"n_people": "sum"}).first()[0] == sum(r[4] >= 6 for r in rows)
    for name, table in out.items():
        assert table.count() > 0, name


def test_column_names_as_people_write_them(spark):
    from tallygrid.operators import summary

    rows = [("S" + str(i % 3), "K" + str(i % 2), "A" + str(i % 4), "B" + str(i % 5), i % 7 + 1, float(i) * 10) for i in range(40)]
    names = ["State", "Coffee Type", "Age Group", "Preferred Coffee Brand", "Daily Cups Consumed", "Monthly Coffee Expense (INR)"]
    df = spark.createDataFrame(rows, names)
    for name, table in survey.survey_report(df, *names).items():
        assert table.count() > 0, name
    basket = spark.createDataFrame([("a", 0.5, 2.0), ("b", 2.7, 1.0)], ["PRODUTO", "QUANTIDADE", "PRECO UNIT. (R$)"])
    r = summary.basket_totals(basket, "PRODUTO", "QUANTIDADE", "`PRECO UNIT. (R$)`").first()
    assert (float(r["total_value"]), r["units"], r["dearest"]) == (3.7, 3, "a")

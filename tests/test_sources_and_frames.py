import math
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallygrid.functions import scalars as s
from tallygrid.operators import frames, joins, sets, summary, topk
from tallygrid.sources import files

# A shopping list (product; quantity; unit price) whose totals are known.
BASKET = """PRODUTO;QUANTIDADE;PRECO UNIT. (R$)
Achocolatado;2;5.89
Acucar;3;2.03
Agua;10;1.89
Alface;1;2.99
Arroz;4;14.87
Atum;3;7.45
Azeite;2;17.8
Azeitona;2;8.04
Batata;2.8;4.99
Batata palha;5;5.99
Cafe;3;9.7
Cebola;0.76;3.45
Cenoura;1.98;3.99
Cha;2;3.67
Chocolate;1;9.9
Coco ralado;2;3.78
Creme de Leite;5;2.46
Farinha de mandioca;1;4
Farinha de milho;1;4.05
Farinha de trigo;3;3.78
Feijao;2;5.82
Fermento;2;3.5
Gelatina;9;1.23
Geleia;4;8.9
Laranja;3.76;2.75
Leite;4;2.99
Maca;2.02;12.99
Manteiga;2;9.9
Margarina;2;5.76
Molho branco;5;2.88
Molho de tomate;5;1.99
Mortadela;0.300;40
Oleo;2;6
Oregano;2;5.99
Pepino;0.78;4.89
Presunto;0.350;50
Queijo;0.400;45
Refrigerante;5;6
Sal;2;2.75
Sardinha;4;4.89
Suco;10;4.97
Tomate;0.983;6.3
Vinho;2;37
"""

# Two versions of a small country table.
NAMES = ["Brasil", "EUA", "México", "Alemanha", "França", "OCDE", "G20", "América do Sul"]
GDP_1 = [1.9, 23.4, 1.3, 4.2, 2.9, 60.0, 90.0, 3.3]
GDP_2 = [2.1, 25.0, 1.5, 4.0, 3.0, 55.0, 95.0, 4.0]


@pytest.fixture
def basket(spark, tmp_path):
    path = tmp_path / "basket.csv"
    path.write_text(BASKET.replace("5.89", "5,89") + "short;1\nbad;one;2\n;;\n", encoding="utf-8")
    return files.read_delimited_tolerant(spark, str(path), ";", "product string, qty decimal(10,3), price decimal(10,2)")


def test_basket(basket):
    assert basket.count() == 43
    r = summary.basket_totals(basket, "product", "qty", "price").first()
    assert r["n_rows"] == 43
    assert float(r["total_value"]) == pytest.approx(743.0711)
    assert r["units"] == 126
    assert float(r["total_by_units"]) == pytest.approx(822.33)
    assert (r["dearest"], float(r["dearest_price"])) == ("Presunto", 50.0)


def test_basket_keeps_every_place(spark):
    rows = spark.sql("select 'a' as product, 1.2345678 as qty, cast(0.333333 as double) as price union all select 'b', 2.0000001, 1e-9")
    r = summary.basket_totals(rows, "product", "qty", "price").first()
    assert r["total_value"] == Decimal("1.2345678") * Decimal("0.333333") + Decimal("2.0000001") * Decimal("0.000000001")
    assert r["units"] == 3 and r["total_by_units"] == Decimal("0.333333") + 2 * Decimal("0.000000001")


def test_basket_tie_takes_first(spark):
    df = spark.createDataFrame([(1, "b", 1.0, 9.0), (0, "a", 1.0, 9.0), (2, "c", 0.5, 1.0)], "id int, product string, qty double, price double")
    assert summary.basket_totals(df, "product", "qty", "price", "id").first()["dearest"] == "a"


def test_csv_round_trip_and_bom(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("﻿name,gdp\nBrasil,1.9\nEUA,x\n,3\n", encoding="utf-8")
    df = files.read_csv(spark, str(path), "name string, gdp double")
    assert [tuple(r) for r in df.collect()] == [("Brasil", 1.9), ("EUA", None), (None, 3.0)]
    out = str(tmp_path / "out")
    files.write_csv(df, out)
    assert sorted(map(tuple, files.read_csv(spark, out, "name string, gdp double").collect()), key=str) == sorted([("Brasil", 1.9), ("EUA", None), (None, 3.0)], key=str)


def test_preamble(spark, tmp_path):
    path = tmp_path / "w.csv"
    path.write_text('"Data Source","X",\n\n"Last Updated","Y",\n\n"name","code","1990","1991",\n"A, land","AAA","1.5","",\n"B","BBB","","2",\n')
    df = files.read_csv_preamble(spark, str(path), "name string, code string, y1990 double, y1991 double", F.length("code") == 3)
    assert [tuple(r) for r in df.orderBy("code").collect()] == [("A, land", "AAA", 1.5, None), ("B", "BBB", None, 2.0)]


def test_conform(spark):
    df = spark.createDataFrame([("A", "10", "2.5"), ("B", "n/a", "3")], "`País` string, population string, gdp_pc string")
    out = files.conform(df, {"País": "country"}, ["country", "population"], ["population", "gdp"], ("gdp", "gdp_pc", "population"), ["country", "gdp", "population"])
    assert [tuple(r) for r in out.orderBy("country").collect()] == [("A", 25.0, 10.0), ("B", None, None)]
    with pytest.raises(ValueError, match="area.*country"):
        files.conform(df, {}, ["country", "area"], [])
    with pytest.raises(ValueError, match="gdp"):
        files.conform(df.drop("gdp_pc"), {}, [], [], ("gdp", "gdp_pc", "population"))


def test_discrepancy(spark):
    a = spark.createDataFrame(list(zip(NAMES, GDP_1)), "country string, gdp double")
    b = spark.createDataFrame(list(zip(NAMES, GDP_2)), "country string, gdp double")
    assert summary.discrepancy_rate(a, b, ["country"], "gdp").first()["pct_discrepant"] == pytest.approx(37.5)
    zero = spark.createDataFrame([("x", 0.0), ("y", 1.0)], "country string, gdp double")
    other = spark.createDataFrame([("x", 5.0), ("y", 2.0)], "country string, gdp double")
    assert tuple(summary.discrepancy_rate(zero, other, ["country"], "gdp").first()) == (2, 50.0)


def test_level_and_spread(spark):
    a = spark.createDataFrame(list(zip(NAMES, GDP_1)), "country string, gdp double")
    r = summary.level_and_spread({"one": a}, ["gdp"]).first()
    assert r["mean_gdp"] == pytest.approx(sum(GDP_1) / 8)


def test_linear_score_and_row_sums(spark):
    df = spark.createDataFrame([(12.0, 8.0), (7.0, 5.0), (10.0, 9.0)], "a double, b double")
    assert [r[0] for r in df.select(frames.linear_score(F.col("a"), F.col("b"))).collect()] == [44.0, 30.5, 43.0]
    m = spark.createDataFrame([([1.0, 2.0, 3.0],), ([4.0, 5.0, 6.0],), ([7.0, 8.0, 9.0],)], "m array<double>")
    assert [r[0] for r in summary.row_sums(m, "m").select("row_sum").collect()] == [6.0, 15.0, 24.0]


def test_stat_summary(spark, plans):
    df = spark.createDataFrame([(float(v),) for v in (15, 10, 21, 30, 52, 60)], "v double")
    r = summary.stat_summary(df, "v").first()
    assert (r["n"], r["df"]) == (6, 5)
    assert r["mean"] == pytest.approx(31.3333, abs=1e-4)
    assert r["median"] == pytest.approx(25.5)
    one = summary.stat_summary(df.limit(1), "v").first()
    assert one["sd"] is None


def test_parity(spark):
    df = spark.range(11).select(F.col("id").alias("v"))
    out = frames.with_parity(df, "v").filter("square_is_even").orderBy("v")
    assert [r["square"] for r in out.collect()] == [0, 4, 16, 36, 64, 100]


def test_segments_on_edges(spark, plans):
    df = spark.createDataFrame([(float(v),) for v in (1, 2, 3, 4, 5)] + [(None,)], "v double")
    got = {r["v"]: r["segment"] for r in frames.segment_by_quantiles(df, "v").collect()}
    assert got == {1.0: "Light", 2.0: "Light", 3.0: "Moderate", 4.0: "Moderate", 5.0: "Heavy", None: None}
    same = spark.createDataFrame([(1.0,)] * 3, "v double")
    assert {r["segment"] for r in frames.segment_by_quantiles(same, "v").collect()} == {"Light"}
    with pytest.raises(ValueError):
        frames.segment_by_quantiles(df, "v", labels=["x"])


def test_grid_position_is_exact(spark):
    points = frames.grid_values(0.1, 0.7, 25)
    values = sorted({p + d for p in points for d in (-1e-12, 0.0, 1e-12)} | {0.0, 0.05, 0.9, math.nextafter(0.1, 0)})
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for v, at in df.select("v", frames.grid_position(F.col("v"), 0.1, 0.7, 25)).collect():
        assert at == sum(p <= v for p in points)


def test_clean_and_feature(spark):
    rows = [("a", 50.0, 10.0, 5.0, 2.0), ("b", 101.0, 1.0, 1.0, 1.0), ("c", 10.0, 0.0, 1.0, 1.0), ("d", None, 1.0, 1.0, 1.0), ("e", 0.0, 1.0, 1.0, -1.0)]
    df = spark.createDataFrame(rows, "country string, higher_ed_pct double, gdp double, population double, area double")
    out = frames.clean_and_feature(df).collect()
    assert [r["country"] for r in out] == ["a"]
    assert out[0]["log_gdp_pc"] == pytest.approx(math.log(2.0))
    assert out[0]["log_area"] == pytest.approx(math.log(2.0))


def test_levels_and_labels(spark):
    df = spark.createDataFrame([("nao",), ("sim",), ("talvez",), (None,)], "c string")
    assert [tuple(r) for r in frames.with_levels(df, "c", ["nao", "sim"]).collect()] == [("nao", 1), ("sim", 2), (None, None), (None, None)]
    p = spark.createDataFrame([(0.5,), (0.4999,), (None,)], "prob double")
    assert [r["pred"] for r in frames.label_by_threshold(p).collect()] == ["yes", "no", "no"]


def test_unpivot_and_panel(spark):
    a = spark.createDataFrame([("A", "Aland", 1.0, None), ("B", "Bland", 3.0, 4.0)], "iso string, country string, `2000` double, `2001` double")
    b = spark.createDataFrame([("A", 5.0, 6.0), ("B", 7.0, 8.0), ("B", 1.0, 2.0), ("C", 1.0, 1.0)], "iso string, `2000` double, `2001` double")
    long = frames.unpivot_years(a, ["iso"], range(1999, 2005))
    assert [tuple(r) for r in long.orderBy("iso", "year").collect()] == [("A", 2000, 1.0), ("B", 2000, 3.0), ("B", 2001, 4.0)]
    out = joins.assemble_panel({"x": a, "z": b}, "iso", range(1999, 2005), ["country"])
    got = sorted((r["iso"], r["country"], r["year"], r["x"], r["z"]) for r in out.collect())
    assert got == [("A", "Aland", 2000, 1.0, 5.0), ("B", "Bland", 2000, 3.0, 7.0), ("B", "Bland", 2001, 4.0, 8.0)]


def test_joins(spark):
    df = spark.createDataFrame([(1, 0), (2, 1), (3, 2)], "id int, fold int")
    pairs = {(r["id"], r["test_fold"]) for r in joins.train_sets(df, "fold", [0, 1, 2]).collect()}
    assert pairs == {(1, 1), (1, 2), (2, 0), (2, 2), (3, 0), (3, 1)}
    names = spark.createDataFrame([("BRASIL",), ("Alemanha ",), ("França",), (None,)], "c string")
    assert {r[0] for r in joins.keep_named(names, "c", ["brasil", "franca"]).collect()} == {"BRASIL", "França"}
    v = spark.createDataFrame([("A",), ("B",), ("C",), ("D",), ("A",), (None,)], "v string")
    assert len(joins.value_pairs(v, "v").collect()) == 6
    many = spark.range(60).selectExpr("CAST(id AS string) AS v")
    old, joins.PAIR_BLOCK = joins.PAIR_BLOCK, 7
    try:
        got = {tuple(r) for r in joins.value_pairs(many, "v").collect()}
    finally:
        joins.PAIR_BLOCK = old
    assert got == {(a, b) for a in map(str, range(60)) for b in map(str, range(60)) if a < b}


def test_null_keys(spark):
    df = spark.createDataFrame([("a", 1.0), (None, 2.0), (None, 4.0)], "k string, v double")
    assert summary.group_mean(df, ["k"], ["v"]).count() == 1
    assert {r["k"]: r["n"] for r in summary.count_by(df, ["k"]).collect()} == {"a": 1, None: 2}
    assert {r["k"]: round(r["pct"], 3) for r in summary.value_counts(df, "k").collect()} == {"a": 33.333, None: 66.667}
    got = {r["column"]: r["n_distinct"] for r in summary.count_distinct(df, ["k", "v"], dropna=False).collect()}
    assert got == {"k": 2, "v": 3}
    profile = {r["column"]: (r["nulls"], r["n_distinct"]) for r in summary.null_profile(df).collect()}
    assert profile == {"k": (2, 2), "v": (0, 3)}
    from tallygrid.operators.windows import demean

    assert sorted(r["v_dev"] for r in demean(df, "k", ["v"]).collect()) == [-1.0, 0.0, 1.0]


def test_majority_and_baseline(spark):
    df = spark.createDataFrame([("sim",)] * 6 + [("nao",)] * 6, "comprou string")
    r = summary.majority_class(df, "comprou").first()
    assert (r["majority"], r["error"]) == ("nao", 0.5)


def test_histogram(spark):
    df = spark.createDataFrame([(float(v),) for v in (0, 1, 2, 3, 10)], "v double")
    assert [r["count"] for r in summary.histogram(df, "v", 5).orderBy("bin").collect()] == [2, 2, 0, 0, 1]
    flat = summary.histogram(spark.createDataFrame([(4.0,)] * 3, "v double"), "v", 2).orderBy("bin").collect()
    assert [(r["lo"], r["hi"], r["count"]) for r in flat] == [(3.5, 4.0, 0), (4.0, 4.5, 3)]


def test_histogram_follows_numpy(spark):
    import numpy as np

    values = [round(i * 0.1, 10) for i in range(31)] + [0.7000000000000001, 1.2000000000000002]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for bins in (3, 7, 10, 30):
        got = [r["count"] for r in summary.histogram(df, "v", bins).orderBy("bin").collect()]
        assert got == list(np.histogram(values, bins)[0])


def test_approximate_distinct(spark):
    df = spark.createDataFrame([(i % 5, None if i % 2 else "x") for i in range(50)], "a int, b string")
    exact = {r["column"]: r["n_distinct"] for r in summary.count_distinct(df, ["a", "b"]).collect()}
    near = {r["column"]: r["n_distinct"] for r in summary.count_distinct(df, ["a", "b"], approximate=True).collect()}
    assert exact == near == {"a": 5, "b": 1}


def test_crosstab(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "x"), ("a", "y"), ("b", "y"), (None, "y")], "r string, c string")
    assert [tuple(r) for r in summary.crosstab_pct(df, "r", "c", ["x", "y"]).orderBy("r").collect()] == [("a", pytest.approx(2 / 3), pytest.approx(1 / 3)), ("b", 0.0, 1.0)]


def test_kde_integrates_to_one(spark):
    df = spark.createDataFrame([(float(v % 17),) for v in range(100)], "v double")
    rows = summary.kde(df, "v", 400).orderBy("i").collect()
    step = rows[1]["x"] - rows[0]["x"]
    assert sum(r["density"] for r in rows) * step == pytest.approx(1.0, abs=1e-3)


def test_metric_subsets(spark):
    df = spark.createDataFrame([(i, float(i), n) for i, n in enumerate(["Brazil", "x", "USA", "y", "z", "Alemanha", "w", "v"])], "id int, m double, name string")
    out = topk.metric_subsets(df, "m", "id", "name", ["brazil", "usa", "alemanha"], k=2, K=3).collect()
    got = {}
    for r in out:
        got.setdefault(r["subset"], set()).add(r["id"])
    assert got == {"bottom2": {0, 1}, "top2": {6, 7}, "mid2": {3, 4}, "bottom3": {0, 1, 2}, "top3": {5, 6, 7}, "named": {0, 2, 5}}
    with pytest.raises(ValueError):
        topk.metric_subsets(df, "none", "id", "name")


def test_flag_extremes_fallback(spark):
    df = spark.createDataFrame([(i, float(i), float(-i), 0.1 * i) for i in range(20)], "id int, x double, y double, r double")
    out = topk.flag_extremes(df, "x", "y", "r", "id").collect()
    assert out[0]["id"] == 19 and len(out) <= 12


def test_union_and_sample(spark):
    a = spark.createDataFrame([(1, "x")], "id int, n string")
    b = spark.createDataFrame([("y", 2)], "n string, id int")
    assert {tuple(r) for r in sets.union_tagged({"a": a, "b": b}).collect()} == {(1, "x", "a"), (2, "y", "b")}
    d = spark.range(100)
    one = topk.sample_n(d.repartition(1), "id", 10).collect()
    assert one == topk.sample_n(d.repartition(8), "id", 10).collect() and len(one) == 10


def test_text_functions(spark):
    df = spark.createDataFrame([("Ação!! Já",), ("Socorram-me, subi no ônibus em Marrocos",), ("Straße",), ("",), (None,)], "t string")
    t = F.col("t")
    out = df.select(s.slug(t), s.fold_key(t), s.is_palindrome(t)).collect()
    assert out[0][0] == "a_o_j" and out[0][1] == "acao!! ja"
    assert [r[2] for r in out] == [False, True, False, True, None]
    assert out[2][1] == "strasse"
    nums = spark.createDataFrame([("1,5",), (" 2.25 ",), ("x",), ("",)], "t string")
    assert [r[0] for r in nums.select(s.parse_decimal(t).cast("double")).collect()] == [1.5, 2.25, None, None]
    labels = spark.createDataFrame([("bra", "Brazil"), (" ", "United States"), (None, "United Kingdom"), (None, None)], "c string, n string")
    assert [r[0] for r in labels.select(s.short_label(F.col("c"), F.col("n"))).collect()] == ["BRA", "United States", "United Kingd…", ""]
    div = spark.createDataFrame([(-7, 2), (7, -2), (7, 0)], "a int, b int")
    assert [tuple(r) for r in div.select(s.floor_div(F.col("a"), F.col("b")), s.floor_mod(F.col("a"), F.col("b"))).collect()] == [(-4, 1), (-4, -1), (None, None)]


def test_narrow_columns_run_on_streams(spark, tmp_path):
    from tallygrid.functions.geo import add_geo_features

    src = str(tmp_path / "in")
    spark.createDataFrame([(1, 0.0, 0.0, 0.0, 1.0, 0.7)], "id int, a double, b double, c double, d double, prob double").write.parquet(src)
    stream = spark.readStream.schema("id int, a double, b double, c double, d double, prob double").parquet(src)
    out = frames.label_by_threshold(add_geo_features(stream, "a", "b", "c", "d"))
    q = out.writeStream.format("memory").queryName("geo_stream").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    r = spark.table("geo_stream").first()
    assert r["pred"] == "yes" and r["geo_distance_km"] == pytest.approx(111.195, abs=0.01)


def test_crosstab_long(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "x"), ("a", "y"), ("b", "y"), (None, "y"), ("c", None)], "r string, c string")
    got = {(r["r"], r["level"]): r["share"] for r in summary.crosstab_long(df, "r", "c").collect()}
    assert got == {("a", "x"): pytest.approx(2 / 3), ("a", "y"): pytest.approx(1 / 3), ("b", "y"): 1.0}


def test_tolerant_reader_keeps_long_rows(spark, tmp_path):
    (tmp_path / "t.txt").write_text('name;n;price\na;1;2,5\nb;2;3;extra;more\nc;3\n"d;e";4;1.5\n;5;1\nf;x;1\n"g";6;\n', encoding="utf-8")
    df = files.read_delimited_tolerant(spark, str(tmp_path), ";", "p string, n int, price double")
    assert sorted(map(tuple, df.collect())) == [("", 5, 1.0), ("a", 1, 2.5), ("b", 2, 3.0), ("d;e", 4, 1.5)]
    assert df.count() == df.select("p").count() == len(df.select("n").collect()) == 4


def test_nan_is_missing_and_zero_has_one_sign(spark):
    nan = float("nan")
    df = spark.createDataFrame([("a", v) for v in (1.0, 2.0, nan, 3.0, None, 0.0, -0.0)], "k string, v double")
    d = summary.describe(df, ["v"]).first()
    assert (d["count"], d["mean"], d["min"], d["median"], d["max"]) == (5, 1.2, 0.0, 1.0, 3.0)
    assert summary.stat_summary(df, "v").first()["mean"] == 1.2
    profile = {r["column"]: (r["nulls"], r["n_distinct"]) for r in summary.null_profile(df).collect()}
    assert profile["v"] == (2, 5)
    assert {r["column"]: r["n_distinct"] for r in summary.count_distinct(df, ["v"]).collect()} == {"v": 4}
    bins = summary.histogram(df, "v", 3).orderBy("bin").collect()
    assert [r["count"] for r in bins] == [2, 1, 2] and bins[0]["lo"] == 0.0
    assert summary.box_stats(df, "k", "v").first()["n"] == 5
    assert all(r["density"] > 0 for r in summary.kde(df, "v", 20).collect())
    assert summary.profile_numbers_by(df, "k", ["v"]).first()["n_missing"] == 2


def test_fold_key_matches_every_letter(spark):
    from tallygrid.functions import scalars as s

    texts = ["".join(chr(c) for c in range(a, a + 16)) + "x" for a in range(0x80, 0x600, 16)] + [" Éß œ ", "漢字ガ", "ﬁn Ⅷ", "Ǆ ĳ", "İı", "e\u0301"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    import unicodedata

    for r in df.select("t", s.fold_key(F.col("t")).alias("k")).collect():
        want = "".join(c for c in unicodedata.normalize("NFKD", r["t"].strip().casefold()) if not unicodedata.combining(c))
        assert r["k"] == want == s.fold_text(r["t"]), r["t"]

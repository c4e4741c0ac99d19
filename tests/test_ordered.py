"""Order-based helpers against plain Python, with skewed and duplicated values."""

import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallygrid.operators import ordered, summary, windows


def _rows(n=400, seed=3):
    rng = random.Random(seed)
    # A third of the rows share one value, and one group holds most rows.
    return [(i, "a" if rng.random() < 0.7 else "b", 5.0 if rng.random() < 0.34 else round(rng.random() * 10, 2)) for i in range(n)]


def test_row_numbers_with_hot_value(spark, plans):
    rows = _rows()
    df = spark.createDataFrame(rows, "id bigint, g string, v double").repartition(7)
    out = {r["id"]: r["pos"] for r in ordered.row_numbers(df, "v", "pos", ["g"], tie="id", descending=True).collect()}
    for g in "ab":
        ids = [i for i, _, _ in sorted((r for r in rows if r[1] == g), key=lambda r: (-r[2], r[0]))]
        assert [out[i] for i in ids] == list(range(1, len(ids) + 1))


def test_missing_values_come_last(spark, plans):
    values = [3.0, None, float("nan"), 1.0, None, 2.0, float("nan"), 2.0] + [float(i) for i in range(10, 60)]
    df = spark.createDataFrame(list(enumerate(values)), "id int, v double")

    def place(v, down):
        if v is None:
            return (2, 0)
        if v != v:
            return (-1, 0) if down else (1, 0)
        return (0, -v if down else v)

    for down in (False, True):
        out = {r["id"]: r["pos"] for r in ordered.row_numbers(df, "v", "pos", tie="id", descending=down).collect()}
        ids = sorted(range(len(values)), key=lambda i: (place(values[i], down), i))
        assert [out[i] for i in ids] == list(range(1, len(ids) + 1))


def test_neighbours(spark, plans):
    rows = _rows()
    df = spark.createDataFrame(rows, "id bigint, g string, v double")
    near = {r["id"]: (r["prev"], r["next"]) for r in ordered.neighbours(df, "v", ["id"], ["g"], tie="id").collect()}
    for g in "ab":
        ids = [i for i, _, _ in sorted((r for r in rows if r[1] == g), key=lambda r: (r[2], r[0]))]
        for k, i in enumerate(ids):
            prev, nxt = near[i]
            assert (prev["id"] if prev else None) == (ids[k - 1] if k else None)
            assert (nxt["id"] if nxt else None) == (ids[k + 1] if k + 1 < len(ids) else None)


def test_exact_quantiles(spark, plans):
    rows = _rows()
    df = spark.createDataFrame([*rows, (900, "c", None), (901, None, 2.0), (902, None, 4.0), (903, "d", float("nan"))], "id bigint, g string, v double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    out = {r["g"]: (r["q_v"], r["n"]) for r in ordered.exact_quantiles(df, ["v"], probs, ["g"], [F.count(F.lit(1)).alias("n")]).collect()}
    for g in "ab":
        want = np.quantile([v for _, k, v in rows if k == g], probs)
        assert out[g][0] == pytest.approx(list(want))
    assert out[None][0] == pytest.approx([2.0, 2.2, 2.5, 3.0, 3.8, 4.0])
    for empty in "cd":
        q, n = out[empty]
        assert n == 1 and (q is None or all(v is None for v in q))
    whole = ordered.exact_quantiles(df, ["v"], [0.5]).first()["q_v"][0]
    assert whole == pytest.approx(statistics.median([v for _, _, v in rows] + [2.0, 4.0]))


def test_empty_table(spark, plans):
    df = spark.createDataFrame([], "id bigint, g string, v double")
    assert ordered.row_numbers(df, "v", "pos", tie="id").count() == 0
    assert ordered.exact_quantiles(df, ["v"], [0.5], ["g"]).count() == 0
    q = ordered.exact_quantiles(df, ["v"], [0.5]).first()["q_v"]
    assert q is None or q[0] is None
    assert summary.stat_summary(df, "v").first()["n"] == 0


def test_results_do_not_depend_on_partitioning(spark, plans):
    df = spark.createDataFrame(_rows(), "id bigint, g string, v double")
    results = []
    for n in (1, 8):
        d = df.repartition(n)
        folds = windows.stratified_folds(d, "g", "id", 4).orderBy("id").collect()
        split = windows.stratified_split(d, "g", "id", 0.7).orderBy("id").collect()
        results.append((folds, split))
    assert results[0] == results[1]


def test_folds_are_balanced(spark, plans):
    df = spark.createDataFrame(_rows(401), "id bigint, g string, v double")
    counts = windows.stratified_folds(df, "g", "id", 4).groupBy("g", "fold").count().collect()
    for g in "ab":
        sizes = [r["count"] for r in counts if r["g"] == g]
        assert len(sizes) == 4 and max(sizes) - min(sizes) <= 1
    split = windows.stratified_split(df, "g", "id", 0.7).groupBy("g").agg(F.count("*").alias("n"), F.count_if("is_train").alias("t")).collect()
    assert all(r["t"] == int(r["n"] * 0.7 + 1e-9) for r in split)


def test_average_rank(spark, plans, approx_rows):
    df = spark.createDataFrame([(1, 3.0), (2, 1.0), (3, 3.0), (4, 9.0), (5, None)], "id int, v double")
    approx_rows(windows.average_rank(df, "v").select("id", "rank"), [(1, 2.5), (2, 1.0), (3, 2.5), (4, 4.0), (5, None)], ["id"])


def test_integral_and_derivative(spark, plans, approx_rows):
    df = spark.createDataFrame([("p", float(x), float(x * x)) for x in range(6)] + [("q", 1.0, 7.0)], "g string, x double, y double")
    approx_rows(windows.integrate_table(df, "x", "y", ["g"]), [("p", 42.5), ("q", 0.0)], ["g"])
    inner = windows.derivative_table(df, "x", "y", ["g"]).filter("dydx is not null").orderBy("x").collect()
    assert [(r["x"], r["dydx"]) for r in inner] == [(x, 2.0 * x) for x in (1.0, 2.0, 3.0, 4.0)]


def _typed(spark, kind):
    """A hot order value in a third of the rows, with text ids as tie-break."""
    rows = [(i if i % 3 else 0, f"id-{(i * 7919) % 3000:05d}") for i in range(3000)]
    frame = spark.createDataFrame(rows, "n int, id string")
    order = {
        "double": F.col("n").cast("double"), "date": F.date_add(F.lit("2020-01-01").cast("date"), F.col("n")), "decimal": F.col("n").cast("decimal(20,3)") / 8,
        "timestamp": F.timestamp_seconds(F.col("n") * 3600), "text": F.format_string("key-%06d", F.col("n")), "bigint": F.col("n").cast("bigint") + 2**60,
    }[kind]
    return frame.select(order.alias("o"), "id", "n")


@pytest.mark.parametrize("kind", ["double", "date", "decimal", "timestamp", "text", "bigint"])
@pytest.mark.parametrize("descending", [False, True])
def test_any_sortable_order_with_text_ties(spark, plans, kind, descending):
    df = _typed(spark, kind)
    got = {r["id"]: r["row_number"] for r in ordered.row_numbers(df, "o", tie="id", descending=descending).collect()}
    rows = sorted(((r["n"], r["id"]) for r in df.collect()), key=lambda r: (-r[0] if descending else r[0], r[1]))
    assert got == {i: p for p, (_, i) in enumerate(rows, 1)}


def test_hot_value_is_cut_by_text_ties(spark):
    spark.conf.set("tallygrid.rowsPerTask", "0")
    try:
        cells = ordered.with_cells(_typed(spark, "double"), "o", "id").groupBy("__b", "__s").count().collect()
    finally:
        spark.conf.unset("tallygrid.rowsPerTask")
    assert len(cells) >= 8 and max(r["count"] for r in cells) < 1000


def _spread(kind):
    rng = np.random.default_rng(3)
    return {
        "normal": rng.normal(0, 1, 3000), "wide": rng.lognormal(0, 9, 3000) * rng.choice([-1, 1], 3000), "narrow": 1.6e15 + rng.integers(0, 5000, 3000),
        "hot": np.where(rng.random(3000) < 0.4, 7.25, rng.normal(7, 1e-9, 3000)), "tiny": rng.random(3000) * 1e-300, "ends": np.append(rng.normal(0, 1, 2990), [np.inf] * 5 + [-np.inf] * 5),
    }[kind]


@pytest.mark.parametrize("kind", ["normal", "wide", "narrow", "hot", "tiny", "ends"])
@pytest.mark.parametrize("limit", ["0", "20", "2000000"])
def test_quantiles_by_multi_selection(spark, kind, limit):
    values = _spread(kind)
    rows = [(None if i % 3 == 0 else "a" if i % 3 == 1 else "b", float(v), None if i % 5 else 1.0) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "g string, v double, w double")
    probs = [0.1, 0.5, 0.75]
    spark.conf.set("tallygrid.rowsPerTask", limit)
    try:
        got = {r["g"]: r["q_v"] for r in ordered.exact_quantiles(df, ["v", "w"], probs, ["g"]).collect()}
        whole = ordered.exact_quantiles(df, ["v"], [0.0, 0.99]).first()["q_v"]
    finally:
        spark.conf.unset("tallygrid.rowsPerTask")
    for g in (None, "a", "b"):
        assert got[g] == pytest.approx(np.quantile([r[1] for r in rows if r[0] == g], probs), rel=1e-14)
    if kind != "ends":
        assert whole == pytest.approx(np.quantile(values, [0.0, 0.99]), rel=1e-14)


def test_only_wanted_cells_are_shuffled(spark):
    """Two jobs: counts of cells, then the values of a few cells, filtered before the exchange by a small table."""
    df = spark.range(200_000).select(F.pmod(F.xxhash64("id"), F.lit(1_000_003)).cast("double").alias("v"))
    long = df.select(F.lit("v").alias("__var"), F.col("v").alias("__v"))
    spark.conf.set("tallygrid.rowsPerTask", "1000")
    try:
        left = ordered._narrowed(long, ["__var"], [0.25, 0.5])
        plan = left._jdf.queryExecution().executedPlan().toString()
        assert left.count() <= 4 * 1000
    finally:
        spark.conf.unset("tallygrid.rowsPerTask")
    assert "SortMergeJoin" not in plan and "hashpartitioning" not in plan and plan.count("BroadcastHashJoin") == 2


def test_many_groups_are_joined_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(ordered, "TARGET_ROWS", 3)
    df = spark.createDataFrame([(i % 11, float(i * 37 % 101)) for i in range(1000)], "g int, v double")
    got = {r["g"]: r["q_v"] for r in ordered.exact_quantiles(df, ["v"], [0.3], ["g"]).collect()}
    assert got == {g: pytest.approx([np.quantile([float(i * 37 % 101) for i in range(1000) if i % 11 == g], 0.3)]) for g in range(11)}

"""Neighbour search by pivots: against a full search, and what the bounds leave out."""

from __future__ import annotations

import numpy as np
import pytest

from tallygrid.operators import nearest
from tallygrid.operators import pivots as pivots_module
from tallygrid.operators.nearest import DISTANCES
from tallygrid.operators.pivots import Pivots, drawn


def full(train, query, k, metric, exclude):
    out = {}
    for qid, qv, qx in query:
        d = sorted((float(DISTANCES[metric](np.array([qv]), np.array([tv]))[0, 0]), tid) for tid, tv, tx in train if not (exclude and tx == qx))
        out[qid] = d[:k]
    return out


def clusters(n, dims, centres, seed, size=0.05):
    rng = np.random.default_rng(seed)
    middle = rng.normal(0, 10, (centres, dims))
    label = rng.integers(0, centres, n)
    return middle[label] + rng.normal(0, size, (n, dims)), label


def found(spark, train, query, k, metric="euclidean", exclude=None, **blocks):
    shape = "id long, v array<double>, ex long"
    t, q = spark.createDataFrame(train, shape), spark.createDataFrame(query, shape).withColumnRenamed("id", "q")
    out = {}
    for r in nearest.nearest(t, q, "v", k, "id", "q", ["ex"], metric, exclude, **blocks).orderBy("q", "rank").collect():
        out.setdefault(r["q"], []).append((r["distance"], r["neighbour"]))
    return out


@pytest.mark.parametrize("metric", ["euclidean", "absolute"])
@pytest.mark.parametrize("exclude", [None, "self", "fold", "cluster"])
def test_matches_full_search(spark, metric, exclude):
    rows, label = clusters(160, 3, 6, 1)
    rows[40:90] = rows[40]  # a third of the rows are copies
    ex = {None: np.zeros(160), "self": np.arange(160), "fold": np.arange(160) % 4, "cluster": label}[exclude]
    train = [(i, v.tolist(), int(e)) for i, (v, e) in enumerate(zip(rows, ex))]
    got = found(spark, train, train, 4, metric, "ex" if exclude else None, train_block=8, query_block=16)
    assert got == full(train, train, 4, metric, exclude)


def test_more_neighbours_than_rows_and_odd_vectors(spark):
    train = [(1, [0.0, 0.0], 1), (2, [3.0, 4.0], 1), (3, None, 1), (4, [float("nan"), 1.0], 1), (5, [None, 1.0], 1)]
    query = [(7, [0.0, 0.0], 0), (8, None, 0), (9, [float("inf"), 0.0], 0), (10, [0.0, 1.0], 1)]
    got = found(spark, train, query, 5, exclude="ex", train_block=1)
    assert got == {7: [(0.0, 1), (5.0, 2)]}
    assert found(spark, [], query, 2) == {} and found(spark, train, [], 2) == {}


def test_any_function_as_distance(spark):
    rows, _ = clusters(40, 2, 3, 3)
    train = [(i, v.tolist(), 0) for i, v in enumerate(rows)]
    t = spark.createDataFrame(train, "id long, v array<double>, ex long")
    square = lambda q, t: ((q[:, None] - t[None]) ** 2).sum(2)
    got = nearest.nearest(t, t.withColumnRenamed("id", "q"), "v", 2, "id", "q", distance=square, train_block=4).collect()
    want = full(train, train, 2, "euclidean", None)
    assert {(r["q"], r["rank"], r["neighbour"]) for r in got} == {(q, i + 1, d[1]) for q, near in want.items() for i, d in enumerate(near)}


@pytest.mark.parametrize("metric", ["euclidean", "absolute"])
def test_bounds_leave_out_cells_and_never_a_neighbour(metric):
    rows, _ = clusters(4000, 4, 40, 5)
    queries = rows[:200] + 0.01
    pivots = Pivots(rows[::50], DISTANCES[metric], metric == "euclidean")
    cell, away = pivots.place(rows)
    for c in np.unique(cell):
        pivots.hold(int(c), int((cell == c).sum()), away[cell == c].min(), away[cell == c].max())
    d = DISTANCES[metric](queries, rows)
    bound = np.sort(d, axis=1)[:, 4]
    row, seen, _ = pivots.visits(queries, bound, 0, len(pivots.points))
    visited = set(zip(row.tolist(), seen.tolist()))
    assert len(visited) < 0.2 * len(queries) * len(pivots.points)
    needed = {(int(q), int(cell[t])) for q, t in zip(*np.nonzero(d <= bound[:, None]))}
    assert needed <= visited


def test_pivots_are_bounded_and_differ(spark):
    df = spark.createDataFrame([(i, [float(i % 7)] * 3) for i in range(300)], "id long, v array<double>")
    pivots = drawn(df, 50, 3, DISTANCES["euclidean"], True)
    assert 1 < len(pivots.points) <= 7
    assert len(drawn(df, 1, 3, DISTANCES["euclidean"], True).points) == 1


@pytest.mark.parametrize("exclude", [None, "self", "fold"])
@pytest.mark.parametrize("most", [0.0, 1.0])
def test_blocks_and_visits_agree_with_full_search(spark, monkeypatch, exclude, most):
    """In many dimensions bounds leave every cell; blocks of all rows must give the same rows, near ties and far rows included."""
    monkeypatch.setattr(pivots_module, "MOST", most)
    monkeypatch.setattr(pivots_module, "BLOCK_NUMBERS", 24 * 50)
    rng = np.random.default_rng(4)
    rows = rng.normal(size=(230, 24))
    rows[10:20] = rows[10] + rng.normal(0, 1e-9, (10, 24))
    rows[20:26] = rows[10]
    rows[30] += 1e6
    ex = {None: np.zeros(230), "self": np.arange(230), "fold": np.arange(230) % 4}[exclude]
    train = [(i, v.tolist(), int(e)) for i, (v, e) in enumerate(zip(rows, ex))]
    asked = train[::3]
    assert found(spark, train, asked, 4, "euclidean", "ex" if exclude else None, train_block=20, query_block=30) == full(train, asked, 4, "euclidean", exclude)


def test_products_leave_few_pairs():
    """Of 512 x 20 000 pairs hardly more than the wanted ones are computed anew, and none of these is missing."""
    rng = np.random.default_rng(6)
    rows, queries = rng.normal(size=(20_000, 64)), rng.normal(size=(512, 64))
    everywhere, nothing = np.full(512, np.inf), np.zeros(512)
    row, col = pivots_module.Products(rows, np.zeros(20_000), None, queries).candidates(queries, everywhere, nothing, everywhere, None, 3)
    near = np.argsort(DISTANCES["euclidean"](queries, rows), axis=1)[:, :3]
    assert {(i, j) for i, own in enumerate(near.tolist()) for j in own} <= set(zip(row.tolist(), col.tolist())) and len(row) < 512 * 6

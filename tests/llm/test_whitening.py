import math

import numpy as np
import pytest

from tallygrid.llm import bidiagonal, whitening


def problems():
    rng = np.random.default_rng(5)
    q = np.linalg.qr(rng.standard_normal((24, 24)))[0]
    shapes = {f"random {n}": rng.standard_normal((n, n)) for n in (1, 2, 3, 17, 60)}
    twin = rng.standard_normal((30, 30))
    twin[:, 3], twin[:, 7] = twin[:, 4], 0
    return shapes | {
        "twin": twin, "zero": np.zeros((5, 5)), "identity": np.eye(9), "ones": np.ones((8, 8)), "repeated": np.diag([5.0] * 8 + [3.0] * 8 + [1.0] * 8) @ q.T,
        "close": np.diag(1 + 1e-9 * np.arange(24)) @ q.T, "graded": np.diag(10.0 ** -(np.arange(24) / 4)) @ q.T, "glued": np.kron(np.eye(3), rng.standard_normal((8, 8))),
    }


@pytest.mark.parametrize("name", problems())
def test_values_and_vectors(name):
    a = problems()[name]
    values, vectors = bidiagonal.right_vectors(a)
    top = max(float(values[0]), 1e-300)
    assert np.abs(values - np.linalg.svd(a, compute_uv=False) ** 2).max() <= 1e-13 * top
    assert np.abs(vectors.T @ vectors - np.eye(len(a))).max() < 1e-9
    assert np.abs(a.T @ (a @ vectors) - vectors * values).max() <= 1e-12 * top


def test_small_values_are_relatively_exact():
    """A bidiagonal matrix fixes even its least singular value to full relative precision."""
    diagonal, upper = 10.0 ** -np.arange(12), 0.5 * 10.0 ** -np.arange(11)
    values = bidiagonal.squared_values(diagonal, upper)
    inverse = np.linalg.inv(np.diag(diagonal * 10.0 ** np.arange(12)) + np.diag(upper * 10.0 ** np.arange(11), 1))
    scaled = np.diag(10.0 ** np.arange(12))
    assert 1 / math.sqrt(values[-1]) == pytest.approx(np.linalg.norm(inverse @ scaled, 2), rel=1e-12)


def brute(vectors, components=32):
    width = max(map(len, vectors))
    x = [[math.floor(64 * float(c)) + 1_000_000 for c in v] + [1_000_000] * (width - len(v)) for v in vectors]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    dev = [sum((n * a - s) ** 2 for a, s in zip(row, sums)) for row in x]
    centred = np.array([[a * n - s for a, s in zip(row, sums)] for row in x], float) / n
    values, directions = np.linalg.eigh(centred.T @ centred / n)
    values, directions = values[::-1], directions[:, ::-1]
    kept = min(components, int((values > 1e-12 * values[0]).sum()))
    return n, dev, centred @ directions[:, :kept] / np.sqrt(values[:kept]), values[:kept] / values.sum()


def check(frame, vectors, components=32):
    n, dev, white, shares = brute(vectors, components)
    got = {(r.vec_id, r.component): r for r in whitening.whiten(frame, components).collect()}
    assert len(got) == white.size
    for c in range(white.shape[1]):
        own = np.array([got[i, c + 1].whitened for i in range(n)])
        sign = np.sign(own @ white[:, c])
        assert np.abs(own - sign * white[:, c]).max() < 1e-6
        assert got[0, c + 1].explained == pytest.approx(shares[c], rel=1e-8)
    assert all(r.n == n and r.deviation == dev[i] and 0 <= r.identity_error < 1e-9 for (i, _), r in got.items())


@pytest.mark.parametrize("parts,components", [(1, 32), (7, 32), (150, 5)])
def test_against_eigenvectors(spark, parts, components):
    rng = np.random.default_rng(parts)
    vectors = (rng.standard_normal((300, 40)) * np.linspace(0.3, 3, 40)).astype(np.float32).tolist()
    vectors[11] = vectors[11][:20]
    rows = [(i, v, "x", 1) for i, v in enumerate(vectors)]
    extra = [(900, None, "x", 1), (901, [1.0] * 39 + [None], "x", 1), (902, [float("nan")] * 40, "x", 1), (903, [float("-inf")] + [0.0] * 39, "x", 1), (904, [1e37] * 40, "x", 1)]
    frame = spark.createDataFrame(rows + extra, "vec_id long, embedding array<float>, n string, component int").repartition(parts)
    check(frame, vectors, components)


def test_few_and_equal_vectors(spark):
    make = lambda rows: spark.createDataFrame(rows, "vec_id string, embedding array<double>")
    assert whitening.whiten(make([])).collect() == [] and whitening.whiten(make([("a", [1.0, 2.0])])).collect() == []
    assert whitening.whiten(make([("a", [1.0, 2.0]), ("b", [1.0, 2.0]), (None, [])]).where("vec_id is not null")).collect() == []
    got = whitening.whiten(make([("a", [0.0, 5.0]), ("a", [1.0, 5.0]), (None, [2.0, 5.0])])).collect()
    assert [r.component for r in got] == [1, 1, 1] and sorted(abs(r.whitened) for r in got) == pytest.approx([0, math.sqrt(1.5), math.sqrt(1.5)])
    assert [r.explained for r in got] == [1, 1, 1] and sorted(r.deviation for r in got) == [0, 192**2, 192**2]


def test_large_entries_stay_exact(spark):
    rows = [(0, [1e12, 0.0]), (1, [-1e12, 1.0]), (2, [0.0, 3.0])]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert all(r.deviation is None for r in got if r.vec_id < 2)
    n, dev, *_ = brute([v for _, v in rows])
    assert {r.deviation for r in got if r.vec_id == 2} == {dev[2]}

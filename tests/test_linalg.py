"""Matrix products with frequent inner keys."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tallygrid.operators import linalg


def test_product_with_a_frequent_key(spark):
    rng = np.random.default_rng(3)
    a, b = np.zeros((300, 12)), np.zeros((12, 200))
    for m in (a, b):
        m[rng.random(m.shape) < 0.1] = 2.0
    a[:, 4], b[4, :] = np.arange(300) + 1, np.arange(200) - 7  # one k holds most entries of both
    a[:, 5], b[5, :] = 1.0, 0.0  # frequent on one side only
    left = spark.createDataFrame([(int(i), int(k), float(a[i, k])) for i, k in zip(*np.nonzero(a))] + [(0, None, 5.0), (0, 0, 1.5), (0, 0, 2.5)], "i int, k int, v double")
    right = spark.createDataFrame([(int(k), int(j), float(b[k, j])) for k, j in zip(*np.nonzero(b))] + [(None, 0, 5.0)], "k int, j int, v double")
    a[0, 0] += 4.0
    want = a @ b
    for tile in (20, 2_000):
        got = np.zeros(want.shape)
        rows = linalg.matmul(left, right, tile).collect()
        for r in rows:
            got[r["i"], r["j"]] += r["v"]
        assert np.array_equal(got, want) and len(rows) == len({(r["i"], r["j"]) for r in rows})
    for side, entries in zip(linalg.tiles(left, right, 20), (300, 200)):
        sizes = side.groupBy("k", "__row", "__column").count().agg(F.max("count"), F.count(F.lit(1))).first()
        assert sizes[0] <= 50 < entries and sizes[1] >= 150
    assert linalg.matmul(left.limit(0), right).count() == 0

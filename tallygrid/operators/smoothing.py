"""Local and spline smoothing on a grid."""

from __future__ import annotations

import json
from collections.abc import Sequence

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallygrid.operators.frames import double_array, grid_position, grid_values
from tallygrid.operators.gram import complete_rows
from tallygrid.operators.ordered import exact_quantiles, prefix_sums


#: Even bins of x that bracket neighbour distances.
BINS = 4096


def _bandwidths(rows: DataFrame, points: Sequence[float], k: int, n: int) -> list[float]:
    """Distance from each grid point to its k-th nearest row.

    Counts in even bins of x bracket the distance and say how many rows are surely nearer. Only rows between meet
    the grid point; they are a few bins' worth, and the distance is found among them exactly.
    Rows below the first or above the last point lie in the two outer bins, which reach as far as they do.
    """
    lo, hi = points[0], points[-1]
    width = (hi - lo) / BINS
    place = F.least(F.greatest(F.floor((F.col("x") - lo) / width), F.lit(0)), F.lit(BINS - 1)).cast("int")
    counts, ends = np.zeros(BINS), [lo, hi]
    for r in rows.groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("low"), F.max("x").alias("high")).collect():
        counts[r["bin"]] = r["n"]
        ends = [min(ends[0], r["low"]), max(ends[1], r["high"])]
    slack = 1e-9 * (ends[1] - ends[0])
    left, right = lo + width * np.arange(BINS), lo + width * np.arange(1, BINS + 1)
    left[0], right[-1] = ends
    spots = []
    for i, g in enumerate(points):
        nearest = np.maximum(0, np.maximum(left - g, g - right)) - slack
        farthest = np.maximum(np.abs(left - g), np.abs(right - g)) + slack
        low, high = (d[o][np.searchsorted(np.cumsum(counts[o]), k)] for d in (nearest, farthest) for o in [np.argsort(d)])
        sure = np.flatnonzero(farthest < low)
        first, last = (int(sure[0]), int(sure[-1])) if len(sure) else (0, -1)
        spots.append((i, float(g), first, last, float(high), int(k - counts[sure].sum())))
    grid = F.from_json(F.lit(json.dumps([dict(zip(("i", "g", "first", "last", "high"), s)) for s in spots])), F.lit("array<struct<i:int,g:double,first:int,last:int,high:double>>"))
    binned = rows.withColumn("bin", place)
    open_ = lambda s: ~F.col("bin").between(s["first"], s["last"]) & (F.abs(F.col("x") - s["g"]) <= s["high"])
    far = binned.select("x", F.explode(F.filter(grid, open_)).alias("s")).select("s.i", F.abs(F.col("x") - F.col("s.g")).alias("d"))
    found = _kth(far, F.get(F.array(*[F.lit(s[-1]).cast("bigint") for s in spots]), F.col("i")))
    return [found[i] for i in range(len(points))]


def _kth(far: DataFrame, wanted) -> dict[int, float]:
    counts = far.groupBy("i", "d").agg(F.count(F.lit(1)).alias("c"))
    run = prefix_sums(counts, "d", {"cum": F.col("c")}, ["i"], source=far)
    hits = run.filter(F.col("cum") >= wanted).groupBy("i").agg(F.min("d").alias("h")).collect()
    return {r["i"]: r["h"] for r in hits}


def lowess_grid(df: DataFrame, x: str, y: str, frac: float = 0.6, n_grid: int = 50, robust: int = 3) -> DataFrame:
    """Locally weighted lines on an even grid over x, with bisquare reweighting passes.

    A row meets only the grid points whose neighbourhood holds it, inside its task,
    and each task returns five sums per grid point. Residuals between grid points
    use linear interpolation.
    """
    d = complete_rows(df, [x, y]).select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    facts = d.agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count(F.lit(1)).alias("n")).first()
    lo, hi, n = facts["lo"], facts["hi"], facts["n"]
    schema = "i int, x double, y_hat double"
    if not n or lo == hi:
        raise ValueError("x must vary")
    points = grid_values(lo, hi, n_grid)
    k = max(2, int(frac * n + 1e-10))
    d = d.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        reach = _bandwidths(d, points, k, n)
        widths = double_array([max(h, 1e-300) for h in reach])
        grid = F.transform(double_array(points), lambda g, i: F.struct(i.alias("i"), g.alias("g"), F.get(widths, i).alias("h")))
        weighted = d.withColumn("rw", F.lit(1.0))
        for step in range(robust + 1):
            fits = _local_lines(weighted, grid, n_grid)
            if step == robust:
                break
            resid = d.withColumn("r", F.abs(F.col("y") - _interpolate(fits, points, lo, hi)))
            scale = exact_quantiles(resid, ["r"], [0.5]).first()[0][0]
            if not scale:
                break
            u = F.col("r") / F.lit(6.0 * scale)
            weighted = resid.withColumn("rw", F.when(u < 1, F.pow(1 - u * u, F.lit(2.0))).otherwise(0.0))
    finally:
        d.unpersist()
    rows = [(i, g, v) for i, (g, v) in enumerate(zip(points, fits))]
    return df.sparkSession.createDataFrame(rows, schema)


def _local_lines(weighted: DataFrame, grid, n_grid: int) -> list[float]:
    near = F.filter(grid, lambda p: F.abs(F.col("x") - p["g"]) <= p["h"])
    rows = weighted.select("x", "y", "rw", F.inline(near))
    t = F.abs(F.col("x") - F.col("g")) / F.col("h")
    cube = 1 - t * t * t
    w = F.col("rw") * cube * cube * cube
    u = F.col("x") - F.col("g")
    sums = rows.select("i", w.alias("w"), u.alias("u"), "y").groupBy("i").agg(
        F.sum("w").alias("w"),
        F.sum(F.col("w") * F.col("u")).alias("wu"),
        F.sum(F.col("w") * F.col("y")).alias("wy"),
        F.sum(F.col("w") * F.col("u") * F.col("u")).alias("wuu"),
        F.sum(F.col("w") * F.col("u") * F.col("y")).alias("wuy"),
    )
    out: list[float] = [float("nan")] * n_grid
    for r in sums.collect():
        if r["w"] <= 0:
            continue
        mean_u, mean_y = r["wu"] / r["w"], r["wy"] / r["w"]
        spread = r["wuu"] / r["w"] - mean_u * mean_u
        slope = (r["wuy"] / r["w"] - mean_u * mean_y) / spread if spread > 1e-12 * max(r["wuu"] / r["w"], 1e-300) else 0.0
        out[r["i"]] = mean_y - slope * mean_u
    return out


def _interpolate(fits: Sequence[float], points: Sequence[float], lo: float, hi: float):
    n = len(points)
    at = F.least(F.greatest(grid_position(F.col("x"), lo, hi, n) - 1, F.lit(0)), F.lit(n - 2))
    g, v = double_array(points), double_array(fits)
    share = (F.col("x") - F.get(g, at)) / F.lit((hi - lo) / (n - 1))
    return F.get(v, at) + share * (F.get(v, at + 1) - F.get(v, at))


# Cubic B-spline pieces on [0, 1], rows of coefficients of 1, u, u², u³ (fixed values).
_PIECES = np.array([[1, -3, 3, -1], [4, 0, -6, 3], [1, 3, 3, -3], [0, 0, 0, 1]]) / 6.0


def spline_fit(df: DataFrame, x: str, y: str, df_target: float = 10.0, intervals: int = 40, n_grid: int = 100) -> DataFrame:
    """Penalized cubic spline with the given degrees of freedom, evaluated on an even grid.

    Rows collapse to power sums per knot interval (eleven numbers each), from which
    the normal equations follow exactly; the penalty is found on the driver.
    """
    d = complete_rows(df, [x, y]).select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    facts = d.agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.avg("y").alias("mean")).first()
    lo, hi = facts["lo"], facts["hi"]
    if lo is None or lo == hi:
        raise ValueError("x must vary")
    width = (hi - lo) / intervals
    at = F.least(F.floor((F.col("x") - lo) / width).cast("int"), F.lit(intervals - 1))
    local = d.select(at.alias("j"), ((F.col("x") - lo) / width - at).alias("u"), (F.col("y") - facts["mean"]).alias("y"))
    power = [F.pow("u", F.lit(float(i))) for i in range(7)]
    sums = local.groupBy("j").agg(
        *[F.sum(power[i]).alias(f"u{i}") for i in range(7)], *[F.sum(power[i] * F.col("y")).alias(f"y{i}") for i in range(4)]
    ).collect()
    size = intervals + 3
    gram, rhs, penalty = np.zeros((size, size)), np.zeros(size), np.zeros((size, size))
    for r in sums:
        hankel = np.array([[r[f"u{a + b}"] for b in range(4)] for a in range(4)])
        s = slice(r["j"], r["j"] + 4)
        gram[s, s] += _PIECES @ hankel @ _PIECES.T
        rhs[s] += _PIECES @ np.array([r[f"y{a}"] for a in range(4)])
    c2, c3 = _PIECES[:, 2], _PIECES[:, 3]
    bend = 4 * np.outer(c2, c2) + 6 * (np.outer(c2, c3) + np.outer(c3, c2)) + 12 * np.outer(c3, c3)
    for j in range(intervals):
        penalty[j : j + 4, j : j + 4] += bend
    ratio = np.trace(gram) / np.trace(penalty)

    def solve(log_l: float) -> tuple[float, np.ndarray]:
        m = gram + ratio * 10.0**log_l * penalty
        return float(np.trace(np.linalg.lstsq(m, gram, rcond=None)[0])), m

    low, high = -9.0, 9.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if solve(mid)[0] > df_target else (low, mid)
    log_l = (low + high) / 2
    used, m = solve(log_l)
    coef = np.linalg.lstsq(m, rhs, rcond=None)[0]
    rows = []
    for i, g in enumerate(grid_values(lo, hi, n_grid)):
        j = min(int((g - lo) / width), intervals - 1)
        u = (g - lo) / width - j
        basis = _PIECES @ np.array([1.0, u, u * u, u**3])
        rows.append((i, float(g), float(basis @ coef[j : j + 4] + facts["mean"]), used, float(ratio * 10.0**log_l)))
    return df.sparkSession.createDataFrame(rows, "i int, x double, y_hat double, df double, penalty double")

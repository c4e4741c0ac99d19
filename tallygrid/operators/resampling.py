"""Bootstrap intervals and replicate summaries."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallygrid.operators.evaluation import confusion_counts


def _metric(name: str, tp: np.ndarray, fp: np.ndarray, tn: np.ndarray, fn: np.ndarray) -> np.ndarray:
    def share(a, b):
        return np.divide(a, b, out=np.zeros(len(a)), where=b != 0)

    forms = {
        "accuracy": lambda: share(tp + tn, tp + fp + tn + fn),
        "precision": lambda: share(tp, tp + fp),
        "recall": lambda: share(tp, tp + fn),
        "f1": lambda: share(2 * tp, 2 * tp + fp + fn),
    }
    if name not in forms:
        raise ValueError(f"unknown metric {name!r}; choose from {sorted(forms)}")
    return forms[name]()


def bootstrap_ci(df: DataFrame, label: str, pred: str, metric: str = "f1", B: int = 1000, seed: int = 42) -> DataFrame:
    """Mean and 2.5/97.5 percentiles of a metric over B resamples.

    The metrics depend on the four counts only, and resampling rows draws those
    counts from a multinomial distribution: one aggregate replaces B passes.
    """
    c = confusion_counts(df, label, pred).first()
    counts = np.array([c["tp"], c["fp"], c["tn"], c["fn"]], float)
    n = int(counts.sum())
    if n == 0:
        raise ValueError("no rows")
    draws = np.random.default_rng(seed).multinomial(n, counts / n, size=B).astype(float)
    values = _metric(metric, *draws.T)
    lo, hi = np.percentile(values, [2.5, 97.5])
    row = (metric, B, float(values.mean()), float(lo), float(hi))
    return df.sparkSession.createDataFrame([row], "metric string, B int, mean double, ci_low double, ci_high double")


def bootstrap_means(df: DataFrame, col: str, row_id: str, B: int = 100, seed: int = 42, by: Sequence[str] = ()) -> DataFrame:
    """Mean of ``col`` in B Poisson(1) resamples: one row per (by, replicate).

    Weights come from a hash of row and replicate, so they repeat under any
    partitioning; tasks send two sums per replicate.
    """
    # 53 bits of the hash as a number in [0, 1).
    u = F.shiftrightunsigned(F.xxhash64(F.col(row_id), F.col("replicate"), F.lit(seed)), 11) / F.lit(float(1 << 53))
    steps, p, total = [], float(np.exp(-1.0)), 0.0
    for k in range(1, 19):
        total += p
        steps.append((u >= total).cast("int"))
        p /= k
    weight = sum(steps[1:], steps[0])
    rows = df.select(*by, row_id, F.col(col).cast("double").alias("v"), F.explode(F.sequence(F.lit(1), F.lit(B))).alias("replicate"))
    weighted = rows.withColumn("w", weight).filter(F.col("v").isNotNull())
    return weighted.groupBy(*by, "replicate").agg(
        (F.sum(F.col("w") * F.col("v")) / F.nullif(F.sum("w"), F.lit(0))).alias("estimate")
    )


def bias_variance(df: DataFrame, est: str, truth: str, by: Sequence[str] = ()) -> DataFrame:
    """Squared bias, sample variance and mean squared error of estimates around a known truth."""
    e, t = F.col(est), F.col(truth)
    out = df.groupBy(*by).agg(
        F.count(F.lit(1)).cast("bigint").alias("n"),
        F.avg(e - t).alias("bias"),
        F.var_samp(e).alias("variance"),
        F.avg((e - t) * (e - t)).alias("mse"),
    )
    return out.select(*by, "n", (F.col("bias") * F.col("bias")).alias("bias2"), "variance", "mse")

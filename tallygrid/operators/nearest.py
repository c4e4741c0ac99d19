"""Exact nearest neighbours, and regression and classification on top.

On one numeric feature, neighbours are adjacent in order: both tables are cut into
the same value cells, each holding at least k train rows, and a cell needs only the
k nearest rows of the cells beside it. Several features are searched by cells of pivots
(see ``pivots``): bounds from the triangle inequality leave out cells, and rows of cells,
that cannot hold a neighbour. Row pairs never leave a task.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallygrid.operators.ordered import in_cells, rows_per_task, value_cells
from tallygrid.operators.pivots import Metric, pivot_search
from tallygrid.operators.windows import nearest_rank


def euclidean(q: np.ndarray, t: np.ndarray) -> np.ndarray:
    total = np.zeros((len(q), len(t)))
    for j in range(q.shape[1]):
        gap = q[:, j, None] - t[None, :, j]
        total += gap * gap
    return np.sqrt(total)


def absolute(q: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Sum of absolute differences; in one dimension the plain distance."""
    total = np.zeros((len(q), len(t)))
    for j in range(q.shape[1]):
        total += np.abs(q[:, j, None] - t[None, :, j])
    return total


DISTANCES: dict[str, Metric] = {"euclidean": euclidean, "absolute": absolute}


def _metric(distance: str | Metric) -> Metric:
    if callable(distance):
        return distance
    if distance not in DISTANCES:
        raise ValueError(f"unknown distance {distance!r}; choose from {sorted(DISTANCES)}")
    return DISTANCES[distance]


def vector(df: DataFrame, features: str | Sequence[str]) -> Column:
    """One array column, or several numeric columns as an array of doubles."""
    if isinstance(features, str) and df.schema[features].dataType.typeName() == "array":
        return F.col(features).cast("array<double>")
    cols = [features] if isinstance(features, str) else list(features)
    return F.array(*[F.col(c).cast("double") for c in cols])


def nearest(
    train: DataFrame,
    query: DataFrame,
    features: str | Sequence[str],
    k: int,
    train_id: str,
    query_id: str,
    carry: Sequence[str] = (),
    distance: str | Metric = "euclidean",
    exclude: str | None = None,
    train_block: int = 2_000,
    query_block: int = 20_000,
) -> DataFrame:
    """(query_id, rank, train_id, distance, carried train columns): k nearest, ties by train id.

    ``exclude`` names a column of both tables; train rows that share its value with
    the query (its own fold, say) do not count. ``train_block`` is the number of rows
    wanted in a cell. A callable ``distance`` need not keep the triangle inequality,
    so every pair is scored with it.
    """
    if isinstance(features, str) or len(features) == 1:
        column = features if isinstance(features, str) else features[0]
        if exclude is None and distance in ("euclidean", "absolute") and train.schema[column].dataType.typeName() != "array":
            return _nearest_on_line(train, query, column, k, train_id, query_id, carry)
    extra = [exclude] if exclude else []
    t = train.select(F.col(train_id).alias("id"), vector(train, features).alias("v"), F.struct(F.lit(0).alias("__"), *carry).alias("c"), *[F.col(c).alias("ex") for c in extra])
    q = query.select(F.col(query_id).alias("id"), vector(query, features).alias("v"), *[F.col(c).alias("ex") for c in extra])
    known = not callable(distance)
    ranked = pivot_search(t, q, k, _metric(distance), known, distance == "euclidean", ["c"], train_block, query_block)
    return ranked.select(
        F.col("qid").alias(query_id), "rank", F.col("tid").alias("neighbour"), F.col("d").alias("distance"), *[F.col(f"c.{c}").alias(c) for c in carry]
    )


def _merged_cells(train_counts: Sequence[int], query_counts: Sequence[int], k: int, limit: int) -> tuple[list[int], list[int]]:
    """Join adjacent cells until each has k train rows; copies per cell that keep queries in bounds."""
    merged, have = [], []
    for n in train_counts:
        if not have or have[-1] >= k:
            have.append(0)
        have[-1] += n
        merged.append(len(have) - 1)
    if len(have) > 1 and have[-1] < k:
        merged = [min(m, len(have) - 2) for m in merged]
    asked = [0] * (merged[-1] + 1)
    for m, n in zip(merged, query_counts):
        asked[m] += n
    return merged, [max(1, math.ceil(n / limit)) for n in asked]


def _nearest_on_line(
    train: DataFrame, query: DataFrame, x: str, k: int, train_id: str, query_id: str, carry: Sequence[str]
) -> DataFrame:
    def number(df: DataFrame, *cols: Column) -> DataFrame:
        d = df.select(F.col(x).cast("double").alias("x"), *cols)
        return d.filter(F.col("x").isNotNull() & ~F.isnan("x"))

    t = number(train, F.col(train_id).alias("tid"), F.struct(F.lit(0).alias("__"), *carry).alias("c"))
    # Of equal values only the k smallest ids can be chosen, so a frequent value stays small.
    w = Window.partitionBy("x").orderBy("tid")
    t = t.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= k).drop("rn")
    q = number(query, F.col(query_id).alias("qid"))
    asked = q.select("x").distinct()
    spots = number(train).unionByName(number(query))
    limit = max(1, rows_per_task(spots))
    points, cells = value_cells(spots, "x")
    tc = {r[0]: r[1] for r in in_cells(t, "x", points, "b").groupBy("b").count().collect()}
    qc = {r[0]: r[1] for r in in_cells(asked, "x", points, "b").groupBy("b").count().collect()}
    merged, copies = _merged_cells([tc.get(i, 0) for i in range(cells)], [qc.get(i, 0) for i in range(cells)], k, limit)

    def placed(df: DataFrame) -> DataFrame:
        lookup = F.expr("array(" + ", ".join(map(str, merged)) + ")")
        return in_cells(df, "x", points, "b").withColumn("cell", F.get(lookup, F.col("b"))).drop("b")

    def copies_of(cell: Column) -> Column:
        return F.get(F.expr("array(" + ", ".join(map(str, copies)) + ")"), cell)

    home = placed(t)
    if len(copies) > 1:
        low = Window.partitionBy("cell").orderBy(F.asc("x"), "tid")
        high = Window.partitionBy("cell").orderBy(F.desc("x"), "tid")
        last = len(copies) - 1
        down = home.withColumn("rn", F.row_number().over(low)).filter((F.col("rn") <= k) & (F.col("cell") > 0))
        up = home.withColumn("rn", F.row_number().over(high)).filter((F.col("rn") <= k) & (F.col("cell") < last))
        home = home.unionByName(down.drop("rn").withColumn("cell", F.col("cell") - 1)).unionByName(
            up.drop("rn").withColumn("cell", F.col("cell") + 1)
        )
    right = home.withColumn("copy", F.explode(F.sequence(F.lit(0), copies_of(F.col("cell")) - 1)))
    left = placed(asked).withColumn("copy", F.pmod(F.xxhash64("x"), copies_of(F.col("cell"))).cast("int"))

    def best(qp: pd.DataFrame, tp: pd.DataFrame) -> pd.DataFrame:
        names = ["qx", "tid", "d", "c"]
        if qp.empty or tp.empty:
            return pd.DataFrame(columns=names)
        tp = tp.sort_values(["x", "tid"], kind="stable").reset_index(drop=True)
        tx, tids = tp["x"].to_numpy(), tp["tid"].to_numpy()
        rank = np.argsort(np.argsort(tids, kind="stable"), kind="stable")
        parts = []
        # A run of equal values has at most k rows, so 2k positions on each side hold the k nearest.
        reach = np.arange(-2 * k, 2 * k)
        chunk = max(1, 1_000_000 // len(reach))
        for s in range(0, len(qp), chunk):
            qx = qp["x"].to_numpy()[s : s + chunk]
            at = np.searchsorted(tx, qx)[:, None] + reach[None, :]
            inside = (at >= 0) & (at < len(tx))
            at = np.clip(at, 0, len(tx) - 1)
            d = np.where(inside, np.abs(tx[at] - qx[:, None]), np.inf)
            order = np.lexsort((rank[at], d), axis=1)[:, :k]
            dist, pick = np.take_along_axis(d, order, 1), np.take_along_axis(at, order, 1)
            r, j = np.nonzero(np.isfinite(dist))
            rows = tp.iloc[pick[r, j]]
            parts.append(pd.DataFrame({"qx": qx[r], "tid": rows["tid"].to_numpy(), "d": dist[r, j], "c": rows["c"].to_numpy()}))
        return pd.concat(parts, ignore_index=True)

    kinds = dict(t.dtypes)
    found = left.groupBy("cell", "copy").cogroup(right.groupBy("cell", "copy")).applyInPandas(
        best, f"qx double, tid {kinds['tid']}, d double, c {kinds['c']}"
    )
    ranked = nearest_rank(found, "qx", "d", "tid", k).withColumnsRenamed({"d": "distance", "tid": "neighbour"})
    out = q.join(ranked, F.col("x") == F.col("qx"))
    return out.select(F.col("qid").alias(query_id), "rank", "neighbour", "distance", *[F.col(f"c.{c}").alias(c) for c in carry])


def knn_regress(
    train: DataFrame,
    query: DataFrame,
    features: str | Sequence[str],
    y: str,
    ks: Sequence[int],
    train_id: str,
    query_id: str,
    distance: str | Metric = "euclidean",
    **blocks: int,
) -> DataFrame:
    """Mean y of the k nearest train rows for several k from one search."""
    near = nearest(train, query, features, max(ks), train_id, query_id, [y], distance, **blocks)
    wide = near.groupBy(query_id).agg(*[F.avg(F.when(F.col("rank") <= k, F.col(y))).alias(f"k{k}") for k in ks])
    return wide.unpivot([query_id], [f"k{k}" for k in ks], "k", "y_hat").withColumn("k", F.regexp_replace("k", "^k", "").cast("int"))


def knn_vote(near: DataFrame, query_id: str, label: str, ks: Sequence[int]) -> DataFrame:
    """Majority label among the k nearest for every k; ties go to the smallest label."""
    listed = F.array(*[F.lit(k) for k in ks])
    each = near.select(query_id, "rank", label, F.explode(listed).alias("k")).filter(F.col("rank") <= F.col("k"))
    votes = each.groupBy(query_id, "k", label).agg(F.count(F.lit(1)).alias("n"))
    return votes.groupBy(query_id, "k").agg(F.min_by(label, F.struct((-F.col("n")).alias("v"), F.col(label))).alias("pred"))


def knn_cv_predictions(
    df: DataFrame, features: str | Sequence[str], label: str, fold: str, ks: Sequence[int], row_id: str, **blocks: int
) -> DataFrame:
    """(id, fold, actual, k, pred): each row voted on by the rows of the other folds."""
    missing = [c for c in (label, fold, row_id) if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    near = nearest(df, df, features, max(ks), row_id, row_id, [label], exclude=fold, **blocks)
    votes = knn_vote(near, row_id, label, ks)
    return df.select(row_id, fold, F.col(label).alias("actual")).join(votes, row_id)


def knn_cv(df: DataFrame, features: str | Sequence[str], label: str, fold: str, ks: Sequence[int], row_id: str) -> DataFrame:
    """Error and accuracy per k."""
    preds = knn_cv_predictions(df, features, label, fold, ks, row_id)
    wrong = (F.col("pred") != F.col("actual")).cast("double")
    return preds.groupBy("k").agg(F.avg(wrong).alias("error"), F.avg(1 - wrong).alias("accuracy"))


__all__ = ["DISTANCES", "knn_cv", "knn_cv_predictions", "knn_regress", "knn_vote", "nearest"]

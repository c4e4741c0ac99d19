"""Deviations, trajectories, lift, folds, ranks and calculus along an order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallygrid.functions.scalars import ratio
from tallygrid.operators.ordered import (
    attach_scalars,
    average_ranks,
    join_on_keys,
    neighbours,
    prefix_sums,
    row_numbers,
)


def demean(df: DataFrame, key: str, cols: Sequence[str], suffix: str = "_dev") -> DataFrame:
    """Deviation from the group mean. Means are aggregated and joined, so a hot group can be split."""
    means = df.groupBy(key).agg(*[F.avg(c).alias(f"__mean_{c}") for c in cols])
    out = join_on_keys(df, means, [key])
    return out.withColumns({c + suffix: F.col(c) - F.col(f"__mean_{c}") for c in cols}).drop(*[f"__mean_{c}" for c in cols])


def trajectory(df: DataFrame, key: str, order: str, x: str, y: str) -> DataFrame:
    """Each entity's points in order, with the step from the previous one and first/last marks."""
    near = neighbours(df.select(key, order, x, y), order, [x, y], [key])
    return near.select(
        key,
        order,
        x,
        y,
        F.col("prev").isNull().alias("is_first"),
        F.col("next").isNull().alias("is_last"),
        (F.col(x) - F.col(f"prev.{x}")).alias("dx"),
        (F.col(y) - F.col(f"prev.{y}")).alias("dy"),
    )


def cumulative_lift(df: DataFrame, prob: str, label: str, row_id: str) -> DataFrame:
    """Per row, best score first: positives so far over those a random order would give."""
    base = df.agg(F.avg(F.col(label).cast("double")).alias("rate"))
    slim = df.select(row_id, prob, label)
    run = prefix_sums(
        slim, prob, {"rank": F.lit(1).cast("bigint"), "cum_positive": F.col(label).cast("bigint")}, tie=row_id, descending=True
    )
    out = attach_scalars(run, base, "__b")
    lift = ratio(F.col("cum_positive").cast("double"), F.col("rank") * F.col("__b.rate"))
    return out.select(row_id, prob, F.col("rank").cast("bigint"), F.col("cum_positive").cast("bigint"), lift.alias("lift"))


def hash_ranks(df: DataFrame, by: Sequence[str], row_id: str, seed: int | Column, out: str, size: str) -> DataFrame:
    """Rank of each row in its group's hash order, and the group size.

    The top bits of the hash spread rows evenly over 16 384 cells, so no cut points are
    needed; a hot group is ranked by many tasks at once.
    """
    by = list(by)
    seed = seed if isinstance(seed, Column) else F.lit(seed)
    hashed = df.withColumn("__h", F.xxhash64(F.col(row_id), seed))
    cells = hashed.withColumn("__c", F.shiftright(F.col("__h"), 50))
    totals = cells.groupBy(*by, "__c").agg(F.count(F.lit(1)).alias("__n"))
    group = Window.partitionBy(*by)
    before = group.orderBy("__c").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *by, "__c", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__o"), F.sum("__n").over(group).alias(size)
    )
    joined = join_on_keys(cells, offsets, [*by, "__c"])
    rank = F.row_number().over(Window.partitionBy(*by, "__c").orderBy("__h", row_id))
    return joined.withColumn(out, (F.col("__o") + rank).cast("bigint")).drop("__h", "__c", "__o")


def stratified_folds(df: DataFrame, label: str, row_id: str, k: int, seed: int = 42, out: str = "fold") -> DataFrame:
    """Folds 0 … k-1, balanced within each class to one row, the same under any partitioning."""
    ranked = hash_ranks(df, [label], row_id, seed, "__r", "__size")
    return ranked.withColumn(out, ((F.col("__r") - 1) % k).cast("int")).drop("__r", "__size")


def stratified_split(df: DataFrame, label: str, row_id: str, p: float, seed: int = 42, out: str = "is_train") -> DataFrame:
    """Mark floor(p·n) rows of each class as training rows."""
    ranked = hash_ranks(df, [label], row_id, seed, "__r", "__size")
    return ranked.withColumn(out, F.col("__r") <= F.floor(F.col("__size") * F.lit(p) + 1e-9)).drop("__r", "__size")


def average_rank(df: DataFrame, col: str, out: str = "rank") -> DataFrame:
    """Add the mean rank shared by equal values. Ranks are found per distinct value and joined back."""
    ranks = average_ranks(df, col, out).drop("n").withColumnRenamed(col, "__v")
    return df.join(ranks, F.col(col) == F.col("__v"), "left").drop("__v")


def nearest_rank(df: DataFrame, query: str, distance: str, tie: str, k: int, out: str = "rank") -> DataFrame:
    """The k closest rows per query. Spark cuts each partition to k per query before the shuffle."""
    w = Window.partitionBy(query).orderBy(F.col(distance), F.col(tie))
    return df.withColumn(out, F.row_number().over(w)).filter(F.col(out) <= k)


def integrate_table(df: DataFrame, x: str, y: str, by: Sequence[str] = (), tie: str | None = None) -> DataFrame:
    """Trapezoid integral of y over x per group."""
    near = neighbours(df, x, [x, y], by, tie)
    piece = (F.col(x) - F.col(f"prev.{x}")) * (F.col(y) + F.col(f"prev.{y}")) / 2
    return near.groupBy(*by).agg(F.coalesce(F.sum(piece), F.lit(0.0)).alias("integral"))


def derivative_table(df: DataFrame, x: str, y: str, by: Sequence[str] = (), tie: str | None = None, out: str = "dydx") -> DataFrame:
    """Central difference of y along x; NULL at the ends and for equal neighbours."""
    near = neighbours(df, x, [x, y], by, tie)
    slope = ratio(F.col(f"next.{y}") - F.col(f"prev.{y}"), F.col(f"next.{x}") - F.col(f"prev.{x}"))
    return near.withColumn(out, slope).drop("prev", "next")


__all__ = [
    "average_rank", "cumulative_lift", "demean", "derivative_table", "hash_ranks", "integrate_table",
    "nearest_rank", "row_numbers", "stratified_folds", "stratified_split", "trajectory",
]

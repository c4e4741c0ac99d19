"""Matrix products and gradients over tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


TILE = 2_000


def tiles(a: DataFrame, b: DataFrame, tile: int = TILE) -> tuple[DataFrame, DataFrame]:
    """Both factors with a row and a column of a grid for each ``k``; (k, row, column) meets about tile x tile entries at most.

    A k with more than ``tile`` entries on a side is frequent. Its entries of A are dealt to the rows of its grid by i and copied to every
    column, those of B to the columns by j and copied to every row, so each pair meets once. Every other k is one tile. Frequent k are
    looked up by (k, share of the entries), so that the look-up does not bring one k together either.
    """
    left = a.select("i", "k", F.col("v").alias("__a")).filter(F.col("k").isNotNull())
    right = b.select("k", "j", F.col("v").alias("__b")).filter(F.col("k").isNotNull())
    shares = int(a.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def count(df: DataFrame, out: str) -> DataFrame:
        return df.groupBy("k").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias(out))

    frequent = count(left, "__rows").join(count(right, "__columns"), "k", "full").fillna(1, ["__rows", "__columns"]).filter((F.col("__rows") > 1) | (F.col("__columns") > 1))
    frequent = frequent.withColumn("__share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))

    def dealt(df: DataFrame, place: str, own: str, other: str, own_size: str, other_size: str) -> DataFrame:
        known = df.withColumn("__share", F.pmod(F.hash(place), F.lit(shares))).join(frequent, ["k", "__share"], "left")
        at = F.pmod(F.xxhash64(place), F.coalesce(own_size, F.lit(1))).cast("int")
        copies = F.explode(F.sequence(F.lit(0), F.coalesce(other_size, F.lit(1)) - 1))
        return known.withColumn(own, at).withColumn(other, copies).drop("__share", "__rows", "__columns")

    return dealt(left, "i", "__row", "__column", "__rows", "__columns"), dealt(right, "j", "__column", "__row", "__columns", "__rows")


def matmul(a: DataFrame, b: DataFrame, tile: int = TILE) -> DataFrame:
    """Product of coordinate tables A(i, k, v) and B(k, j, v); frequent k are split into tiles, products are summed map-side.

    A place given more than once counts with the sum of its values; entries without k do not count.
    """
    left, right = tiles(a, b, tile)
    return left.join(right, ["k", "__row", "__column"]).groupBy("i", "j").agg(F.sum(F.col("__a") * F.col("__b")).alias("v"))


def logistic_gradient(df: DataFrame, features: Sequence[str], label: str, weights: Sequence[float]) -> DataFrame:
    """X'(σ(Xw) − y)/n, one row per feature, from one aggregate."""
    if len(features) != len(weights):
        raise ValueError("one weight per feature")
    z = sum((F.col(f) * F.lit(float(w)) for f, w in zip(features, weights)), F.lit(0.0))
    err = 1 / (1 + F.exp(-z)) - F.col(label).cast("double")
    one = df.agg(*[F.avg(F.col(f) * err).alias(f) for f in features])
    return one.unpivot([], list(features), "feature", "gradient")

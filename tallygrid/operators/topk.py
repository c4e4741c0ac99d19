"""Sorting, top-k, named subsets and sampling. Every top-k takes a tie-break key."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallygrid.functions.scalars import fold_key, fold_text
from tallygrid.operators.ordered import attach_scalars, exact_quantiles


def sort_by(df: DataFrame, cols: Mapping[str, bool]) -> DataFrame:
    """Sort by {column: ascending}; missing values last either way."""
    return df.orderBy(*[F.asc_nulls_last(c) if up else F.desc_nulls_last(c) for c, up in cols.items()])


def first_n(df: DataFrame, key: str, n: int = 5) -> DataFrame:
    return df.orderBy(F.asc_nulls_last(key)).limit(n)


def last_n(df: DataFrame, key: str, n: int = 5) -> DataFrame:
    return df.orderBy(F.desc_nulls_last(key)).limit(n)


def n_largest(df: DataFrame, col: str, n: int, tie: str) -> DataFrame:
    return df.dropna(subset=[col]).orderBy(F.desc(col), F.asc(tie)).limit(n)


def n_smallest(df: DataFrame, col: str, n: int, tie: str) -> DataFrame:
    return df.dropna(subset=[col]).orderBy(F.asc(col), F.asc(tie)).limit(n)


def top_per_group(df: DataFrame, key: str, col: str, n: int, tie: str, largest: bool = True) -> DataFrame:
    """n rows per group; the limit is applied inside each partition before the shuffle."""
    first = F.desc(col) if largest else F.asc(col)
    w = Window.partitionBy(key).orderBy(first, F.asc(tie))
    ranked = df.dropna(subset=[col]).withColumn("__rn", F.row_number().over(w))
    return ranked.filter(F.col("__rn") <= n).drop("__rn")


def group_landmarks(df: DataFrame, key: str, spread: str, level: str, tie: str) -> DataFrame:
    """Per group the rows with the lowest and highest ``spread`` and the highest ``level``, without repeats."""
    picks = [
        top_per_group(df, key, spread, 1, tie, largest=False),
        top_per_group(df, key, spread, 1, tie),
        top_per_group(df, key, level, 1, tie),
    ]
    return picks[0].unionByName(picks[1]).unionByName(picks[2]).distinct()


def metric_subsets(
    df: DataFrame, metric: str, row_id: str, name: str, aliases: Sequence[str] = (), k: int = 3, K: int = 10
) -> DataFrame:
    """Long table (subset, …): bottom/top k and K, k nearest the median of the rest, named rows.

    A subset with fewer than two rows is left out. The lowest and highest max(k, K)
    rows are taken once and reused; the named rows can be many and are never collected.
    """
    if metric not in df.columns:
        raise ValueError(f"unknown metric {metric!r}; columns are {df.columns}")
    d = df.dropna(subset=[metric])
    spark, most = df.sparkSession, max(k, K)
    low = spark.createDataFrame(n_smallest(d, metric, most, row_id).collect(), df.schema)
    high = spark.createDataFrame(n_largest(d, metric, most, row_id).collect(), df.schema)
    bottom, top = n_smallest(low, metric, k, row_id), n_largest(high, metric, k, row_id)
    rest = d.filter(~F.col(row_id).isin([r[row_id] for r in bottom.union(top).collect()]))
    centre = attach_scalars(rest, exact_quantiles(rest, [metric], [0.5]), "__m")
    gap = F.abs(F.col(metric) - F.col(f"__m.q_{metric}")[0])
    mid = centre.orderBy(gap, F.col(metric), F.col(row_id)).limit(k).drop("__m")
    parts = {
        f"bottom{k}": bottom,
        f"mid{k}": mid,
        f"top{k}": top,
        f"bottom{K}": n_smallest(low, metric, K, row_id),
        f"top{K}": n_largest(high, metric, K, row_id),
    }
    if aliases:
        wanted = sorted({fold_text(a) for a in aliases})
        parts["named"] = df.filter(fold_key(F.col(name)).isin(wanted))
    out = None
    for tag, part in parts.items():
        tagged = part.select(F.lit(tag).alias("subset"), *df.columns)
        out = tagged if out is None else out.unionByName(tagged)
    sizes = out.groupBy("subset").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= 2)
    return out.join(sizes, "subset", "left_semi")


def flag_extremes(df: DataFrame, x: str, y: str, resid: str, row_id: str, max_labels: int = 30) -> DataFrame:
    """Points worth a label: |residual| ≥ 2σ or x or y in an outer tenth, largest residuals first.

    At most 12 points. Without any flagged point: all of a table of up to 12 rows,
    else the 10 largest residuals.
    """
    edges = exact_quantiles(df, [x, y], [0.1, 0.9], extra=[F.stddev_samp(resid).alias("sigma")])
    d = attach_scalars(df, edges, "e")
    size = F.abs(F.col(resid))
    far = (F.col("e.sigma") > 0) & (size >= 2 * F.col("e.sigma"))

    def outer(c: str):
        q = F.col(f"e.q_{c}")
        return (F.col(c) <= q[0]) | (F.col(c) >= q[1])

    flagged = d.withColumn("flagged", F.coalesce(far | outer(x) | outer(y), F.lit(False))).drop("e")
    totals = flagged.agg(F.count(F.lit(1)).alias("n"), F.count_if("flagged").alias("hits"))
    marked = attach_scalars(flagged, totals, "t")
    allowed = (
        F.when(F.col("t.hits") > 0, F.lit(min(max_labels, 12)))
        .when(F.col("t.n") <= 12, F.lit(12))
        .otherwise(F.lit(min(max_labels, 10)))
    )
    best = (
        marked.withColumn("__allowed", allowed)
        .filter(F.col("flagged") | (F.col("t.hits") == 0))
        .drop("t")
        .orderBy(F.desc(F.abs(F.col(resid))), F.asc(row_id))
        .limit(12)
    )
    w = Window.partitionBy("__allowed").orderBy(F.desc(F.abs(F.col(resid))), F.asc(row_id))
    return best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= F.col("__allowed")).drop("__allowed")


def sample_n(df: DataFrame, row_id: str, n: int, seed: int = 42) -> DataFrame:
    """n rows by smallest seeded hash: repeatable under any partitioning."""
    return df.orderBy(F.xxhash64(F.col(row_id), F.lit(seed)), F.col(row_id)).limit(n)

"""Counts, grouped summaries, profiles, cross-tables and distributions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tallygrid.functions.scalars import ratio
from tallygrid.operators.frames import numeric_columns, share_true
from tallygrid.operators.joins import join_suffixed
from tallygrid.operators.ordered import (
    attach_scalars,
    exact_quantiles,
    join_on_keys,
)


def _rows() -> Column:
    return F.count(F.lit(1)).cast("bigint")


def _without_null_keys(df: DataFrame, keys: Sequence[str], dropna: bool) -> DataFrame:
    return df.dropna(subset=list(keys)) if dropna else df


def table_shape(df: DataFrame) -> DataFrame:
    return df.agg(_rows().alias("n_rows")).withColumn("n_cols", F.lit(len(df.columns)).cast("bigint"))


def count_by(df: DataFrame, keys: Sequence[str], sort: bool = True, dropna: bool = False) -> DataFrame:
    out = _without_null_keys(df, keys, dropna).groupBy(*keys).agg(_rows().alias("n"))
    return out.orderBy(F.desc("n"), *keys) if sort else out


def plain_numbers(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """NaN as NULL and -0.0 as 0.0 in the fractional columns among ``cols`` (default all)."""
    kinds = {f.name: f.dataType for f in df.schema}
    fractional = [c for c in (cols or kinds) if isinstance(kinds.get(c), (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(F.col(f"`{c}`")), F.col(f"`{c}`") + F.lit(0).cast(kinds[c])) for c in fractional})


def value_counts(df: DataFrame, col: str, dropna: bool = False) -> DataFrame:
    """Count and percentage per value. The total is summed from the counts, not from the rows."""
    counts = _without_null_keys(df, [col], dropna).groupBy(col).agg(_rows().alias("count"))
    total = attach_scalars(counts, counts.agg(F.sum("count").alias("n")), "__t")
    return total.select(col, "count", (F.col("count") * 100.0 / F.col("__t.n")).alias("pct"))


def distinct_values(df: DataFrame, col: str, n: int | None = None, dropna: bool = True) -> DataFrame:
    out = _without_null_keys(df.select(col), [col], dropna).distinct().orderBy(col)
    return out if n is None else out.limit(n)


def count_distinct(df: DataFrame, cols: Sequence[str], dropna: bool = True, approximate: bool = False) -> DataFrame:
    """Distinct values per column, one row per column; ``dropna=False`` counts NULL as a value. NaN counts as NULL."""
    df = plain_numbers(df, cols)
    if approximate:
        parts = [
            F.approx_count_distinct(c) + (F.lit(0) if dropna else F.coalesce(F.max(F.col(c).isNull().cast("int")), F.lit(0)))
            for c in cols
        ]
        one = df.agg(*[p.cast("bigint").alias(c) for p, c in zip(parts, cols)])
        return one.unpivot([], list(cols), "column", "n_distinct")
    return _column_values(df, cols).groupBy("column").agg(
        (F.count("value") if dropna else F.count(F.lit(1))).cast("bigint").alias("n_distinct")
    )


def _column_values(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, value, n) with long values replaced by a digest, so text does not travel."""

    def text(f: T.StructField) -> Column:
        s = F.col(f"`{f.name}`").cast("string")
        return F.when(F.length(s) > 64, F.concat(F.lit("#"), F.sha2(s, 256))).otherwise(s)

    fields = {f.name: f for f in df.schema}
    cells = F.array(*[F.struct(F.lit(c).alias("column"), text(fields[c]).alias("value")) for c in cols])
    return df.select(F.inline(cells)).groupBy("column", "value").agg(_rows().alias("n"))


def group_mean(df: DataFrame, keys: Sequence[str], cols: Sequence[str], dropna: bool = True) -> DataFrame:
    """Mean per group; also the pivot-table mean with an index only."""
    return _without_null_keys(df, keys, dropna).groupBy(*keys).agg(*[F.avg(c).alias(f"avg_{c}") for c in cols])


def group_mean_sd(df: DataFrame, keys: Sequence[str], cols: Sequence[str], where: Column | None = None) -> DataFrame:
    kept = df if where is None else df.filter(where)
    aggs = [a for c in cols for a in (F.avg(c).alias(f"mean_{c}"), F.stddev_samp(c).alias(f"sd_{c}"))]
    return kept.groupBy(*keys).agg(_rows().alias("n"), *aggs)


def brand_stats(df: DataFrame, keys: Sequence[str], qty: str, spend: str, dropna: bool = True) -> DataFrame:
    """People, totals, means and spend per unit of each group; one shuffle of partial sums."""
    out = _without_null_keys(df, keys, dropna).groupBy(*keys).agg(
        _rows().alias("n_people"),
        F.sum(qty).alias("total_qty"),
        F.avg(qty).alias("avg_qty"),
        F.sum(spend).alias("total_spend"),
        F.avg(spend).alias("avg_spend"),
    )
    return out.withColumn("spend_per_unit", ratio(F.col("total_spend"), F.col("total_qty"))).orderBy(
        F.desc_nulls_last("total_qty"), *keys
    )


def brand_stats_joined(
    facts: DataFrame, lookup: DataFrame, on: str, keys: Sequence[str], qty: str, spend: str, dropna: bool = True
) -> DataFrame:
    """``brand_stats`` of facts whose group sits in a lookup table with one row per ``on``.

    Facts are summed per join key before the join: a key with very many rows leaves
    each task as one row, and the join moves sums only.
    """
    per_key = facts.groupBy(on).agg(
        _rows().alias("n"), F.sum(qty).alias("q"), F.count(qty).alias("nq"), F.sum(spend).alias("s"), F.count(spend).alias("ns")
    )
    named = _without_null_keys(per_key.join(lookup.select(on, *keys), on), keys, dropna)
    sums = named.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("n", "q", "nq", "s", "ns")])
    return sums.select(
        *keys,
        F.col("n").alias("n_people"),
        F.col("q").alias("total_qty"),
        ratio(F.col("q"), F.col("nq")).alias("avg_qty"),
        F.col("s").alias("total_spend"),
        ratio(F.col("s"), F.col("ns")).alias("avg_spend"),
        ratio(F.col("s"), F.col("q")).alias("spend_per_unit"),
    ).orderBy(F.desc_nulls_last("total_qty"), *keys)


def top_groups(df: DataFrame, key: str, measure: str, n: int = 1, dropna: bool = True) -> DataFrame:
    sums = _without_null_keys(df, [key], dropna).groupBy(key).agg(F.sum(measure).alias("total"))
    return sums.orderBy(F.desc_nulls_last("total"), key).limit(n)


def stat_summary(df: DataFrame, col: str) -> DataFrame:
    """n, df, mean, median, variance and standard deviation (n-1) of one column."""
    df = plain_numbers(df, [col])
    extra = [
        F.count(col).cast("bigint").alias("n"),
        (F.count(col) - 1).cast("bigint").alias("df"),
        F.avg(col).alias("mean"),
        F.var_samp(col).alias("var"),
        F.stddev_samp(col).alias("sd"),
    ]
    out = exact_quantiles(df, [col], [0.5], extra=extra)
    return out.select("n", "df", "mean", F.col(f"q_{col}")[0].alias("median"), "var", "sd")


def describe(df: DataFrame, cols: Sequence[str] | None = None, extended: bool = False) -> DataFrame:
    """count, mean, std, min, quartiles, max per numeric column; ``extended`` adds cv and iqr."""
    cols = list(cols or numeric_columns(df))
    df = plain_numbers(df, cols)
    extra = []
    for c in cols:
        extra += [
            F.count(c).cast("bigint").alias(f"count_{c}"),
            F.avg(c).alias(f"mean_{c}"),
            F.stddev_samp(c).alias(f"std_{c}"),
            F.min(c).cast("double").alias(f"min_{c}"),
            F.max(c).cast("double").alias(f"max_{c}"),
        ]
    one = exact_quantiles(df, cols, [0.25, 0.5, 0.75], extra=extra)

    def record(c: str) -> Column:
        q = F.col(f"q_{c}")
        fields = [
            F.lit(c).alias("column"),
            F.col(f"count_{c}").alias("count"),
            F.col(f"mean_{c}").alias("mean"),
            F.col(f"std_{c}").alias("std"),
            F.col(f"min_{c}").alias("min"),
            q[0].alias("q25"),
            q[1].alias("median"),
            q[2].alias("q75"),
            F.col(f"max_{c}").alias("max"),
        ]
        if extended:
            fields += [ratio(F.col(f"std_{c}"), F.col(f"mean_{c}")).alias("cv"), (q[2] - q[0]).alias("iqr")]
        return F.struct(*fields)

    return one.select(F.inline(F.array(*[record(c) for c in cols])))


def null_profile(df: DataFrame) -> DataFrame:
    """dtype, nulls, non-nulls, distinct values (NULL counts as one) and percentage missing per column.

    NaN is missing too.
    """
    df = plain_numbers(df)
    types = dict(df.dtypes)
    lookup = F.create_map(*[x for c, t in types.items() for x in (F.lit(c), F.lit(t))])
    out = _column_values(df, df.columns).groupBy("column").agg(
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).cast("bigint").alias("nulls"),
        F.coalesce(F.sum(F.when(F.col("value").isNotNull(), F.col("n"))), F.lit(0)).cast("bigint").alias("non_nulls"),
        _rows().alias("n_distinct"),
    )
    pct = ratio(F.col("nulls") * 100.0, F.col("nulls") + F.col("non_nulls"))
    return out.select("column", lookup[F.col("column")].alias("dtype"), "nulls", "non_nulls", "n_distinct", pct.alias("pct_null"))


def profile_numbers_by(df: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """Per (key, variable): missing, completeness, mean, sd and the five quantiles."""
    cells = F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).cast("double").alias("value")) for c in cols])
    long = plain_numbers(df.select(key, F.inline(cells)), ["value"])
    extra = [
        F.count_if(F.col("value").isNull()).cast("bigint").alias("n_missing"),
        (F.count("value") / F.count(F.lit(1))).alias("complete_rate"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("sd"),
    ]
    out = exact_quantiles(long, ["value"], [0, 0.25, 0.5, 0.75, 1], [key, "variable"], extra)
    q = F.col("q_value")
    names = ("p0", "p25", "p50", "p75", "p100")
    return out.select(
        key, "variable", "n_missing", "complete_rate", "mean", "sd", *[q[i].alias(n) for i, n in enumerate(names)]
    )


def profile_categories_by(df: DataFrame, key: str, cols: Sequence[str], top: int = 3) -> DataFrame:
    """Per (key, variable): missing, completeness, distinct levels and the most frequent ones."""
    cells = F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).cast("string").alias("level")) for c in cols])
    counts = df.select(key, F.inline(cells)).groupBy(key, "variable", "level").agg(_rows().alias("n"))
    overall = counts.groupBy(key, "variable").agg(
        F.coalesce(F.sum(F.when(F.col("level").isNull(), F.col("n"))), F.lit(0)).cast("bigint").alias("n_missing"),
        F.coalesce(F.sum(F.when(F.col("level").isNotNull(), F.col("n"))) / F.sum("n"), F.lit(0.0)).alias("complete_rate"),
        F.count("level").cast("bigint").alias("n_distinct"),
    )
    w = Window.partitionBy(key, "variable").orderBy(F.desc("n"), "level")
    leaders = counts.filter(F.col("level").isNotNull()).withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= top)
    text = F.concat_ws(": ", "level", F.col("n").cast("string"))
    joined = leaders.groupBy(key, "variable").agg(F.sort_array(F.collect_list(F.struct("rn", text.alias("t")))).alias("l"))
    listed = joined.select(key, "variable", F.array_join(F.transform("l", lambda x: x["t"]), ", ").alias("top_levels"))
    return join_on_keys(overall, listed, [key, "variable"], "left")


def crosstab_long(df: DataFrame, row: str, col: str) -> DataFrame:
    """Shares of a row's total as (row, level, share), one row per pair that occurs; any number of levels."""
    counts = df.dropna(subset=[row, col]).groupBy(row, col).agg(_rows().alias("n"))
    totals = counts.groupBy(row).agg(F.sum("n").alias("total"))
    return join_on_keys(counts, totals, [row]).select(row, F.col(col).alias("level"), (F.col("n") / F.col("total")).alias("share"))


def crosstab_pct(df: DataFrame, row: str, col: str, levels: Sequence) -> DataFrame:
    """Row-normalized cross-table with one column for each of ``levels`` of ``col``; ``crosstab_long`` needs no levels."""
    clean = df.dropna(subset=[row, col])
    counts = clean.groupBy(row).pivot(col, list(levels)).agg(_rows())
    cells = {str(v): F.coalesce(F.col(f"`{v}`"), F.lit(0)) for v in levels}
    total = sum(cells.values(), F.lit(0))
    return counts.select(row, *[ratio(c.cast("double"), total).alias(n) for n, c in cells.items()])


def confusion_table(df: DataFrame, actual: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by, actual, pred).agg(_rows().alias("n"))


def quantiles(df: DataFrame, col: str, probs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Long table (by, p, value) of exact quantiles."""
    q = exact_quantiles(df, [col], probs, by)
    pairs = F.array(*[F.struct(F.lit(float(p)).alias("p"), F.col(f"q_{col}")[i].alias("value")) for i, p in enumerate(probs)])
    return q.select(*by, F.inline(pairs))


def entity_medians(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """One row per entity with the median of each column, over rows complete in all of them."""
    q = exact_quantiles(df.dropna(subset=[*keys, *cols]), cols, [0.5], keys)
    return q.select(*keys, *[F.col(f"q_{c}")[0].alias(c) for c in cols])


def cluster_summary(df: DataFrame, cluster: str, spread: str, others: Sequence[str]) -> DataFrame:
    """Size, median and quartiles of ``spread`` and medians of ``others`` per cluster."""
    q = exact_quantiles(df, [spread, *others], [0.25, 0.5, 0.75], [cluster], [_rows().alias("n")])
    s = F.col(f"q_{spread}")
    return q.select(
        cluster,
        "n",
        s[1].alias(f"med_{spread}"),
        s[0].alias(f"p25_{spread}"),
        s[2].alias(f"p75_{spread}"),
        *[F.col(f"q_{c}")[1].alias(f"med_{c}") for c in others],
    )


def _exact_decimal(df: DataFrame, col: str) -> Column:
    kind = df.select(col).schema[0].dataType
    if isinstance(kind, T.DecimalType):
        return F.col(col)
    return F.col(col).cast("decimal(19,0)" if isinstance(kind, T.IntegralType) else "decimal(18,9)")


def basket_totals(df: DataFrame, product: str, qty: str, price: str, tie: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Exact decimal totals of a basket. Decimal and whole-number columns keep their digits; other numbers are read with nine places.

    ``units`` counts a fractional quantity below one as one piece and cuts others to
    their whole part. The dearest product is the first one (by ``tie``) at the top price.
    """
    q, p = (_exact_decimal(df, c) for c in (qty, price))
    pieces = F.when(q < 1, F.lit(1)).otherwise(F.floor(q)).cast("decimal(18,0)")
    first = F.struct(p.alias("p"), (-F.col(tie)).alias("t")) if tie else F.struct(p.alias("p"))
    return df.groupBy(*by).agg(
        _rows().alias("n_rows"),
        F.sum(q * p).alias("total_value"),
        F.sum(pieces).cast("bigint").alias("units"),
        F.sum(pieces * p).alias("total_by_units"),
        F.max_by(product, first).alias("dearest"),
        F.max(p).alias("dearest_price"),
    )


def arg_max(df: DataFrame, label: str, measure: str, tie: str, by: Sequence[str] = ()) -> DataFrame:
    """Label of the largest measure; among equals the one with the smallest numeric ``tie``."""
    place = F.struct(F.col(measure), -F.col(tie))
    return df.filter(F.col(measure).isNotNull()).groupBy(*by).agg(F.max_by(label, place).alias(label), F.max(measure).alias(measure))


def majority_class(df: DataFrame, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Most frequent label (ties: smallest), its count and the error of always guessing it."""
    counts = df.groupBy(*by, label).agg(_rows().alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("neg"), F.col(label).alias("label")))
    out = counts.filter(F.col(label).isNotNull()).groupBy(*by).agg(best.alias("b"), F.sum("n").alias("total"))
    hits = -F.col("b.neg")
    return out.select(*by, F.col("b.label").alias("majority"), hits.alias("n"), (1 - hits / F.col("total")).alias("error"))


def discrepancy_rate(a: DataFrame, b: DataFrame, on: Sequence[str], col: str, tol: float = 0.10) -> DataFrame:
    """Units matched and the percentage whose relative difference exceeds ``tol``.

    A zero or missing base counts as a unit without discrepancy.
    """
    both = join_suffixed(a.select(*on, col), b.select(*on, col), on)
    rel = F.abs(F.col(f"{col}_2") - F.col(f"{col}_1")) / F.nullif(F.col(f"{col}_1").cast("double"), F.lit(0.0))
    return both.agg(_rows().alias("n_units"), (share_true(rel > tol) * 100).alias("pct_discrepant"))


def level_and_spread(tables: Mapping[str, DataFrame], cols: Sequence[str]) -> DataFrame:
    """Mean and sample sd of the same columns in several tables, one row per table."""
    out = None
    for tag, df in tables.items():
        aggs = [a for c in cols for a in (F.avg(c).alias(f"mean_{c}"), F.stddev_samp(c).alias(f"sd_{c}"))]
        row = df.agg(_rows().alias("n"), *aggs).withColumn("source", F.lit(tag))
        out = row if out is None else out.unionByName(row)
    return out


def histogram(df: DataFrame, col: str, bins: int = 20) -> DataFrame:
    """Equal-width bins from minimum to maximum, the last one closed; empty bins included.

    A constant column spreads half a unit to each side.
    """
    df = plain_numbers(df.select(F.col(col).cast("double").alias("v")))
    v = F.col("v")
    ends = df.agg(F.min(v).alias("lo"), F.max(v).alias("hi"), F.count(v).alias("n"))
    same = F.col("lo") == F.col("hi")
    ends = ends.select(
        F.when(same, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
        F.when(same, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"),
        "n",
    )
    rows = attach_scalars(df.select(v.alias("v")).filter(F.col("v").isNotNull()), ends, "e")
    width = (F.col("e.hi") - F.col("e.lo")) / bins
    guess = F.least(F.floor((F.col("v") - F.col("e.lo")) / width), F.lit(bins - 1))
    # Arithmetic may miss an edge by rounding; the edges themselves decide.
    down = (guess > 0) & (F.col("v") < F.col("e.lo") + guess * width)
    up = (guess < bins - 1) & (F.col("v") >= F.col("e.lo") + (guess + 1) * width)
    place = F.when(down, guess - 1).when(up, guess + 1).otherwise(guess)
    counts = rows.groupBy(place.alias("id")).agg(_rows().alias("n"))
    all_bins = attach_scalars(df.sparkSession.range(bins), ends, "e")
    out = all_bins.join(counts, "id", "left")
    n = F.coalesce(F.col("n"), F.lit(0)).cast("bigint")
    return out.select(
        F.col("id").alias("bin"),
        (F.col("e.lo") + F.col("id") * width).alias("lo"),
        (F.col("e.lo") + (F.col("id") + 1) * width).alias("hi"),
        n.alias("count"),
        (n / (F.col("e.n") * width)).alias("density"),
    )


def box_stats(df: DataFrame, key: str, col: str) -> DataFrame:
    """Quartiles, whiskers (last values within 1.5·IQR of the box) and outlier count per group."""
    slim = plain_numbers(df.select(key, F.col(col).cast("double").alias("v")), ["v"]).dropna(subset=["v"])
    q = exact_quantiles(slim, ["v"], [0.25, 0.5, 0.75], [key])
    box = q.select(key, F.col("q_v")[0].alias("q25"), F.col("q_v")[1].alias("median"), F.col("q_v")[2].alias("q75"))
    reach = 1.5 * (F.col("q75") - F.col("q25"))
    inside = F.col("v").between(F.col("q25") - reach, F.col("q75") + reach)
    # Values collapse before they meet the box edges, so a hot group stays small.
    values = slim.groupBy(key, "v").agg(_rows().alias("n"))
    return join_on_keys(values, box, [key]).groupBy(key).agg(
        F.sum("n").cast("bigint").alias("n"),
        F.max("q25").alias("q25"),
        F.max("median").alias("median"),
        F.max("q75").alias("q75"),
        F.min(F.when(inside, F.col("v"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("v"))).alias("whisker_high"),
        F.coalesce(F.sum(F.when(~inside, F.col("n"))), F.lit(0)).cast("bigint").alias("n_outliers"),
    )


#: exp(-z²/2) is 0 in doubles beyond this many bandwidths.
KERNEL_REACH = 38.7


def kde(df: DataFrame, col: str, n_grid: int = 1000) -> DataFrame:
    """Gaussian kernel density with bandwidth n^(-1/5)·sd on a grid half a range beyond the data.

    Equal values collapse first. A value meets only the grid points its kernel reaches, and each task adds kernels per
    grid point, so only grid-sized partial sums are shuffled.
    """
    slim = plain_numbers(df.select(F.col(col).cast("double").alias("v"))).filter(F.col("v").isNotNull())
    facts = slim.agg(
        F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("v").alias("n"), F.stddev_samp("v").alias("sd")
    )
    half = 0.5 * (F.col("f.hi") - F.col("f.lo"))
    start, step = F.col("f.lo") - half, 4 * half / (n_grid - 1)
    bandwidth = F.nullif(F.pow(F.col("f.n").cast("double"), F.lit(-0.2)) * F.col("f.sd"), F.lit(0.0))
    last = F.lit(n_grid - 1)
    first = F.greatest(F.floor((F.col("v") - KERNEL_REACH * bandwidth - start) / step), F.lit(0))
    until = F.least(F.ceil((F.col("v") + KERNEL_REACH * bandwidth - start) / step), last)
    values = attach_scalars(slim.groupBy("v").agg(_rows().alias("c")), facts, "f")
    rows = values.select("*", F.explode(F.sequence(first.cast("int"), until.cast("int"))).alias("i"))
    z = (start + F.col("i") * step - F.col("v")) / bandwidth
    kernel = F.exp(-0.5 * z * z) * F.col("c") / (bandwidth * F.col("f.n") * F.sqrt(2 * F.pi()))
    sums = rows.groupBy(F.col("i").cast("int").alias("at")).agg(F.sum(kernel).alias("sum"))
    grid = attach_scalars(df.sparkSession.range(n_grid).select(F.col("id").cast("int").alias("i")), facts, "f")
    density = F.when(bandwidth.isNotNull(), F.coalesce("sum", F.lit(0.0)))
    return grid.join(sums, F.col("i") == F.col("at"), "left").select("i", (start + F.col("i") * step).alias("x"), density.alias("density"))


def row_sums(df: DataFrame, arr: str, out: str = "row_sum") -> DataFrame:
    total = F.aggregate(F.col(arr), F.lit(0.0), lambda s, x: s + F.coalesce(x.cast("double"), F.lit(0.0)))
    return df.withColumn(out, total)


def limits(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.agg(*[a for c in cols for a in (F.min(c).alias(f"min_{c}"), F.max(c).alias(f"max_{c}"))])

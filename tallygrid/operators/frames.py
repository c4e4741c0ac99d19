"""Column selection, cleaning, recoding and derived columns: narrow, one stage each."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallygrid.functions.scalars import ratio
from tallygrid.operators.ordered import attach_scalars, exact_quantiles, row_numbers


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def select_numeric(df: DataFrame) -> DataFrame:
    return df.select(*numeric_columns(df))


def with_parity(df: DataFrame, col: str) -> DataFrame:
    """Add the square of an integer-valued column and whether value and square are even."""
    c = F.col(col).cast("bigint")
    return df.withColumns({"square": c * c, "is_even": c % 2 == 0, "square_is_even": (c * c) % 2 == 0})


def linear_score(a: Column, b: Column, intercept: float = 10.0, wa: float = 1.5, wb: float = 2.0) -> Column:
    return F.lit(intercept) + wa * a + wb * b


def unit_cost(spend: Column, per_day: Column, days: int = 30) -> Column:
    return ratio(spend, per_day * days)


def body_mass_index(weight: Column, height: Column) -> Column:
    return ratio(weight, height * height)


def packs(area: Column, cover: float = 3.0, pack: float = 18.0) -> Column:
    """Whole packs needed: area over coverage per unit, over units per pack, rounded up."""
    return F.ceil(area / cover / pack)


def pack_cost(area: Column, cover: float = 3.0, pack: float = 18.0, price: float = 80.0) -> Column:
    return packs(area, cover, pack) * F.lit(price)


def clean_and_feature(
    df: DataFrame, pct: str = "higher_ed_pct", total: str = "gdp", units: str = "population", area: str = "area"
) -> DataFrame:
    """Rows with positive sizes and a percentage from 0 to 100, with the logs of the sizes, the total per unit and its log.

    A comparison with NULL is never true, so one predicate also drops incomplete rows and reaches the scan.
    """
    sizes = {name: F.col(name).cast("double") for name in (total, units, area)}
    usable = F.col(pct).cast("double").between(0, 100)
    for size in sizes.values():
        usable = usable & (size > 0) & (size < float("inf"))
    logs = {f"log_{name}": F.log(size) for name, size in sizes.items()}
    each = {f"{total}_pc": sizes[total] / sizes[units], f"log_{total}_pc": logs[f"log_{total}"] - logs[f"log_{units}"]}
    return df.filter(usable).withColumns({pct: F.col(pct).cast("double")} | logs | each)


def recode(df: DataFrame, col: str, mapping: Mapping) -> DataFrame:
    """Replace the listed values of a column; others stay."""
    return df.replace(dict(mapping), subset=[col])


def zero_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(0).cast("double"))


def clip_low(c: Column, floor: float = 0.0, fill: float = 0.0) -> Column:
    """Values below ``floor`` raised to it, NULL replaced by ``fill``."""
    return F.coalesce(F.when(c.isNotNull(), F.greatest(c, F.lit(floor))), F.lit(fill))


def with_levels(df: DataFrame, col: str, levels: Sequence[str], out: str | None = None) -> DataFrame:
    """Declare an ordered category: values outside ``levels`` become NULL, ``<col>_rank`` counts from 1."""
    out = out or f"{col}_rank"
    rank = F.array_position(F.array(*[F.lit(v) for v in levels]), F.col(col))
    return df.withColumns({out: F.when(rank > 0, rank.cast("int")), col: F.when(rank > 0, F.col(col))})


def segment_by_quantiles(
    df: DataFrame,
    col: str,
    probs: Sequence[float] = (0.25, 0.75),
    labels: Sequence[str] = ("Light", "Moderate", "Heavy"),
    out: str = "segment",
) -> DataFrame:
    """Right-closed segments between exact quantiles; the first one takes its lower edge too."""
    if len(labels) != len(probs) + 1:
        raise ValueError("labels must be one more than probs")
    edges = exact_quantiles(df, [col], probs)
    marked = attach_scalars(df, edges, "__edges")
    case = F.when(F.col(col).isNull() | F.isnan(F.col(col).cast("double")), F.lit(None).cast("string"))
    for i, label in enumerate(labels[:-1]):
        case = case.when(F.col(col) <= F.col(f"__edges.q_{col}")[i], label)
    return marked.withColumn(out, case.otherwise(labels[-1])).drop("__edges")


def label_by_threshold(
    df: DataFrame, prob: str = "prob", thr: float = 0.5, pos: str = "yes", neg: str = "no", out: str = "pred"
) -> DataFrame:
    """``pos`` from the threshold upwards, else ``neg`` (a missing probability is ``neg``)."""
    return df.withColumn(out, F.when(F.col(prob) >= thr, pos).otherwise(neg))


def provided_label(df: DataFrame, col: str = "pred", aliases: Mapping[str, str] | None = None) -> DataFrame:
    """Keep a given label column, renaming alias spellings of the positive class."""
    return recode(df, col, aliases or {"sim": "yes"})


def share_true(cond: Column) -> Column:
    """Share of all rows meeting a condition; an unknown outcome counts as not met."""
    return F.avg(F.coalesce(cond, F.lit(False)).cast("double"))


def rename_prefixed(df: DataFrame, cols: Sequence[str], prefix: str | None) -> DataFrame:
    return df if not prefix else df.withColumnsRenamed({c: f"{prefix}_{c}" for c in cols})


def transpose_small(df: DataFrame, index: str) -> DataFrame:
    """Swap rows and columns of a short result table (Spark bounds the row count)."""
    return df.transpose(index)


def unpivot_years(df: DataFrame, ids: Sequence[str], years: Sequence[int], value: str = "value") -> DataFrame:
    """Wide year columns to (ids, year, value). Years without a column and empty cells are left out."""
    present = [str(y) for y in years if str(y) in df.columns]
    if not present:
        raise ValueError("none of the years is a column")
    numbers = df.select(*ids, *[F.col(f"`{y}`").cast("double").alias(y) for y in present])
    long = numbers.unpivot(list(ids), present, "year", value)
    return long.withColumn("year", F.col("year").cast("int")).dropna(subset=[value])


def reset_index(df: DataFrame, key: str, out: str = "index") -> DataFrame:
    """0-based position along a unique numeric key, computed in parallel."""
    return row_numbers(df, key, out).withColumn(out, F.col(out) - 1)


def number_grid(spark: SparkSession, lo: float, hi: float, n: int, name: str = "x") -> DataFrame:
    """n evenly spaced numbers from lo to hi, both included."""
    step = (hi - lo) / (n - 1)
    value = F.when(F.col("id") == n - 1, F.lit(float(hi))).otherwise(F.lit(float(lo)) + F.col("id") * F.lit(step))
    return spark.range(n).select(F.col("id").alias("i"), value.alias(name))


def double_array(values: Sequence[float]) -> Column:
    """A literal array of doubles, built in one call however long it is."""
    return F.expr("array(" + ", ".join(f"double('{float(v)!r}')" for v in values) + ")")


def grid_values(lo: float, hi: float, n: int) -> list[float]:
    step = (hi - lo) / (n - 1)
    return [lo + i * step for i in range(n - 1)] + [float(hi)]


def grid_position(value: Column, lo: float, hi: float, n: int) -> Column:
    """How many points of the grid lie at or below ``value`` (0 … n).

    Arithmetic gives the place up to rounding; comparing with the grid's own
    doubles on both sides makes it exact.
    """
    points = double_array(grid_values(lo, hi, n))
    step = (hi - lo) / (n - 1)
    guess = F.floor((value - lo) / step).cast("int") + 1
    guess = F.greatest(F.lit(0), F.least(F.lit(n), guess))
    up = (guess < n) & (value >= F.get(points, guess))
    down = (guess > 0) & (value < F.get(points, guess - 1))
    return F.when(up, guess + 1).when(down, guess - 1).otherwise(guess)

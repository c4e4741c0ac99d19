"""Order-based work that stays parallel: prefix sums, exact quantiles, ranks, neighbours.

A window without a partition key, or with one hot key, runs in a single task.
The functions here cut the order into cells instead, about one per
``tallygrid.rowsPerTask`` rows; a small table is one cell of the same plan. Cut
points come from a random sample of a few rows per cell, so a short list of
numbers reaches the driver, and every row's cell is a pure function of its own
values. Each cell is summed, the small table of cell totals is accumulated, and
the offsets go back to the rows of their cell. The sample decides how even the
cells are, never the result.

Orders and tie-breaks may be numbers, booleans, dates, timestamps or text. A
cell is found from a number that never decreases along the order; inside a cell
rows are sorted by their own values. An order value that repeats very often gets
a cell of its own, and that cell is cut again by the tie-break column.
"""

from __future__ import annotations

import bisect
import math
import os
from collections.abc import Mapping, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROWS_PER_TASK = 2_000_000
SAMPLE_PER_CELL = 24
#: Cells of wanted positions that are given to every task; each is one short row.
TARGET_ROWS = 20_000
#: Cells per doubling of a value, cells that a large one is cut into, and how often, at most: later cells are only less even.
PER_OCTAVE = 16
FINER = 1024
MAX_STEPS = 8
#: Whole numbers beyond this lose digits as doubles.
EXACT_DOUBLE = float(1 << 53)


def rows_per_task(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("tallygrid.rowsPerTask", str(ROWS_PER_TASK)))


def cells_for(df: DataFrame, rows: int) -> int:
    """Number of cells for so many rows; a limit of 0 asks for eight, for tests."""
    limit = rows_per_task(df)
    return 8 if limit <= 0 else max(1, math.ceil(rows / limit))


def join_on_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which a null key matches a null key; key columns appear once."""
    if not keys:
        raise ValueError("join_on_keys needs at least one key")
    renamed = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    cond = None
    for k in keys:
        c = left[k].eqNullSafe(renamed[f"__r_{k}"])
        cond = c if cond is None else cond & c
    return left.join(renamed, cond, how).drop(*[f"__r_{k}" for k in keys])


def attach_scalars(df: DataFrame, aggregate: DataFrame, name: str) -> DataFrame:
    """Add the single row of ``aggregate`` to every row as the struct column ``name``.

    Planned as a scalar subquery: no join, no driver round trip.
    """
    return df.withColumn(name, aggregate.select(F.struct("*")).scalar())


def _is_text(kind: T.DataType) -> bool:
    return isinstance(kind, (T.StringType, T.BinaryType))


def _as_number(c: Column, kind: T.DataType, skip: int = 0) -> Column:
    """A double that never decreases along the order of ``c``; of text, the six bytes after the first ``skip``."""
    if _is_text(kind):
        part = F.substring(c.cast("binary"), skip + 1, 6)
        return F.conv(F.rpad(F.hex(part), 12, "0"), 16, 10).cast("double")
    if isinstance(kind, T.DateType):
        return F.unix_date(c).cast("double")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(c.cast("timestamp")).cast("double")
    if isinstance(kind, T.BooleanType):
        return c.cast("int").cast("double")
    if isinstance(kind, T.NumericType):
        return c.cast("double")
    raise TypeError(f"cannot order by a column of type {kind.simpleString()}")


def _tells_apart(kind: T.DataType, value: float) -> bool:
    """Whether different values of the type near ``value`` have different doubles."""
    if isinstance(kind, T.DecimalType):
        return kind.precision <= 15
    return not _is_text(kind) and (isinstance(kind, (T.DoubleType, T.FloatType)) or abs(value) < EXACT_DOUBLE)


def _cuts(df: DataFrame, cols: Sequence[str]) -> tuple[list[Column], list[tuple[list[float], list[float]]]]:
    """Per column its number, and the distinct cut points with the values that fill whole cells alone.

    One count, which also finds the prefix that all texts share; a sample if there is more than one cell.
    """
    kinds = [df.schema[c].dataType for c in cols]
    texts = [c for c, kind in zip(cols, kinds) if _is_text(kind)]
    ends = [f(F.col(c).cast("binary")).alias(f"{name}_{c}") for c in texts for name, f in (("low", F.min), ("high", F.max))]
    facts = df.agg(F.count(F.lit(1)).alias("__rows"), *ends).first()
    skips = {c: len(os.path.commonprefix([bytes(facts[f"low_{c}"] or b""), bytes(facts[f"high_{c}"] or b"")])) for c in texts}
    numbers = [_as_number(F.col(c), kind, skips.get(c, 0)) for c, kind in zip(cols, kinds)]
    rows = facts["__rows"]
    cells = cells_for(df, rows)
    if cells == 1 or not rows:
        return numbers, [([], [])] * len(cols)
    picked = df.select(*[n.alias(f"k{i}") for i, n in enumerate(numbers)]).sample(min(1.0, SAMPLE_PER_CELL * cells / rows), seed=42).collect()
    out = []
    for i, kind in enumerate(kinds):
        values = sorted(r[i] for r in picked if r[i] is not None and math.isfinite(r[i]))
        seen: set[float] = set()
        hot: set[float] = set()
        for j in range(1, cells):
            if values:
                v = values[j * len(values) // cells]
                (hot if v in seen else seen).add(v)
        hot = {v for v in hot if _tells_apart(kind, v)}
        points = seen | {math.nextafter(v, math.inf) for v in hot}
        out.append((sorted(p for p in points if math.isfinite(p)), sorted(hot)))
    return numbers, out


def _bucket(df: DataFrame, expr: Column, points: Sequence[float], out: str, descending: bool = False) -> DataFrame:
    """Number of the interval between cut points; NaN sorts as the largest number and NULL comes last."""
    place, tmp = F.lit(0), f"{out}_in"
    cut = df.withColumn(tmp, expr)
    if points:
        splits = [-math.inf, *points, math.inf]
        cut = Bucketizer(splits=splits, inputCol=tmp, outputCol=out, handleInvalid="keep").transform(cut)
        place = F.col(out).cast("int")
    nan = -1 if descending else len(points) + 1
    place = F.when(F.col(tmp).isNull(), len(points) + 2).when(F.isnan(tmp), nan).otherwise(place)
    return cut.withColumn(out, place).drop(tmp)


def with_cells(df: DataFrame, order: str, tie: str | None = None, descending: bool = False, source: DataFrame | None = None) -> DataFrame:
    """Add ``__b`` and ``__s``: rows compare by (__b, __s) as they do by (order, tie).

    Counts and cut points come from ``source`` (default ``df``), which needs the same columns.
    """
    numbers, found = _cuts(df if source is None else source, [order] if tie is None else [order, tie])
    points, hot = found[0]
    if descending:
        points, hot = sorted(-p for p in points), sorted(-v for v in hot)
        points = sorted({*(p for p in points if math.nextafter(p, math.inf) not in hot), *hot, *(math.nextafter(v, math.inf) for v in hot)})
    out = _bucket(df, -numbers[0] if descending else numbers[0], points, "__b", descending)
    if tie is None or not hot:
        return out.withColumn("__s", F.lit(0))
    hot_cells = [bisect.bisect_left(points, v) + 1 for v in hot]
    is_hot = F.expr(f"__b IN ({', '.join(map(str, hot_cells))})")
    out = _bucket(out, numbers[1], found[1][0], "__t")
    return out.withColumn("__s", F.when(is_hot, F.col("__t")).otherwise(0)).drop("__t")


def value_cells(df: DataFrame, col: str) -> tuple[list[float], int]:
    """Cut points of a numeric column into cells of about one task's rows."""
    points = _cuts(df, [col])[1][0][0]
    return points, len(points) + 1


def in_cells(df: DataFrame, col: str, points: Sequence[float], out: str) -> DataFrame:
    return _bucket(df, F.col(col).cast("double"), points, out)


def _order_columns(order: str, tie: str | None, descending: bool) -> list[Column]:
    first = F.col(order).desc_nulls_last() if descending else F.col(order).asc_nulls_last()
    return [first] if tie is None else [first, F.col(tie).asc()]


def prefix_sums(
    df: DataFrame,
    order: str,
    measures: Mapping[str, Column],
    by: Sequence[str] = (),
    tie: str | None = None,
    descending: bool = False,
    source: DataFrame | None = None,
) -> DataFrame:
    """Add running sums (this row included) of ``measures`` along ``order`` within ``by``.

    (by, order, tie) must be unique. For an aggregated ``df``, ``source`` may name the rows it was made from: sizes and cut
    points then come from a scan of those instead of another run of the aggregate.
    """
    by = list(by)
    ordering = _order_columns(order, tie, descending)
    keyed = df.select("*", *[m.alias(f"__m_{k}") for k, m in measures.items()])
    temp = [f"__m_{k}" for k in measures]
    cells = with_cells(keyed, order, tie, descending, source)
    keys = [*by, "__b", "__s"]
    totals = cells.groupBy(*keys).agg(*[F.sum(t).alias(f"{t}_t") for t in temp])
    before = Window.partitionBy(*(by or [F.lit(0)])).orderBy("__b", "__s")
    before = before.rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, *[F.coalesce(F.sum(f"{t}_t").over(before), F.lit(0)).alias(f"{t}_o") for t in temp])
    w = Window.partitionBy(*keys).orderBy(*ordering).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = join_on_keys(cells, offsets, keys)
    out = joined.select("*", *[(F.col(f"__m_{k}_o") + F.sum(f"__m_{k}").over(w)).alias(k) for k in measures])
    return out.drop("__b", "__s", *temp, *[f"{t}_o" for t in temp])


def row_numbers(
    df: DataFrame,
    order: str,
    out: str = "row_number",
    by: Sequence[str] = (),
    tie: str | None = None,
    descending: bool = False,
) -> DataFrame:
    """Exact 1-based position along (order, tie) within ``by``."""
    numbered = prefix_sums(df, order, {out: F.lit(1).cast("bigint")}, by, tie, descending)
    return numbered.withColumn(out, F.col(out).cast("bigint"))


def neighbours(
    df: DataFrame,
    order: str,
    cols: Sequence[str],
    by: Sequence[str] = (),
    tie: str | None = None,
) -> DataFrame:
    """Add structs ``prev`` and ``next`` with ``cols`` of the adjacent rows (null at the ends)."""
    by, cols = list(by), list(cols)
    ordering = _order_columns(order, tie, False)
    packed = df.withColumn("__row", F.struct(*cols))
    cells = with_cells(packed, order, tie)
    keys = [*by, "__b", "__s"]
    place = F.struct(*[c for c in (order, tie) if c is not None])
    ends = cells.groupBy(*keys).agg(F.min_by("__row", place).alias("__first"), F.max_by("__row", place).alias("__last"))
    across = Window.partitionBy(*(by or [F.lit(0)])).orderBy("__b", "__s")
    edges = ends.select(
        *keys, F.lag("__last").over(across).alias("__before"), F.lead("__first").over(across).alias("__after")
    )
    w = Window.partitionBy(*keys).orderBy(*ordering)
    joined = join_on_keys(cells, edges, keys)
    out = joined.select(
        "*",
        F.coalesce(F.lag("__row").over(w), "__before").alias("prev"),
        F.coalesce(F.lead("__row").over(w), "__after").alias("next"),
    )
    return out.drop("__row", "__b", "__s", "__before", "__after")


def _number(c: str) -> Column:
    """The column as double with NaN read as missing."""
    d = F.col(c).cast("double")
    return F.when(~F.isnan(d), d)


def _targets(inside: DataFrame, keys: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """The cells that hold a wanted position, from the counts of all cells.

    ``inside`` has rows (keys, __from, __total, __cell, __v): ``__from`` rows of the group lie before the stretch that is cut into cells,
    and names it. ``__total`` is null where the group has not been counted yet.
    """
    stretch = [*keys, "__from", "__total"]
    counts = inside.groupBy(*stretch, "__cell").agg(F.count(F.lit(1)).alias("__c"), F.min("__v").alias("__low"), F.max("__v").alias("__high"))
    upto = F.sum("__c").over(Window.partitionBy(*stretch).orderBy("__cell").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    whole = F.coalesce("__total", F.sum("__c").over(Window.partitionBy(*stretch)))
    placed = counts.select(*stretch, "__cell", "__c", "__low", "__high", (F.col("__from") + upto).alias("__upto"), whole.alias("__rows"))
    wanted = F.lit(False)
    for t in (f((F.col("__rows") - 1) * F.lit(p)) for p in probs for f in (F.floor, F.ceil)):
        wanted = wanted | ((t >= F.col("__upto") - F.col("__c")) & (t < F.col("__upto")))
    return placed.where(wanted).select(*keys, "__from", "__cell", (F.col("__upto") - F.col("__c")).alias("__before"), "__rows", "__c", "__low", "__high")


def _narrowed(long: DataFrame, keys: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """(keys, __v, __from, __total) of the values in the cells that hold wanted positions, none of which outgrows a task.

    Cells are even in the logarithm first, then even between the least and the largest value of the cell that is still too large.
    """
    limit = rows_per_task(long)
    size = F.floor(F.log2(F.abs("__v") + 1) * PER_OCTAVE)
    inside = long.select(*keys, "__v", F.lit(0).cast("long").alias("__from"), F.lit(None).cast("long").alias("__total"), (F.signum("__v").cast("int") * size).alias("__cell"))
    for step in range(1, MAX_STEPS + 1):
        targets = _targets(inside, keys, probs)
        found = targets.limit(TARGET_ROWS + 1).collect()
        if len(found) <= TARGET_ROWS:
            large = any(r["__c"] > limit and r["__low"] < r["__high"] for r in found)
            targets = F.broadcast(long.sparkSession.createDataFrame(found, targets.schema))
        else:
            large = not targets.where((F.col("__c") > limit) & (F.col("__low") < F.col("__high"))).isEmpty()
        inside = join_on_keys(inside.drop("__total"), targets, [*keys, "__from", "__cell"])
        inside = inside.drop("__from", "__cell").withColumnsRenamed({"__before": "__from", "__rows": "__total"})
        if not large or (limit <= 0 and step > 1):
            break
        part = F.floor((F.col("__v") - F.col("__low")) / F.nullif(F.col("__high") - F.col("__low"), F.lit(0.0)) * FINER)
        inside = inside.withColumn("__cell", F.coalesce(part, F.lit(0))).drop("__c", "__low", "__high")
    return inside.select(*keys, "__v", "__from", "__total")


def exact_quantiles(
    df: DataFrame,
    cols: Sequence[str],
    probs: Sequence[float],
    by: Sequence[str] = (),
    extra: Sequence[Column] = (),
    filled: bool = True,
) -> DataFrame:
    """Linearly interpolated quantiles: one row per ``by`` with an array ``q_<col>`` per column.

    Multi-selection, the same at every size. A first pass counts values per group and cell, which tells the cells that hold the wanted
    positions; a cell with more values than a task takes is cut again. The last pass reads only the values of these
    cells, collapses them to (value, count) and picks the two around each position. Up to ``TARGET_ROWS`` cells go to the tasks as a small
    table, so that no other value is shuffled; of more groups than that the cells are joined by a shuffle. ``extra`` are further
    aggregates to compute per group.
    """
    by, cols, probs = list(by), list(cols), [float(p) for p in probs]
    pairs = F.array(*[F.struct(F.lit(c).alias("__var"), _number(c).alias("__v")) for c in cols])
    long = df.select(*by, F.inline(pairs)).filter(F.col("__v").isNotNull())
    keys = [*by, "__var"]
    counts = _narrowed(long, keys, probs).groupBy(*keys, "__from", "__total", "__v").agg(F.count(F.lit(1)).alias("__n"))
    upto = Window.partitionBy(*keys, "__from", "__total").orderBy("__v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = counts.withColumn("__cum", F.col("__from") + F.sum("__n").over(upto))
    low_high = []
    for i, p in enumerate(probs):
        pos = (F.col("__total") - 1) * F.lit(p)
        for tag, target in (("lo", F.floor(pos)), ("hi", F.ceil(pos))):
            inside = (F.col("__cum") - F.col("__n") <= target) & (target < F.col("__cum"))
            low_high.append(F.max(F.when(inside, F.col("__v"))).alias(f"__{tag}{i}"))
    picked = placed.groupBy(*keys).agg(*low_high, F.max("__total").alias("__total"))
    values = []
    for i, p in enumerate(probs):
        pos = (F.col("__total") - 1) * F.lit(p)
        lo, hi = F.col(f"__lo{i}"), F.col(f"__hi{i}")
        values.append(lo + (hi - lo) * (pos - F.floor(pos)))
    arrays = picked.select(*keys, F.array(*values).alias("__q"))
    wide = arrays.groupBy(*by).agg(
        *[F.max(F.when(F.col("__var") == c, F.col("__q"))).alias(f"q_{c}") for c in cols]
    )
    if not extra and not (by and filled):
        return wide
    base = df.groupBy(*by).agg(*(extra or [F.count(F.lit(1)).alias("__rows")]))
    if by:
        out = join_on_keys(base, wide, by, "left")
        return out.drop("__rows")
    return attach_scalars(base, wide, "__w").select("*", *[F.col(f"__w.q_{c}") for c in cols]).drop("__w")


def average_ranks(df: DataFrame, col: str, out: str = "rank") -> DataFrame:
    """One row per distinct value of ``col`` with the mean rank its rows share."""
    known = df.filter(F.col(col).isNotNull())
    counts = known.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    ranked = prefix_sums(counts, col, {"__cum": F.col("n")}, source=known)
    return ranked.select(col, "n", (F.col("__cum") - F.col("n") + (F.col("n") + 1) / F.lit(2.0)).alias(out))

"""Joins between tables that share a key."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallygrid.functions.scalars import fold_key, fold_text
from tallygrid.operators.frames import unpivot_years
from tallygrid.operators.ordered import attach_scalars


def assemble_panel(
    tables: Mapping[str, DataFrame], key: str, years: Sequence[int], labels: Sequence[str] = ()
) -> DataFrame:
    """Join wide indicator tables into (key, labels, year, one column per indicator).

    Only fully observed (key, year) cells remain. The first table may list a key
    several times and supplies ``labels``; the others are reduced to
    one row per key (the largest, so that the choice repeats).
    Each is made long and dropped of empty cells before it is joined, and all joins
    share the (key, year) partitioning.
    """
    out = None
    for name, wide in tables.items():
        first = out is None
        present = [str(y) for y in years if str(y) in wide.columns]
        slim = wide.select(key, *(labels if first else []), *[f"`{y}`" for y in present])
        if not first:
            rest = [c for c in slim.columns if c != key]
            one = slim.groupBy(key).agg(F.max(F.struct(*[f"`{c}`" for c in rest])).alias("__r"))
            slim = one.select(key, "__r.*")
        long = unpivot_years(slim, [key, *(labels if first else [])], years, name)
        out = long if first else out.join(long, [key, "year"], "inner")
    return out


def join_suffixed(
    a: DataFrame, b: DataFrame, on: Sequence[str], suffixes: tuple[str, str] = ("_1", "_2")
) -> DataFrame:
    """Inner equi-join; columns both sides have (other than the key) get the suffixes."""
    both = (set(a.columns) & set(b.columns)) - set(on)
    left = a.withColumnsRenamed({c: c + suffixes[0] for c in both})
    right = b.withColumnsRenamed({c: c + suffixes[1] for c in both})
    return left.join(right, list(on), "inner")


def keep_named(df: DataFrame, col: str, names: Sequence[str], fold: bool = True) -> DataFrame:
    """Rows whose name is on a short list, by folded spelling or as written."""
    if not fold:
        return df.filter(F.col(col).isin(list(names)))
    wanted = sorted({fold_text(n) for n in names})
    return df.filter(fold_key(F.col(col)).isin(wanted))


def keep_members(df: DataFrame, members: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.join(members, list(on), "left_semi")


def exclude_rows(df: DataFrame, picked: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.join(picked.select(*on), list(on), "left_anti")


def train_sets(df: DataFrame, fold: str, folds: Sequence[int], out: str = "test_fold") -> DataFrame:
    """Each row once per test fold it trains for: all folds but its own.

    The fold list is short and known, so rows multiply inside their task; no join.
    """
    listed = F.array(*[F.lit(f) for f in folds])
    others = F.filter(listed, lambda f: f != F.col(fold))
    return df.select("*", F.explode(others).alias(out))


def pair_up(a: DataFrame, b: DataFrame, pair_id: str) -> DataFrame:
    """Match the two halves of each pair by its id."""
    return a.join(b, pair_id, "inner")


def attach_global(df: DataFrame, source: DataFrame, **aggregates: Column) -> DataFrame:
    """Add global aggregates of ``source`` as columns of every row."""
    agg = source.agg(*[c.alias(n) for n, c in aggregates.items()])
    out = attach_scalars(df, agg, "__g")
    return out.select("*", *[F.col(f"__g.{n}").alias(n) for n in aggregates]).drop("__g")


def lookup_table(df: DataFrame, code: str, name: str) -> DataFrame:
    """Distinct (code, name) pairs without missing parts, sorted by code."""
    return df.select(code, name).dropna().distinct().orderBy(code, name)


PAIR_BLOCK = 1000


def value_pairs(df: DataFrame, col: str) -> DataFrame:
    """All unordered pairs of a column's distinct values: columns ``a`` < ``b``.

    The result is quadratic in the number of values by definition. Values are dealt over blocks, and each pair of blocks
    meets under a key of its own.
    """
    values = df.select(F.col(col).alias("a")).dropna().distinct()
    blocks = max(1, -(-values.count() // PAIR_BLOCK))
    own = F.pmod(F.xxhash64("a"), F.lit(blocks)).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    left = values.select("a", own.alias("i"), other.alias("j"))
    right = values.select(F.col("a").alias("b"), own.alias("j"), other.alias("i"))
    return left.join(right, ["i", "j"]).where(F.col("a") < F.col("b")).select("a", "b")

"""Unions and distinct rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_tagged(tables: Mapping[str, DataFrame], tag: str = "source") -> DataFrame:
    """Union by column name with the table's name in a column."""
    out = None
    for name, df in tables.items():
        part = df.withColumn(tag, F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def distinct_rows(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.select(*cols).distinct()


def union_keys(tables: Sequence[DataFrame], key: str) -> DataFrame:
    out = tables[0].select(key)
    for df in tables[1:]:
        out = out.union(df.select(key))
    return out.distinct()

"""Readers and writers for delimited text, named datasets and column contracts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallygrid.functions.scalars import parse_decimal, to_number


def _schema(schema: T.StructType | str) -> T.StructType:
    return schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Comma CSV with a header; unreadable cells and NaN become NULL."""
    schema = _schema(schema)
    df = spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").csv(path)
    fractional = [f.name for f in schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in fractional})


#: A quoted stretch of a delimited line.
_QUOTED = r'"(?:[^"\\]|\\.|"")*"'


def read_delimited_tolerant(spark: SparkSession, path: str, sep: str, schema: T.StructType | str, header: bool = True) -> DataFrame:
    """Delimited text with either decimal mark. Rows with too few fields or a bad number are dropped, further fields ignored.

    Lines are read whole and then parsed, so what is kept does not depend on the columns that a query selects.
    """
    schema = _schema(schema)
    whole = {"sep": "\x01", "quote": "", "escape": "\x01", "header": header}
    lines = spark.read.schema("line string").options(**whole).csv(path)
    names = [f"f{i}" for i in range(len(schema))]
    bare = F.regexp_replace("line", _QUOTED, "")
    enough = F.length(bare) - F.length(F.replace(bare, F.lit(sep), F.lit(""))) >= (len(names) - 1) * len(sep)
    fields = F.from_csv("line", ", ".join(f"{n} string" for n in names), {"sep": sep})
    raw = lines.filter(enough).select(fields.alias("row")).select("row.*").fillna("")

    def typed(name: str, f: T.StructField) -> Column:
        if isinstance(f.dataType, T.NumericType):
            return parse_decimal(F.col(name), f.dataType.simpleString()).alias(f.name)
        return F.trim(name).alias(f.name)

    out = raw.select(*[typed(n, f) for n, f in zip(names, schema)])
    numbers = [f"`{f.name}`" for f in schema if isinstance(f.dataType, T.NumericType)]
    return out.dropna(subset=numbers) if numbers else out


def read_csv_preamble(
    spark: SparkSession, path: str, schema: T.StructType | str, is_row: Column, has_trailing_comma: bool = True
) -> DataFrame:
    """CSV whose table starts after some lines of preamble.

    A distributed scan has no line numbers, so ``is_row`` (a predicate on the text
    columns) tells table rows from preamble and header.
    """
    schema = _schema(schema)
    text = [T.StructField(f.name, T.StringType()) for f in schema]
    if has_trailing_comma:
        text.append(T.StructField("__rest", T.StringType()))
    raw = spark.read.schema(T.StructType(text)).option("header", False).option("mode", "PERMISSIVE").csv(path)
    kept = raw.filter(is_row)
    return kept.select(
        *[
            (to_number(F.col(f"`{f.name}`")).cast(f.dataType) if isinstance(f.dataType, T.NumericType) else F.col(f"`{f.name}`")).alias(f.name)
            for f in schema
        ]
    )


def inline_table(spark: SparkSession, rows: Sequence[Sequence], schema: T.StructType | str) -> DataFrame:
    """A literal table, for lookups and fixtures."""
    return spark.createDataFrame([tuple(r) for r in rows], _schema(schema))


def load(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """A named dataset stored as Parquet."""
    return spark.read.parquet(f"{directory.rstrip('/')}/{name}.parquet")


def conform(
    df: DataFrame,
    rename: Mapping[str, str],
    required: Sequence[str],
    numeric: Sequence[str],
    derive: tuple[str, str, str] | None = None,
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """Rename, check and coerce columns to a contract.

    ``derive=(total, per_unit, units)`` computes the total as per_unit × units when
    the table lacks it. Values that are not numbers become NULL.
    """
    out = df.withColumnsRenamed(dict(rename))
    missing = sorted(set(required) - set(out.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}")
    if derive is not None:
        total, per_unit, units = derive
        if total not in out.columns:
            if per_unit not in out.columns:
                raise ValueError(f"need {total!r} or {per_unit!r}")
            out = out.withColumn(total, to_number(F.col(per_unit)) * to_number(F.col(units)))
    out = out.withColumns({c: to_number(F.col(c)) for c in numeric if c in out.columns})
    return out.select(*[c for c in keep if c in out.columns]) if keep is not None else out


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV with a header, missing values empty; one file per task."""
    df.write.mode(mode).option("header", True).option("nullValue", "").option("emptyValue", '""').csv(path)

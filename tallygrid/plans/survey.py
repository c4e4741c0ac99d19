"""The consumer survey: profile, grouped answers, heavy consumers and segments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallygrid.operators import summary
from tallygrid.operators.frames import segment_by_quantiles, unit_cost
from tallygrid.operators.ordered import attach_scalars, exact_quantiles


def survey_report(
    df: DataFrame, state: str, kind: str, age: str, brand: str, qty: str, spend: str, kinds: Sequence[str] | None = None
) -> dict[str, DataFrame]:
    """One table per question. Order-based tables count their rows when made; all else runs when a table is read."""
    edge = attach_scalars(df, exact_quantiles(df, [qty], [0.75]), "__edge")
    heavy = edge.filter(F.col(qty) >= F.col(f"__edge.q_{qty}")[0]).drop("__edge")
    segments = segment_by_quantiles(df.withColumn("spend_per_cup", unit_cost(F.col(spend), F.col(qty))), qty)
    return {
        "nulls": summary.null_profile(df),
        "describe": summary.describe(df, extended=True),
        "states": summary.distinct_values(df, state),
        "top_state": summary.top_groups(df, state, qty),
        "kinds": summary.value_counts(df, kind),
        "kind_by_age": summary.crosstab_long(df, age, kind) if kinds is None else summary.crosstab_pct(df, age, kind, kinds),
        "cups_by_age": summary.group_mean(df, [age], [qty]),
        "spend_by_state": summary.group_mean(df, [state], [spend]),
        "cups": summary.histogram(df, qty, 20),
        "cups_density": summary.kde(df, qty),
        "brands": summary.value_counts(df, brand),
        "brand_stats": summary.brand_stats(df, [brand], qty, spend),
        "heavy_brands": summary.value_counts(heavy, brand),
        "heavy_brand_stats": summary.brand_stats(heavy, [brand], qty, spend),
        "segment_brand_stats": summary.brand_stats(segments, ["segment", brand], qty, spend),
    }

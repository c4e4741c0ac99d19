"""The education and income study: wide indicator tables to fitted models, as lazy tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallygrid.operators import correlation, models, panel, regression, smoothing, summary, topk, windows
from tallygrid.operators.frames import clean_and_feature
from tallygrid.operators.joins import assemble_panel, keep_named, lookup_table
from tallygrid.session import stored

PCT, LOG_PC, LOG_AREA = "higher_ed_pct", "log_gdp_pc", "log_area"
MIN_ROWS = 4


def build_panel(tables: Mapping[str, DataFrame], key: str, name: str, last_year: int, n_years: int = 30) -> DataFrame:
    """Long, complete and cleaned panel of the last ``n_years``.

    ``tables`` maps gdp, population, area and higher_ed_pct to wide year tables.
    """
    years = range(last_year - n_years + 1, last_year + 1)
    return clean_and_feature(assemble_panel(tables, key, years, [name]))


def cross_section(panel_df: DataFrame, key: str, name: str) -> DataFrame:
    """One row per entity: medians over its years."""
    return summary.entity_medians(panel_df, [key, name], [PCT, LOG_PC, LOG_AREA])


def analyse_view(view: DataFrame, key: str, permutations: int = 10_000, seed: int = 123) -> dict[str, DataFrame]:
    """Correlations, robust line, diagnostics, median line, smoothing and clusters of one view."""
    n = view.count()
    if n < MIN_ROWS:
        raise ValueError(f"{n} rows; the analyses need at least {MIN_ROWS}")
    y, x = LOG_PC, PCT
    out = {
        "pearson": correlation.pearson_ci(view, x, y),
        "spearman": correlation.spearman(view, x, y),
        "permutation": correlation.permutation_corr_test(view, x, y, key, permutations, seed),
        "ols": regression.ols_hc3(view, y, [x]),
        "beta": regression.standardized_beta(view, y, [x]),
        "breusch_pagan": regression.breusch_pagan(view, y, [x]),
        "reset": regression.reset_test(view, y, [x]),
        "jarque_bera": regression.jarque_bera_residuals(view, y, [x]),
        "influence": regression.most_influential(view, y, [x], key),
        "median_line": regression.quantile_regression(view, y, [x]),
        "lowess": smoothing.lowess_grid(view, x, y),
        "quartiles": regression.quartile_fits(view, x, y),
        "labels": topk.flag_extremes(regression.with_fit(view, regression.fit_ols(view, y, [x])), x, y, "resid", key),
    }
    if n >= 5:
        clustered, scores = models.kmeans_auto(view, [PCT, LOG_PC, LOG_AREA], key)
        out["cluster_scores"] = scores
        out["clusters"] = summary.cluster_summary(clustered, "cluster", PCT, [LOG_PC, LOG_AREA])
        out["cluster_landmarks"] = topk.group_landmarks(clustered, "cluster", PCT, LOG_PC, key)
    return out


def analyse_panel(panel_df: DataFrame, key: str, name: str, highlight: Sequence[str] = ()) -> dict[str, DataFrame]:
    """Two-way fixed effects, effects per entity and the paths of the highlighted entities."""
    slope = panel.panel_fe(panel_df, LOG_PC, PCT, key, "year")
    effects = panel.fixed_effects(panel_df, LOG_PC, PCT, key, "year", highlight)
    named = keep_named(panel_df, name, highlight) if highlight else panel_df
    moves = windows.demean(named.select(key, "year", PCT, LOG_PC), key, [PCT, LOG_PC])
    return {
        "panel": slope,
        "effects": effects,
        "paths": windows.trajectory(moves, key, "year", f"{PCT}_dev", f"{LOG_PC}_dev"),
        "codes": lookup_table(panel_df, key, name),
    }


def run_study(
    tables: Mapping[str, DataFrame], key: str, name: str, last_year: int, highlight: Sequence[str] = (), permutations: int = 10_000
) -> dict[str, DataFrame]:
    """The whole study. The panel and the cross-section are stored once and read by every analysis."""
    panel_df = stored(build_panel(tables, key, name, last_year), "study-panel")
    view = stored(cross_section(panel_df, key, name), "study-view")
    return analyse_view(view, key, permutations) | analyse_panel(panel_df, key, name, highlight)


def compare_versions(a: DataFrame, b: DataFrame, key: str, measure: str, others: Sequence[str] = (), tol: float = 0.10) -> dict[str, DataFrame]:
    """Share of units two versions of a table disagree on, and both versions' level and spread."""
    return {
        "discrepancy": summary.discrepancy_rate(a, b, [key], measure, tol),
        "levels": summary.level_and_spread({"first": a, "second": b}, [measure, *others]),
        "shared": a.select(key).intersect(b.select(key)).agg(F.count(F.lit(1)).alias("n")),
    }

"""Comparison of several classifiers on shared folds: one scored table, all metrics and curves from it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallygrid.operators import evaluation as ev
from tallygrid.operators.models import MODELS, score_models
from tallygrid.session import stored


def compare(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    row_id: str,
    models: Sequence[str] = MODELS,
    spaces: Mapping[str, Mapping[str, Sequence]] | None = None,
    folds: int = 5,
    seed: int = 42,
    threshold: float = 0.5,
    n_iter: int = 25,
    settings: Mapping[str, Mapping[str, Any]] | None = None,
) -> dict[str, DataFrame]:
    """Score table by model (best ROC AUC first), ROC, precision-recall with lift, and calibration.

    The out-of-fold scores of all models are stored once; every result is grouped by
    model, so adding a model adds rows and no passes.
    """
    scored = stored(score_models(df, features, label, row_id, models, spaces, folds, seed, threshold, n_iter, settings), "oof-scores").dropna(subset=["y", "prob"])
    by = ["model"]
    return {
        "scored": scored,
        "scores": ev.evaluate(scored, "y", "prob", "pred", by).orderBy(F.desc("roc_auc"), "model"),
        "roc": ev.roc_points(scored, "y", "prob", by),
        "precision_recall": ev.pr_points(scored, "y", "prob", by),
        "calibration": ev.calibration_curve(scored, "y", "prob", 10, by),
        "best_threshold": ev.best_threshold(scored, "y", "prob", by=by),
    }

"""Evaluation of binary classifiers: scored rows in, small tables out.

Input rows carry a 0/1 label and a score; ``by`` (say, a model name) evaluates many
models in one pass. Curves are built from counts per distinct score, threshold
tables from counts per grid interval: the rows are read once and combined inside
each task, whatever the number of thresholds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallygrid.functions.scalars import ratio
from tallygrid.operators.frames import double_array, grid_position, grid_values
from tallygrid.operators.ordered import attach_scalars, join_on_keys, prefix_sums


COUNTS = ("tp", "fp", "tn", "fn")


def _flag(c: str) -> Column:
    return F.col(c).cast("int")


def _confusion(label: str, pred: str) -> dict[str, Column]:
    y, p = _flag(label) == 1, _flag(pred) == 1
    cases = {"tp": y & p, "fp": ~y & p, "tn": ~y & ~p, "fn": y & ~p}
    return {n: F.count_if(c).cast("bigint") for n, c in cases.items()}


def confusion_counts(df: DataFrame, label: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(*[c.alias(n) for n, c in _confusion(label, pred).items()])


def _zero_ratio(num: Column, den: Column) -> Column:
    return F.coalesce(ratio(num.cast("double"), den), F.lit(0.0))


def metric_columns(tp: Column, fp: Column, tn: Column, fn: Column) -> dict[str, Column]:
    """Metrics as expressions over the four counts; a zero denominator gives 0."""
    n = tp + fp + tn + fn
    precision, recall = _zero_ratio(tp, tp + fp), _zero_ratio(tp, tp + fn)
    d = [x.cast("double") for x in (tp, fp, tn, fn)]
    under = F.sqrt((d[0] + d[1]) * (d[0] + d[3]) * (d[2] + d[1]) * (d[2] + d[3]))
    return {
        "accuracy": _zero_ratio(tp + tn, n),
        "precision": precision,
        "recall": recall,
        "f1": _zero_ratio(2 * tp, 2 * tp + fp + fn),
        "mcc": F.coalesce((d[0] * d[2] - d[1] * d[3]) / F.nullif(under, F.lit(0.0)), F.lit(0.0)),
    }


def classification_metrics(df: DataFrame, label: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    counts = confusion_counts(df, label, pred, by)
    cols = metric_columns(*[F.col(c) for c in COUNTS])
    return counts.select(*by, *COUNTS, *[c.alias(n) for n, c in cols.items()])


def score_counts(df: DataFrame, label: str, prob: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows and positives per distinct score."""
    y = _flag(label)
    return df.filter(F.col(prob).isNotNull() & F.col(label).isNotNull()).groupBy(*by, F.col(prob).cast("double").alias("score")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(y.cast("bigint")).alias("pos")
    )


def curve_counts(df: DataFrame, label: str, prob: str, by: Sequence[str] = ()) -> DataFrame:
    """Per distinct score: tp and fp of the rule score ≥ threshold, and the class totals."""
    by = list(by)
    counts = score_counts(df, label, prob, by)
    run = prefix_sums(
        counts, "score", {"tp": F.col("pos"), "fp": F.col("n") - F.col("pos")}, by, descending=True,
        source=df.select(F.col(prob).cast("double").alias("score")),
    )
    totals = counts.groupBy(*by).agg(F.sum("pos").alias("p"), F.sum(F.col("n") - F.col("pos")).alias("q"))
    if by:
        return join_on_keys(run, totals, by)
    return attach_scalars(run, totals, "__t").select("*", F.col("__t.p").alias("p"), F.col("__t.q").alias("q")).drop("__t")


def _roc_area() -> Column:
    below = F.col("q") - F.col("fp")
    wins = F.col("pos") * (below + (F.col("n") - F.col("pos")) / F.lit(2.0))
    return ratio(F.sum(wins), F.max(F.col("p").cast("double") * F.col("q")))


def _average_precision() -> Column:
    step = F.col("pos") * (F.col("tp") / (F.col("tp") + F.col("fp")))
    return ratio(F.sum(step), F.max("p"))


def roc_auc(df: DataFrame, label: str, prob: str, by: Sequence[str] = ()) -> DataFrame:
    """Share of (positive, negative) pairs in the right order, ties one half; NULL for one class."""
    return curve_counts(df, label, prob, by).groupBy(*by).agg(_roc_area().alias("roc_auc"))


def pr_auc(df: DataFrame, label: str, prob: str, by: Sequence[str] = ()) -> DataFrame:
    """Average precision: Σ (recall step) · precision, without interpolation."""
    return curve_counts(df, label, prob, by).groupBy(*by).agg(_average_precision().alias("pr_auc"))


def _losses(label: str, prob: str, eps: float) -> dict[str, Column]:
    y, p = F.col(label).cast("double"), F.col(prob).cast("double")
    clipped = F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))
    loss = -(y * F.log(clipped) + (1 - y) * F.log(1 - clipped))
    return {"brier": F.avg((p - y) * (p - y)), "log_loss": F.avg(loss)}


def probability_losses(df: DataFrame, label: str, prob: str, by: Sequence[str] = (), eps: float = 1e-15) -> DataFrame:
    return df.groupBy(*by).agg(*[c.alias(n) for n, c in _losses(label, prob, eps).items()])


def roc_points(df: DataFrame, label: str, prob: str, by: Sequence[str] = ()) -> DataFrame:
    c = curve_counts(df, label, prob, by)
    return c.select(
        *by,
        F.col("score").alias("threshold"),
        ratio(F.col("fp"), F.col("q")).alias("fpr"),
        ratio(F.col("tp"), F.col("p")).alias("tpr"),
    )


def pr_points(df: DataFrame, label: str, prob: str, by: Sequence[str] = ()) -> DataFrame:
    """Precision, recall and cumulative lift per distinct score."""
    c = curve_counts(df, label, prob, by)
    precision = F.col("tp") / (F.col("tp") + F.col("fp"))
    base = F.col("p") / (F.col("p") + F.col("q"))
    return c.select(
        *by,
        F.col("score").alias("threshold"),
        precision.alias("precision"),
        ratio(F.col("tp"), F.col("p")).alias("recall"),
        ratio(precision, base).alias("lift"),
    )


def threshold_counts(
    df: DataFrame, label: str, prob: str, lo: float, hi: float, n: int, by: Sequence[str] = ()
) -> DataFrame:
    """tp, fp, tn, fn of the rule score ≥ t for every t of an even grid.

    Rows are counted per grid interval (at most n+1 partial sums per group leave a
    task); the counts of the intervals above t are then added up.
    """
    by = list(by)
    p, y = F.col(prob).cast("double"), _flag(label).cast("bigint")
    place = grid_position(p, lo, hi, n)
    known = df.filter(F.col(prob).isNotNull() & F.col(label).isNotNull())
    cells = known.groupBy(*by, place.alias("at")).agg(F.count(F.lit(1)).alias("n"), F.sum(y).alias("pos"))
    totals = cells.groupBy(*by).agg(F.sum("n").alias("rows"), F.sum("pos").alias("p"))
    each = totals.select("*", F.posexplode(double_array(grid_values(lo, hi, n))).alias("i", "threshold"))
    # Interval i+1 holds the scores from threshold i up to the next one.
    counted = join_on_keys(each, cells.withColumn("i", F.col("at") - 1).drop("at"), [*by, "i"], "left")
    upward = Window.partitionBy(*(by or [F.lit(0)])).orderBy(F.desc("i")).rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def above(c: str) -> Column:
        return F.coalesce(F.sum(c).over(upward), F.lit(0)).cast("bigint")

    hits = counted.select(*by, "i", "threshold", "rows", "p", above("pos").alias("tp"), above("n").alias("called"))
    fp = F.col("called") - F.col("tp")
    return hits.select(
        *by, "i", "threshold", "tp", fp.alias("fp"), (F.col("rows") - F.col("p") - fp).alias("tn"), (F.col("p") - F.col("tp")).alias("fn")
    )


def threshold_table(
    df: DataFrame, label: str, prob: str, lo: float = 0.1, hi: float = 0.7, n: int = 25, by: Sequence[str] = ()
) -> DataFrame:
    """Accuracy, specificity, sensitivity, negative and positive predictive value per threshold."""
    t = threshold_counts(df, label, prob, lo, hi, n, by)
    tp, fp, tn, fn = (F.col(c) for c in COUNTS)
    return t.select(
        *by,
        "threshold",
        ratio(tp + tn, tp + fp + tn + fn).alias("accuracy"),
        ratio(tn, tn + fp).alias("specificity"),
        ratio(tp, tp + fn).alias("sensitivity"),
        ratio(tn, tn + fn).alias("npv"),
        ratio(tp, tp + fp).alias("ppv"),
    )


def best_threshold(
    df: DataFrame, label: str, prob: str, metric: str = "f1", lo: float = 0.01, hi: float = 0.99, n: int = 500, by: Sequence[str] = ()
) -> DataFrame:
    """First grid threshold with the highest metric."""
    t = threshold_counts(df, label, prob, lo, hi, n, by)
    value = metric_columns(*[F.col(c) for c in COUNTS])[metric]
    scored = t.select(*by, "i", "threshold", value.alias("value"))
    best = F.max_by("threshold", F.struct("value", (-F.col("i")).alias("first")))
    return scored.groupBy(*by).agg(best.alias("threshold"), F.max("value").alias(metric))


def calibration_curve(df: DataFrame, label: str, prob: str, bins: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """Mean score and share of positives per right-closed bin of [0, 1]; empty bins are left out."""
    p = F.col(prob).cast("double")
    guess = F.least(F.greatest(F.ceil(p * bins) - 1, F.lit(0)), F.lit(bins - 1)).cast("int")
    # Arithmetic may miss an edge by rounding; the edges themselves decide.
    edges = double_array(grid_values(0.0, 1.0, bins + 1))
    down = (guess > 0) & (p <= F.get(edges, guess))
    up = (guess < bins - 1) & (p > F.get(edges, guess + 1))
    place = F.when(down, guess - 1).when(up, guess + 1).otherwise(guess)
    known = df.filter(F.col(prob).isNotNull() & F.col(label).isNotNull())
    return known.groupBy(*by, place.alias("bin")).agg(
        F.avg(p).alias("mean_prob"), F.avg(F.col(label).cast("double")).alias("frac_positive"), F.count(F.lit(1)).cast("bigint").alias("n")
    )


def evaluate(df: DataFrame, label: str, prob: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """Every scalar metric in one row per group: one pass for counts and losses, one for the curve."""
    by = list(by)
    parts = _confusion(label, pred) | _losses(label, prob, 1e-15)
    sums = df.groupBy(*by).agg(*[c.alias(n) for n, c in parts.items()])
    areas = curve_counts(df, label, prob, by).groupBy(*by).agg(
        _roc_area().alias("roc_auc"), _average_precision().alias("pr_auc")
    )
    both = join_on_keys(sums, areas, by, "left") if by else attach_scalars(sums, areas, "__a").select("*", "__a.*").drop("__a")
    cols = metric_columns(*[F.col(c) for c in COUNTS])
    return both.select(*by, *COUNTS, *[c.alias(n) for n, c in cols.items()], "roc_auc", "pr_auc", "brier", "log_loss")

"""Encoding, scaling, logistic and tree models, tuning, out-of-fold scoring, clustering."""

from __future__ import annotations

import random
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark import StorageLevel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import RFormula, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallygrid.operators.clusters import fit_centres
from tallygrid.operators.evaluation import evaluate
from tallygrid.operators.frames import label_by_threshold
from tallygrid.operators.gram import complete_rows
from tallygrid.operators.joins import attach_global
from tallygrid.operators.ordered import attach_scalars
from tallygrid.operators.windows import stratified_folds
from tallygrid.session import stored


def encode_formula(df: DataFrame, formula: str) -> DataFrame:
    """Feature vector and label from ``y ~ .`` or ``y ~ a + b``; the first level alphabetically is the base."""
    return _formula(formula).fit(df).transform(df)


def _formula(formula: str) -> RFormula:
    return RFormula(formula=formula, stringIndexerOrderType="alphabetDesc", featuresCol="features", labelCol="label", handleInvalid="skip")


def standardize(df: DataFrame, cols: Sequence[str], ddof: int = 0, suffix: str = "_std") -> DataFrame:
    """(x − mean)/sd with the population (0) or sample (1) sd; a constant column becomes 0."""
    sd = F.stddev_pop if ddof == 0 else F.stddev_samp
    facts = df.agg(*[a for c in cols for a in (F.avg(c).alias(f"m_{c}"), sd(c).alias(f"s_{c}"))])
    d = attach_scalars(df, facts, "__f")
    scale = {c: F.coalesce(F.nullif(F.col(f"__f.s_{c}"), F.lit(0.0)), F.lit(1.0)) for c in cols}
    return d.withColumns({c + suffix: (F.col(c) - F.col(f"__f.m_{c}")) / scale[c] for c in cols}).drop("__f")


class LogitModel:
    """A fitted formula logistic regression."""

    def __init__(self, encoder, model, names: Sequence[str], levels: Mapping[str, Sequence[str]], numbers: Sequence[str], label: str) -> None:
        self.encoder, self.model, self.names = encoder, model, list(names)
        self.levels, self.numbers, self.label = dict(levels), list(numbers), label

    def coefficients(self) -> DataFrame:
        s = self.model.summary
        est = [*self.model.coefficients.toArray().tolist(), self.model.intercept]
        columns = (est, s.coefficientStandardErrors, s.tValues, s.pValues)
        rows = [(t, *(float(c[i]) for c in columns)) for i, t in enumerate([*self.names, "const"])]
        spark = self.model.summary.predictions.sparkSession
        return spark.createDataFrame(rows, "term string, estimate double, std_error double, z double, p double")

    def fit_facts(self) -> DataFrame:
        """Null and residual deviance with their degrees of freedom, AIC and the number of iterations."""
        s = self.model.summary
        row = (s.nullDeviance, s.residualDegreeOfFreedomNull, s.deviance, s.residualDegreeOfFreedom, s.aic, s.numIterations)
        schema = "null_deviance double, df_null bigint, deviance double, df_residual bigint, aic double, iterations int"
        return s.predictions.sparkSession.createDataFrame([row], schema)

    def predict(self, df: DataFrame, out: str = "prob") -> DataFrame:
        """Every row with its probability; NULL where a predictor is missing or a level was not in the fit."""
        usable, safe = F.lit(True), {}
        for c in self.numbers:
            known = F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
            usable = usable & known
            safe[c] = F.when(known, F.col(c)).otherwise(F.lit(0).cast(df.schema[c].dataType))
        for c, levels in self.levels.items():
            known = F.coalesce(F.col(c).isin(levels), F.lit(False))
            usable = usable & known
            safe[c] = F.when(known, F.col(c)).otherwise(F.lit(levels[0]))
        rows = df.select(F.struct("*").alias("__row"), usable.alias("__usable"), *[e.alias(c) for c, e in safe.items()])
        if self.label in df.columns:  # the encoder drops rows without a label
            rows = rows.withColumn(self.label, F.lit(0.0))
        scored = self.model.transform(self.encoder.transform(rows))
        return scored.select("__row.*", F.when(F.col("__usable"), F.col("prediction")).alias(out))


def fit_logit(df: DataFrame, formula: str, max_iter: int = 50) -> LogitModel:
    """Maximum-likelihood logistic regression with standard errors, z and p per term."""
    encoder = _formula(formula).fit(df)
    data = encoder.transform(df)
    label, right = (part.strip() for part in formula.split("~"))
    terms = [c for c in df.columns if c != label] if right == "." else [t.strip() for t in right.split("+")]
    texts = [c for c in terms if df.schema[c].dataType.simpleString() == "string"]
    levels = {c: sorted(r[0] for r in data.select(c).distinct().collect()) for c in texts}
    attrs = data.schema["features"].metadata["ml_attr"]["attrs"]
    names = [a["name"] for _, a in sorted((x["idx"], x) for kind in attrs.values() for x in kind)]
    glm = GeneralizedLinearRegression(family="binomial", link="logit", maxIter=max_iter, tol=1e-10)
    return LogitModel(encoder, glm.fit(data), names, levels, [c for c in terms if c not in levels], label)


def build_model(name: str, n_rows: int | None = None, **params: Any):
    """A classifier by name with the usual defaults written out.

    ``C`` of the logistic model is the inverse penalty on the summed loss, hence
    ``regParam = 1/(C·n)`` on the mean loss.
    """
    p = dict(params)
    if name == "logreg":
        c = float(p.pop("C", 1.0))
        reg = p.pop("regParam", 1.0 / (c * n_rows) if n_rows else 0.0)
        return LogisticRegression(**({"maxIter": 2000, "standardization": False, "tol": 1e-6, "regParam": reg} | p))
    if name == "gboost":
        names = {"n_estimators": "maxIter", "learning_rate": "stepSize", "max_depth": "maxDepth"}
        p = {names.get(k, k): v for k, v in p.items()}
        return GBTClassifier(**({"maxIter": 100, "stepSize": 0.1, "maxDepth": 3, "seed": 42} | p))
    if name == "rf":
        names = {"n_estimators": "numTrees", "max_depth": "maxDepth"}
        p = {names.get(k, k): v for k, v in p.items()}
        return RandomForestClassifier(**({"numTrees": 100, "maxDepth": 15, "featureSubsetStrategy": "sqrt", "seed": 42} | p))
    raise ValueError(f"unknown model {name!r}; choose from {sorted(MODELS)}")


MODELS = ("logreg", "gboost", "rf")


def _with_features(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """All rows with features ``__x`` and label ``__y``; ``__known`` marks rows without a missing feature."""
    numbers = {c: F.col(c).cast("double") for c in features}
    known = F.lit(True)
    for n in numbers.values():
        known = known & n.isNotNull() & ~F.isnan(n)
    filled = [F.when(n.isNotNull() & ~F.isnan(n), n).otherwise(0.0).alias(f"__f{i}") for i, n in enumerate(numbers.values())]
    d = df.select("*", F.col(label).cast("double").alias("__y"), known.alias("__known"), *filled)
    names = [f"__f{i}" for i in range(len(features))]
    return VectorAssembler(inputCols=names, outputCol="__x").transform(d).drop(*names)


def _fittable(d: DataFrame) -> DataFrame:
    return d.filter(F.col("__known") & F.col("__y").isNotNull() & ~F.isnan("__y"))


def _wired(est):
    return est.setFeaturesCol("__x").setLabelCol("__y").setProbabilityCol("__p").setPredictionCol("__c").setRawPredictionCol("__r")


def _score(model, df: DataFrame, out: str = "prob") -> DataFrame:
    """Probability of class 1; NULL where a feature is missing."""
    scored = model.transform(df)
    return scored.withColumn(out, F.when(F.col("__known"), vector_to_array("__p")[1])).drop("__p", "__c", "__r", "__known")


def fit_score(
    df: DataFrame, features: Sequence[str], label: str, name: str = "logreg", threshold: float = 0.5, positive: str = "yes", **params: Any
) -> DataFrame:
    """Fit a model on the complete rows and add its ``prob`` and thresholded ``pred`` to every row."""
    d = _with_features(df, features, label)
    fittable = _fittable(d)
    model = _wired(build_model(name, fittable.count(), **params)).fit(fittable)
    return label_by_threshold(_score(model, d), "prob", threshold, positive).drop("__x", "__y")


def random_search(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    row_id: str,
    name: str,
    space: Mapping[str, Sequence],
    n_iter: int = 25,
    seed: int = 42,
    folds: int = 3,
    parallelism: int = 4,
) -> tuple[dict[str, Any], DataFrame, Any]:
    """Best of ``n_iter`` random settings by F1 over stratified folds, the table of all tried, and the best one fitted on every row."""
    rng = random.Random(seed)
    keys = sorted(space)
    total = 1
    for k in keys:
        total *= len(space[k])
    picks = rng.sample(range(total), min(n_iter, total))
    tried = []
    for at in picks:
        setting = {}
        for k in keys:
            at, i = divmod(at, len(space[k]))
            setting[k] = space[k][i]
        tried.append(setting)
    every = _with_features(stratified_folds(df, label, row_id, folds, seed, "__fold"), features, label)
    d = _fittable(every).select("__x", "__y", "__fold")
    d = d.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        n = d.count()
        base = _wired(build_model(name, n))
        maps = []
        for s in tried:
            special = _wired(build_model(name, n, **s))
            maps.append({base.getParam(q.name): v for q, v in special.extractParamMap().items() if special.isSet(q)})
        judge = MulticlassClassificationEvaluator(labelCol="__y", predictionCol="__c", metricName="fMeasureByLabel", metricLabel=1.0)
        cv = CrossValidator(estimator=base, estimatorParamMaps=maps, evaluator=judge, numFolds=folds, foldCol="__fold", parallelism=parallelism)
        fitted = cv.fit(d)
        scores = fitted.avgMetrics
    finally:
        d.unpersist()
    best = max(range(len(tried)), key=lambda i: (scores[i], -i))
    rows = [(i, name, str(s), float(v), i == best) for i, (s, v) in enumerate(zip(tried, scores))]
    table = df.sparkSession.createDataFrame(rows, "trial int, model string, setting string, f1 double, best boolean")
    return tried[best], table, fitted.bestModel


def oof_predict(
    df: DataFrame, features: Sequence[str], label: str, fold: str, name: str = "logreg", **params: Any
) -> DataFrame:
    """Out-of-fold probability of every row: each fold scored by a model fitted on the others."""
    plain = _with_features(df, features, label)
    d = _fittable(plain).select("__x", "__y", fold).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        sizes = {r[fold]: r["count"] for r in d.groupBy(fold).count().collect()}
        n = sum(sizes.values())
        fitted = {}
        for f in sorted(sizes):
            est = _wired(build_model(name, n - sizes[f], **params))
            fitted[f] = est.fit(d.filter(F.col(fold) != f))
    finally:
        d.unpersist()
    out = None
    for f, model in fitted.items():
        part = _score(model, plain.filter(F.col(fold) == f)).drop("__x", "__y")
        out = part if out is None else out.unionByName(part)
    return out


def _stored_folds(df: DataFrame, features: Sequence[str], label: str, row_id: str, folds: int, seed: int) -> DataFrame:
    """The needed columns with folds, written once by fold: each fit and each scoring reads only its folds."""
    slim = df.select(row_id, label, *features)
    return stored(stratified_folds(slim, label, row_id, folds, seed), "folds", "fold")


def cv_scores(df: DataFrame, features: Sequence[str], label: str, row_id: str, name: str = "logreg", folds: int = 5, seed: int = 42, threshold: float = 0.5) -> DataFrame:
    """Cross-validated accuracy and F1 over the rows that have a score."""
    folded = _stored_folds(df, features, label, row_id, folds, seed)
    scored = oof_predict(folded, features, label, "fold", name).filter(F.col("prob").isNotNull() & F.col(label).isNotNull())
    scored = scored.withColumn("__pred", (F.col("prob") >= threshold).cast("int"))
    return evaluate(scored, label, "prob", "__pred").select("accuracy", "f1")


def score_models(
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
) -> DataFrame:
    """Out-of-fold rows (model, id, y, prob, pred) of several models on shared folds; prob is NULL where a feature is missing."""
    folded = _stored_folds(df, features, label, row_id, folds, seed)
    out = None
    for name in models:
        if name not in MODELS:
            continue
        chosen = dict((settings or {}).get(name, {}))
        if spaces and name in spaces:
            best, _, _ = random_search(df, features, label, row_id, name, spaces[name], n_iter, seed)
            chosen |= best
        part = oof_predict(folded, features, label, "fold", name, **chosen)
        part = part.select(F.lit(name).alias("model"), row_id, F.col(label).cast("int").alias("y"), "prob", (F.col("prob") >= threshold).cast("int").alias("pred"))
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError(f"none of {list(models)} is available; choose from {list(MODELS)}")
    return out


def compare_models(df: DataFrame, features: Sequence[str], label: str, row_id: str, **kwargs: Any) -> DataFrame:
    """Metrics of each model over its out-of-fold scores, best ROC AUC first; all models in one pass."""
    scored = score_models(df, features, label, row_id, **kwargs).dropna(subset=["y", "prob"]).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        table = evaluate(scored, "y", "prob", "pred", ["model"])
        rows = table.collect()  # one row per model
    finally:
        scored.unpersist()
    return df.sparkSession.createDataFrame(rows, table.schema).orderBy(F.desc("roc_auc"), "model")


def kmeans_auto(
    df: DataFrame,
    features: Sequence[str],
    row_id: str,
    ks: Sequence[int] = (2, 3, 4, 5, 6),
    seed: int = 42,
) -> tuple[DataFrame, DataFrame]:
    """Cluster standardized features with the k of the highest silhouette (first on a tie).

    Returns the rows with ``cluster`` and the table (k, measure, silhouette, chosen).
    All k share the scans: one for each step of the fits, one for the sums of the clusters and one for the silhouettes,
    which take squared Euclidean distances and so need these sums only.
    """
    d = complete_rows(df, features)
    n = d.count()
    if n < 5:
        raise ValueError(f"{n} complete rows; clustering needs at least 5")
    z = [f"{c}__z" for c in features]
    std = standardize(d, features, 0, "__z")
    x = std.select(row_id, *z).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        tried = [k for k in dict.fromkeys(ks) if k < n]
        centres = fit_centres(x, z, row_id, tried, seed) if tried else None
        scores = centres.silhouettes(x) if centres else {}
    finally:
        x.unpersist()
    if not scores:
        raise ValueError("no k gave at least two clusters")
    best = max(scores, key=lambda k: (scores[k], -k))
    table = df.sparkSession.createDataFrame(
        [(k, "squaredEuclidean", float(v), k == best) for k, v in scores.items()], "k int, measure string, silhouette double, chosen boolean"
    )
    return std.withColumn("cluster", centres.nearest(best)).drop(*z), table


def mean_model(train: DataFrame, query: DataFrame, y: str, out: str = "y_hat") -> DataFrame:
    """The constant baseline: every query row gets the mean of y."""
    return attach_global(query, train, **{out: F.avg(y)})


__all__ = [
    "LogitModel", "MODELS", "build_model", "compare_models", "cv_scores", "encode_formula", "fit_logit",
    "fit_score", "kmeans_auto", "mean_model", "oof_predict", "random_search", "score_models", "standardize",
]

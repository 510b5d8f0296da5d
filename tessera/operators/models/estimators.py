"""Trees and MLlib-backed models (L3, L4, L7, L9-L13) and coefficient tables.

Parameter translations (scikit-learn names -> MLlib):
- C -> regParam = 1 / (C n) for logistic / linear SVM (same objective up to scale);
- ridge alpha -> regParam = alpha * stddev_pop(y) / n, elasticNetParam = 0
  (MLlib scales the L2 term by the label std);
- forests are grown by ``forest`` (unlimited depth, split size of the parent as it is);
- boosted trees are grown by ``boosting``: second-order gains, columns a tree, softmax for classes;
- max_bins: thresholds a feature that a tree looks at (256 unless given; an exact search has no such bound).
All fits but the trees standardise features with population statistics first.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import GBTClassifier, LogisticRegression, OneVsRest
from pyspark.ml.linalg import DenseVector
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.models import boosting, forest, gram, newton
from tessera.operators.models.base import OUTPUT_COLS, FittedModel, prepare_training
from tessera.operators.select import apply_scaler, index_target, label_of, target_labels


def _boosted_mllib(problem, p, n):
    cs = float(p.get("colsample_bytree", 1.0))
    args = dict(featuresCol="features", labelCol="_label", maxIter=int(p.get("n_estimators", 100)),
                maxDepth=int(p.get("max_depth", 6)), stepSize=float(p.get("learning_rate", 0.3)),
                subsamplingRate=float(p.get("subsample", 1.0)), seed=int(p.get("random_state", 42)),
                featureSubsetStrategy="all" if cs >= 1.0 else str(cs), maxBins=int(p.get("max_bins", 32)))
    if problem == "regression":
        return GBTRegressor(**args)
    if problem == "classification_binary":
        return GBTClassifier(**args)
    return OneVsRest(classifier=GBTClassifier(**args), featuresCol="features", labelCol="_label")


def _logistic(problem, p, n):
    C = float(p.get("C", 1.0))
    pen = p.get("penalty", "l2")
    enet = {"l2": 0.0, "l1": 1.0, "elasticnet": float(p.get("l1_ratio", 0.5)), "none": 0.0, None: 0.0}[pen]
    reg = 0.0 if pen in ("none", None) else 1.0 / (C * n)
    return LogisticRegression(featuresCol="features", labelCol="_label", regParam=reg, elasticNetParam=enet,
                              standardization=False, maxIter=int(p.get("max_iter", 100)),
                              tol=float(p.get("tol", 1e-4)))


def _linear(problem, p, n, y_std=1.0):
    return LinearRegression(featuresCol="features", labelCol="_label", regParam=0.0, solver="normal",
                            standardization=False)


def _ridge(problem, p, n, y_std=1.0):
    return LinearRegression(featuresCol="features", labelCol="_label",
                            regParam=float(p.get("alpha", 1.0)) * y_std / n, elasticNetParam=0.0,
                            standardization=False, solver="normal")


BUILDERS = {"boosted_trees_mllib": _boosted_mllib, "logistic": _logistic, "linear": _linear, "ridge": _ridge}


def fit_mllib(kind: str, df: DataFrame, target: str, features: list[str], problem: str,
              params: dict | None = None) -> FittedModel:
    """Fit one MLlib model; the training frame is cached for the iterations of the fit."""
    params = dict(params or {})
    d, stats, labels, base = prepare_training(df, target, features, problem)
    d = d.select("features", "_label")
    try:
        agg = d.agg(F.count("*").alias("n"), F.stddev_pop("_label").alias("s")).collect()[0]
        n, y_std = agg["n"], agg["s"] or 1.0
        b = BUILDERS[kind]
        est = b(problem, params, n, y_std) if kind in ("linear", "ridge") else b(problem, params, n)
        model = est.fit(d)
    finally:
        base.unpersist()
    return FittedModel(kind, problem, features, stats, labels, model, {"params": params})


def forest_spec(problem: str, params: dict, features: int, classes: int, shift: float) -> forest.Spec:
    """scikit-learn's parameters and defaults: 100 trees, no depth limit, sqrt(features) a node for classes, all (None) for values."""
    depth, tries = params.get("max_depth"), params.get("max_features", None if problem == "regression" else "sqrt")
    tries = max(1, math.isqrt(features)) if tries == "sqrt" else max(1, int(tries * features)) if isinstance(tries, float) else tries
    return forest.Spec(trees=int(params.get("n_estimators", 100)), depth=None if depth is None else int(depth), min_split=int(params.get("min_samples_split", 2)),
                       classes=classes, tries=tries,
                       bootstrap=bool(params.get("bootstrap", True)), seed=int(params.get("random_state", 42)), shift=shift)


def forest_rows(df: DataFrame, target: str, features: list[str], problem: str, params: dict, key: list[str] | None = None, fold=None):
    """(binned table, bins, labels, mean of the target) for rows without missing values."""
    base = df.na.drop("any", subset=list(dict.fromkeys([target, *features])))
    labels, shift = None, 0.0
    if problem == "regression":
        y = F.col(f"`{target}`").cast("double")
        shift = float(base.agg(F.avg(y)).first()[0] or 0.0)
    else:
        labels = target_labels(base, target)
        if not labels:
            raise ValueError("no rows to learn from")
        base, _ = index_target(base, target, labels, "_label")
        y = F.col("_label")
    bins = forest.fit_bins(base, features, min(int(params.get("max_bins", forest.MAX_BINS)), forest.MAX_BINS))
    return forest.binned_table(base, features, bins, y, F.lit(-1) if fold is None else fold, key), bins, labels, shift


def random_forest(df, target, features, problem, key: list[str] | None = None, **params):
    """L3 / L4.  ``key`` names the columns whose hash draws a row into a tree (all columns unless given)."""
    rows, bins, labels, shift = forest_rows(df, target, features, problem, params, key)
    spec = forest_spec(problem, params, len(features), len(labels or []), shift)
    trees = forest.fit_trees(rows, spec, bins, params.get("local_rows"))
    if not trees:
        raise ValueError("no rows to learn from")
    return FittedModel("random_forest", problem, features, None, labels, trees, {"params": params, "bins": bins, "predict": predict_forest})


def predict_forest(fm: FittedModel, df: DataFrame) -> DataFrame:
    """Mean of the trees' values or class probabilities (ties: the first label)."""
    return _predicted(fm, df, forest.forest_values(df.sparkSession, fm.model, fm.features))


def _predicted(fm: FittedModel, df: DataFrame, values) -> DataFrame:
    keep = [c for c in df.columns if c not in OUTPUT_COLS]
    out = df.drop(*OUTPUT_COLS).withColumn("probability", values)
    if fm.problem == "regression":
        return out.select(*keep, F.col("probability")[0].alias("prediction"))
    at = (F.array_position("probability", F.array_max("probability")) - 1).cast("double")
    out = out.withColumn("_at", at)
    score = [F.col("probability")[1].alias("score")] if fm.problem == "classification_binary" and len(fm.labels) > 1 else []
    return out.select(*keep, label_of(fm.labels, "_at", "prediction"), "probability", *score)


def boosted_trees(df, target, features, problem, key: list[str] | None = None, **params):
    """L12 / L13, one model for all classes.  ``key`` names the columns whose hash keeps a row under ``subsample`` (all columns unless given)."""
    rows, bins, labels, mean = forest_rows(df, target, features, problem, params, key)
    classes, base = 0, mean
    if problem != "regression":
        classes = max(2, len(labels))
        share = rows.agg(F.avg("y")).first()[0] if classes == 2 else None
        base = 0.0 if share is None else math.log(min(max(share, 1e-6), 1 - 1e-6) / (1 - min(max(share, 1e-6), 1 - 1e-6)))
    p = {"n_estimators": 100, "max_depth": 6, "learning_rate": 0.3, "subsample": 1.0, "colsample_bytree": 1.0, "reg_lambda": 1.0, "gamma": 0.0,
         "min_child_weight": 1.0, "random_state": 42} | params
    spec = boosting.Spec(int(p["n_estimators"]), int(p["max_depth"]), float(p["learning_rate"]), classes, float(p["subsample"]), float(p["colsample_bytree"]),
                         float(p["reg_lambda"]), float(p["gamma"]), float(p["min_child_weight"]), int(p["random_state"]), float(base))
    rounds = boosting.fit(rows, spec, len(features))
    return FittedModel("boosted_trees", problem, features, None, labels, rounds, {"params": params, "bins": bins, "spec": spec, "predict": predict_boosted})


def boosted_trees_mllib(df, target, features, problem, **params):
    """First-order boosting as MLlib has it (labels -1 and 1, columns a node, one-vs-rest)."""
    return fit_mllib("boosted_trees_mllib", df, target, features, problem, params)


def predict_boosted(fm: FittedModel, df: DataFrame) -> DataFrame:
    """Values, or the label of the largest probability (ties: the first label)."""
    return _predicted(fm, df, boosting.boosted_values(df.sparkSession, fm.extra["spec"], fm.model, fm.extra["bins"], fm.features))


def logistic_regression(df, target, features, problem="classification_binary", **params):
    """Newton steps for smooth penalties (l2, none), MLlib's for l1 and elastic net."""
    penalty = params.get("penalty", "l2")
    if penalty not in ("l2", "none", None):
        return fit_mllib("logistic", df, target, features, problem, params)
    d, stats, labels, base = prepare_training(df, target, features, problem)
    try:
        rows = apply_scaler(stats, base)
        rows, _ = index_target(rows, target, labels)
        rows = rows.select(*[F.col(f"`{c}`").cast("double").alias(f"x{i}") for i, c in enumerate(features)], F.col("_label").alias("y"))
        n = base.count()
        if not n:
            raise ValueError("no rows to learn from")
        w = newton.fit(rows, len(features), n, len(labels), float(params.get("C", 1.0)) if penalty == "l2" else None)
    finally:
        base.unpersist()
    model = LogisticFit(w, DenseVector(w[0, 1:]) if len(w) == 1 else None, float(w[0, 0]) if len(w) == 1 else None)
    return FittedModel("logistic", problem, features, stats, labels, model, {"params": params, "predict": predict_logistic})


@dataclass
class LogisticFit:
    """Weights (a row a class; one row for two classes), intercepts first; ``coefficients`` and ``intercept`` of two classes as MLlib names them."""

    weights: np.ndarray
    coefficients: DenseVector | None
    intercept: float | None


def predict_logistic(fm: FittedModel, df: DataFrame) -> DataFrame:
    """Probabilities as column expressions (missing where a feature is), and the label of the largest (ties: the first)."""
    z = [(F.col(f"`{c}`").cast("double") - F.lit(fm.scaler[c][0])) / F.lit(fm.scaler[c][1]) for c in fm.features]

    def margin(w):
        out = F.lit(float(w[0]))
        for b, x in zip(w[1:], z):
            out = out + F.lit(float(b)) * x
        return out

    margins = [margin(w) for w in fm.model.weights]
    if len(margins) == 1:
        p = 1.0 / (1.0 + F.exp(-margins[0]))
        values = F.array(1.0 - p, p)
    else:
        top = F.greatest(*margins)
        e = [F.exp(m - top) for m in margins]
        total = sum(e[1:], e[0])
        values = F.array(*[v / total for v in e])
    return _predicted(fm, df, values)


def linear_regression(df, target, features, **params):
    """L9 (OLS)."""
    return fit_mllib("linear", df, target, features, "regression", params)


def lasso(df, target, features, **params):
    """L10, by coordinate descent on the Gram matrix of one pass."""
    model, stats = gram.fit(df, target, features, "lasso", float(params.get("alpha", 1.0)))
    return FittedModel("lasso", "regression", features, stats, None, model, {"params": params, "predict": predict_linear})


def predict_linear(fm: FittedModel, df: DataFrame) -> DataFrame:
    """intercept + coefficients times the standardised features (missing where a feature is)."""
    keep = [c for c in df.columns if c not in OUTPUT_COLS]
    value = F.lit(float(fm.model.intercept))
    for c, b in zip(fm.features, fm.model.coefficients.toArray()):
        mean, std = fm.scaler[c]
        value = value + F.lit(float(b)) * (F.col(f"`{c}`").cast("double") - F.lit(mean)) / F.lit(std)
    return df.select(*keep, value.alias("prediction"))


def ridge(df, target, features, **params):
    """L11."""
    return fit_mllib("ridge", df, target, features, "regression", params)


def feature_importances(fm: FittedModel) -> DataFrame:
    """Tree-model importances, descending."""
    from pyspark.sql import SparkSession
    spark = SparkSession.getActiveSession()
    imp = forest.tree_importances(fm.model, len(fm.features)) if isinstance(fm.model, list) else fm.model.featureImportances.toArray()
    rows = sorted(zip(fm.features, [float(v) for v in imp]), key=lambda t: -t[1])
    return spark.createDataFrame(rows, "feature string, importance double")


def coefficient_table(fm: FittedModel) -> DataFrame:
    """Term, coefficient (intercept first, then features in column order),
    on the standardised scale, for linear and binary logistic models."""
    from pyspark.sql import SparkSession
    spark = SparkSession.getActiveSession()
    m = fm.model
    if not hasattr(m, "coefficients"):
        raise ValueError("model has no single coefficient vector")
    rows = [("intercept", float(m.intercept))] + [(f, float(c)) for f, c in zip(fm.features, m.coefficients.toArray())]
    return spark.createDataFrame(rows, "term string, coefficient double")


def predict(fm: FittedModel, df: DataFrame) -> DataFrame:
    """Apply a fitted model to held-out rows (stateless; valid on streams)."""
    return fm.transform(df)

"""Shared model plumbing: feature scaling, assembly, label coding, fitted-model wrapper.

A fitted model is a set of column expressions (scaler statistics as
literals) + an MLlib model; ``transform`` is stateless, so it also applies
to a streaming DataFrame.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.select import apply_scaler, fit_scaler, index_target, label_of, target_labels

PROBLEMS = ("regression", "classification_binary", "classification_multi")


@dataclass
class FittedModel:
    kind: str
    problem: str
    features: list[str]
    scaler: dict | None
    labels: list | None
    model: object = None
    extra: dict = field(default_factory=dict)

    def prepare(self, df: DataFrame) -> DataFrame:
        x = apply_scaler(self.scaler, df) if self.scaler else df
        return VectorAssembler(inputCols=self.features, outputCol="features", handleInvalid="keep").transform(x)

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds ``prediction`` (original label / value) and, for classifiers
        with probabilities, ``score`` (class-1 probability) and ``probability`` (array)."""
        if "predict" in self.extra:
            return self.extra["predict"](self, df)
        out = self.model.transform(self.prepare(df.drop(*OUTPUT_COLS)))
        return finish_predictions(self, out, df.columns)


OUTPUT_COLS = ("prediction", "score", "probability")


def finish_predictions(fm: FittedModel, out: DataFrame, keep: list[str]) -> DataFrame:
    """Input columns (minus ones named like an output) + prediction [+ probability, score]."""
    cols = [F.col(c) for c in keep if c not in OUTPUT_COLS]
    if fm.problem == "regression":
        return out.select(*cols, F.col("prediction").cast("double").alias("prediction"))
    pred = label_of(fm.labels, "prediction", "prediction")
    extra = []
    if "probability" in out.columns or "rawPrediction" in out.columns and fm.problem == "classification_multi":
        arr = vector_to_array("probability") if "probability" in out.columns else one_vs_rest_probability(fm)
        extra.append(arr.alias("probability"))
        if fm.problem == "classification_binary":
            extra.append(arr[1].alias("score"))
    return out.select(*cols, pred, *extra)


def one_vs_rest_probability(fm: FittedModel):
    """Array of class probabilities of a one-vs-rest model: the classes' own probabilities, scaled to add up to 1.

    A class's own probability is 1 / (1 + exp(-(a * margin + b))); ``sigmoids`` holds (a, b) a class.
    """
    margins = vector_to_array("rawPrediction")
    sigmoids = fm.extra.get("sigmoids") or [(2.0, 0.0)] * len(fm.labels)   # boosting: the log-odds are twice the margin
    own = F.array(*[1.0 / (1.0 + F.exp(-(F.lit(a) * margins[i] + F.lit(b)))) for i, (a, b) in enumerate(sigmoids)])
    total = F.aggregate(own, F.lit(0.0), lambda t, v: t + v)
    return F.transform(own, lambda v: F.when(total > 0, v / total).otherwise(F.lit(1.0 / len(sigmoids))))


def prepare_training(df: DataFrame, target: str, features: list[str], problem: str, scale: bool = True):
    """(frame with _label, scaler stats, labels, persisted base).

    Rows with a missing value are dropped.  The selected rows are persisted
    once (MEMORY_AND_DISK) so the statistics passes and the iterations of
    the fit read them instead of re-scanning the source; the caller
    unpersists ``base`` after the fit."""
    if problem not in PROBLEMS:
        raise ValueError(f"problem must be one of {PROBLEMS}")
    from pyspark import StorageLevel
    d = df.select(*dict.fromkeys([target, *features])).na.drop("any").persist(StorageLevel.MEMORY_AND_DISK)
    base = d
    stats = fit_scaler(d, features) if scale else None
    labels = None
    if problem == "regression":
        d = d.withColumn("_label", F.col(target).cast("double"))
    else:
        labels = target_labels(d, target)
        d, _ = index_target(d, target, labels)
    if stats:
        d = apply_scaler(stats, d)
    d = VectorAssembler(inputCols=features, outputCol="features").transform(d)
    return d, stats, labels, base

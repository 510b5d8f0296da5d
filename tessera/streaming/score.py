"""Scoring a stream with a fitted model.

Predictions of the MLlib-backed models and of naive Bayes are stateless
projections (scaler literals + model transform), so they apply unchanged to
a streaming DataFrame; KNN needs a per-row top-k aggregation and is batch-only.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame

from tessera.operators.models.base import FittedModel
from tessera.session import checkpoint_dir

STATELESS = ("random_forest", "boosted_trees", "logistic", "linear", "lasso", "ridge", "naive_bayes", "svm")


def score_stream(fm: FittedModel, stream: DataFrame) -> DataFrame:
    if fm.kind not in STATELESS:
        raise ValueError(f"{fm.kind} predictions are not a stateless projection")
    return fm.transform(stream)


def write_scores(scored: DataFrame, path: str, name: str = "scores", available_now: bool = True):
    """Append predictions as parquet; progress is kept under the shared checkpoint folder."""
    spark = scored.sparkSession
    w = (scored.writeStream.format("parquet").option("path", path)
         .option("checkpointLocation", os.path.join(checkpoint_dir(spark), f"stream-{name}"))
         .outputMode("append"))
    if available_now:
        w = w.trigger(availableNow=True)
    return w.start()

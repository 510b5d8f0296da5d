"""Principal components (A9) and loadings (A10).

Features are standardised with population statistics (MLlib's ``PCA``
does not centre), the covariance is a d x d tree aggregate inside
``PCA.fit``, and scores are column expressions with the loadings as
literals (no UDF).  Sign rule: the largest-|loading| entry of every
component is positive.  The id column is carried, so scores stay aligned
with their rows.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.explore import apply_standardize, standardize_stats


def pca_fit(df: DataFrame, cols: list[str], k: int = 3) -> dict:
    if len(cols) < 3:
        raise ValueError("PCA needs at least 3 features")
    d = df.select(*cols).na.drop("any")
    stats = standardize_stats(d, cols)
    z = VectorAssembler(inputCols=cols, outputCol="_v").transform(apply_standardize(d, stats))
    n = z.count()
    model = PCA(k=k, inputCol="_v", outputCol="_p").fit(z)
    pc = np.array(model.pc.toArray(), copy=True)  # d x k
    for j in range(pc.shape[1]):
        i = int(np.argmax(np.abs(pc[:, j])))
        if pc[i, j] < 0:
            pc[:, j] = -pc[:, j]
    total_var = len(cols) * n / max(1, n - 1)     # trace of the sample covariance of z-scores
    eig = [float(r) * total_var for r in model.explainedVariance.toArray()]
    return {"cols": cols, "stats": stats, "pc": pc.tolist(), "eigen": eig,
            "ratio": [float(r) for r in model.explainedVariance.toArray()]}


def pca(df: DataFrame, id_col: str, cols: list[str], k: int = 3, fit: dict | None = None) -> DataFrame:
    """Id, pc1..pck for every complete row."""
    fit = fit or pca_fit(df, cols, k)
    z = apply_standardize(df.select(F.col(id_col).alias("__id"), *cols).na.drop("any"), fit["stats"])
    pc = fit["pc"]
    scores = [sum((F.col(c) * F.lit(float(pc[i][j])) for i, c in enumerate(cols)), F.lit(0.0)).alias(f"pc{j + 1}")
              for j in range(len(pc[0]))]
    return z.select(F.col("__id").alias(id_col), *scores)


def pca_loadings(df: DataFrame, fit: dict) -> DataFrame:
    """A10: feature, component, loading, loading * sqrt(eigenvalue), explained variance ratio."""
    spark = df.sparkSession
    rows = []
    for i, c in enumerate(fit["cols"]):
        for j, (e, r) in enumerate(zip(fit["eigen"], fit["ratio"])):
            v = float(fit["pc"][i][j])
            rows.append((c, j + 1, v, v * math.sqrt(max(e, 0.0)), r))
    return spark.createDataFrame(rows, "feature string, component int, loading double, loading_scaled double, "
                                       "explained_variance_ratio double")

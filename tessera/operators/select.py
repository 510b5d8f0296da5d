"""ML preparation and model-selection helpers (M1-M4, M6-M8).

Splits and folds are functions of a hash of the row key and a seed, so they
are reproducible and do not depend on partitioning or task retries (unlike
``randomSplit``/``rand``).
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.exprs import hash_key, hash_unit
from tessera.operators.explore import apply_standardize, standardize_stats

MAX_CLASSES = 10_000


def split_column(key: list[str], test: float = 0.2, seed: int = 42):
    return F.when(hash_unit(key, seed) < F.lit(float(test)), F.lit("test")).otherwise(F.lit("train"))


def train_test_split(df: DataFrame, key: list[str], test: float = 0.2, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """M1: random, unstratified split (test share 5..50 %) by a seeded hash of ``key``."""
    if not 0.05 <= test <= 0.5:
        raise ValueError("test share must be within 0.05..0.5")
    tagged = df.withColumn("_split", split_column(key, test, seed))
    return (tagged.where("_split = 'train'").drop("_split"), tagged.where("_split = 'test'").drop("_split"))


def fit_scaler(train: DataFrame, cols: list[str]) -> dict[str, tuple[float, float]]:
    """M2: population mean/std per column (zero std -> 1), from one aggregate over train."""
    return standardize_stats(train, cols)


def apply_scaler(stats: dict[str, tuple[float, float]], df: DataFrame) -> DataFrame:
    """M2: apply train statistics to any frame (a projection; works on streams too)."""
    return apply_standardize(df, stats)


def target_labels(df: DataFrame, y: str) -> list:
    """Sorted distinct labels (bounded: at most MAX_CLASSES)."""
    labs = df.where(F.col(y).isNotNull()).select(y).distinct().limit(MAX_CLASSES + 1).collect()
    if len(labs) > MAX_CLASSES:
        raise ValueError(f"{y} has more than {MAX_CLASSES} classes")
    return sorted(r[0] for r in labs)


def index_target(df: DataFrame, y: str, labels: list | None = None, out: str = "_label") -> tuple[DataFrame, list]:
    """M3: labels -> 0..k-1 in sorted order (a literal map, no join); returns (frame, labels)."""
    labels = labels if labels is not None else target_labels(df, y)
    m = F.create_map(*itertools.chain.from_iterable((F.lit(v), F.lit(float(i))) for i, v in enumerate(labels)))
    return df.withColumn(out, m[F.col(y)]), labels


def label_of(labels: list, col: str = "prediction", out: str = "predicted_label"):
    """M3 inverse: code -> original label."""
    m = F.create_map(*itertools.chain.from_iterable((F.lit(float(i)), F.lit(v)) for i, v in enumerate(labels)))
    return m[F.col(col).cast("double")].alias(out)


def assign_folds(df: DataFrame, key: list[str], k: int = 5, stratify: str | None = None, seed: int = 42,
                 out: str = "_fold") -> DataFrame:
    """M4: k folds (2..10) of sizes that differ by at most one, in all or (``stratify``) within each class.

    Rows in the order of (hash, key) get fold = rank mod k.  The hash is uniform, so equal ranges of it hold
    equal shares of the rows: a window numbers one range of one class, and the rows of the ranges before it
    come from a table of counts.  No window holds a whole class and nothing reaches the driver.
    """
    if not 2 <= k <= 10:
        raise ValueError("k must be within 2..10")
    ranges = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    own = ["__fold_class", "__fold_hash", "__fold_range"]
    tagged = df.withColumn(own[0], F.col(stratify) if stratify else F.lit(0)).withColumn(own[1], hash_key(key, seed))
    tagged = tagged.withColumn(own[2], F.floor(F.col(own[1]) / F.lit(4294967296.0 / ranges)).cast("int"))
    earlier = Window.partitionBy("__class").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    before = (tagged.groupBy(F.col(own[0]).alias("__class"), F.col(own[2]).alias("__range")).agg(F.count("*").alias("__n"))
              .select("__class", "__range", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before")))
    rank = F.row_number().over(Window.partitionBy(own[0], own[2]).orderBy(own[1], *key)) - 1
    joined = tagged.join(before, F.col(own[0]).eqNullSafe(F.col("__class")) & (F.col(own[2]) == F.col("__range")))
    return (joined.withColumn(out, ((rank + F.col("__before")) % k).cast("int"))
            .drop(*own, "__class", "__range", "__before"))


def cv_summary(results: DataFrame, refit_metric: str, higher_is_better: bool = True) -> DataFrame:
    """M6: for the best candidate (by mean of ``refit_metric``): metric, mean, std (population) per metric.

    ``results``: params (string), fold, metric, score.  Error metrics are
    reported positive (scores are stored positive here).
    """
    stats = results.groupBy("params", "metric").agg(F.avg("score").alias("mean"), F.stddev_pop("score").alias("std"))
    order = F.desc("mean") if higher_is_better else F.asc("mean")
    best = stats.where(F.col("metric") == refit_metric).orderBy(order, "params").limit(1).select("params")
    return stats.join(F.broadcast(best), "params").select("params", "metric", "mean", "std")


def cv_results_table(results: DataFrame, metric: str, higher_is_better: bool = True) -> DataFrame:
    """M7: rank (ties share the lowest rank), mean, std, params ordered by rank."""
    stats = (results.where(F.col("metric") == metric).groupBy("params")
             .agg(F.avg("score").alias("mean"), F.stddev_pop("score").alias("std")))
    order = F.desc("mean") if higher_is_better else F.asc("mean")
    # one row per candidate: the window is bounded by the grid size
    return stats.select(F.rank().over(Window.orderBy(order)).alias("rank"), "mean", "std", "params") \
        .orderBy("rank", "params")


# ---------------------------------------------------------------------------
# M8: parameter grids
# ---------------------------------------------------------------------------
# Default grids and allowed choices per model family.
DEFAULT_GRIDS = {
    "knn": {"n_neighbors": [3, 5], "weights": ["uniform"], "metric": ["euclidean"]},
    "random_forest": {"n_estimators": [100, 200], "max_depth": [10, 20], "min_samples_split": [2, 5]},
    "boosted_trees": {"n_estimators": [100, 200], "max_depth": [3, 5], "learning_rate": [0.1], "subsample": [1.0],
                      "colsample_bytree": [1.0]},
    "svm": {"C": [1.0, 10.0], "kernel": ["rbf"], "degree": [3], "gamma": ["scale"]},
    "logistic": {"C": [1.0], "penalty": ["l2"], "solver": ["lbfgs"]},
    "naive_bayes": {"var_smoothing": [1e-9]},
    "lasso": {"alpha": [0.1, 1.0]},
    "ridge": {"alpha": [0.1, 1.0]},
    "linear": {},
}
# Parameters that every grid of a family must name.
NECESSARY = {
    "knn": ["n_neighbors", "weights", "metric"],
    "random_forest": ["n_estimators", "max_depth", "min_samples_split"],
    "boosted_trees": ["n_estimators", "max_depth", "learning_rate", "subsample", "colsample_bytree"],
    "svm": ["C", "kernel"],
    "logistic": ["C"],
    "naive_bayes": ["var_smoothing"],
    "lasso": ["alpha"],
    "ridge": ["alpha"],
    "linear": [],
}
KNN_METRICS = ["euclidean", "manhattan", "chebyshev", "cosine"]
KNN_WEIGHTS = ["uniform", "distance"]
# kernel -> the parameters it reads besides C.
SVM_KERNELS = {"linear": [], "poly": ["degree", "gamma"], "rbf": ["gamma"], "sigmoid": ["gamma"]}
# solver -> penalties it supports (scikit-learn's documented compatibility); None: no penalty.
LOGISTIC_SOLVER_PENALTIES = {
    "lbfgs": ["l2", None],
    "liblinear": ["l1", "l2"],
    "newton-cg": ["l2", None],
    "newton-cholesky": ["l2", None],
    "sag": ["l2", None],
    "saga": ["l1", "l2", "elasticnet", None],
}
ELASTICNET_L1_RATIOS = [0.1, 0.5, 0.9]


def _combinations(spec: dict) -> list[dict]:
    return [dict(zip(spec, vals)) for vals in itertools.product(*spec.values())]


def build_param_grid(model: str, spec: dict | None = None) -> list[dict]:
    """M8: all compatible combinations of the given lists.

    Errors: an unknown family, an empty list, a missing necessary parameter, an unknown choice, no combination
    left.  Logistic: pairs of solver and penalty that do not go together are left out; elastic net takes the
    given ``l1_ratio`` or 0.1, 0.5 and 0.9; without a penalty (None or 'none') C has no meaning, so there is one
    candidate.  SVM: a kernel carries only the parameters that it reads.
    """
    if model not in DEFAULT_GRIDS:
        raise ValueError(f"unknown model {model!r}")
    spec = dict(DEFAULT_GRIDS[model] if spec is None else spec)
    for name, vals in spec.items():
        if not isinstance(vals, (list, tuple)) or len(vals) == 0:
            raise ValueError(f"parameter {name!r} needs a non-empty list of values")
    missing = [name for name in NECESSARY[model] if name not in spec]
    if missing:
        raise ValueError(f"missing parameters {missing}")
    choices = {"knn": {"metric": KNN_METRICS, "weights": KNN_WEIGHTS}, "svm": {"kernel": SVM_KERNELS},
               "logistic": {"solver": LOGISTIC_SOLVER_PENALTIES}}.get(model, {})
    for name, allowed in choices.items():
        bad = [v for v in spec.get(name, []) if v not in allowed]
        if bad:
            raise ValueError(f"unsupported values {bad} of {name!r}")
    if model == "logistic":
        combos = _logistic_grid(spec)
    elif model == "svm":
        others = {n: v for n, v in spec.items() if n not in ("kernel", "degree", "gamma")}
        combos = [c for kernel in spec["kernel"] for c in _combinations(
            {"kernel": [kernel], **others, **{n: spec[n] for n in SVM_KERNELS[kernel] if n in spec}})]
    else:
        combos = _combinations(spec)
    unique = []
    for c in combos:
        if c not in unique:
            unique.append(c)
    if not unique:
        raise ValueError("no compatible parameter combination")
    return unique


def _logistic_grid(spec: dict) -> list[dict]:
    rest = {n: v for n, v in spec.items() if n not in ("solver", "penalty", "l1_ratio")}
    ratios = spec.get("l1_ratio", ELASTICNET_L1_RATIOS)
    combos = []
    for solver in spec.get("solver", ["lbfgs"]):
        for penalty in [None if p == "none" else p for p in spec.get("penalty", ["l2"])]:
            if penalty not in LOGISTIC_SOLVER_PENALTIES[solver]:
                continue
            pair = {"solver": [solver], "penalty": [penalty]}
            if penalty == "elasticnet":
                pair["l1_ratio"] = ratios
            combos += _combinations({**pair, **rest, **({"C": [1.0]} if penalty is None else {})})
    return combos

"""Target choice and exploratory aggregates.

Each view is one or two aggregates returning a small frame; no raw rows are
collected.  Distinct-value reduction (``groupBy(value).count()``, map-side
combined) is used before any per-value fan-out so repeated values cost once.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.exprs import nan_to_null
from tessera.functions.quantiles import quantiles
from tessera.operators.profile import column_facts

TARGET_AUTOTYPES = ("Continuous", "Binary", "Categorical", "Boolean")
# Semantic type -> learning problem (Boolean is trained as binary after 0/1 conversion).
PROBLEM_TYPES = {"Continuous": "regression", "Binary": "classification_binary",
                 "Categorical": "classification_multi", "Boolean": "classification_binary"}


def eligible_targets(df: DataFrame, facts: dict | None = None) -> DataFrame:
    """G1: columns usable as a target: variable, autotype."""
    facts = facts or column_facts(df)
    rows = [(c, f["autotype"]) for c, f in facts.items() if f["autotype"] in TARGET_AUTOTYPES]
    return df.sparkSession.createDataFrame(rows, "variable string, autotype string")


def detect_problem_type(df: DataFrame, target: str, facts: dict | None = None) -> str | None:
    """Regression / classification_binary / classification_multi (None if not a target)."""
    facts = facts or column_facts(df, [target])
    return PROBLEM_TYPES.get(facts[target]["autotype"])


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """A1: value, count (missing included as NULL), most frequent first."""
    return (df.groupBy(F.col(col).alias("value")).agg(F.count("*").alias("count"))
            .orderBy(F.desc("count"), F.asc_nulls_last("value")))


def moments(df: DataFrame, col: str, exact: bool = True) -> DataFrame:
    """A2: n, mean, median, bias-corrected skewness (G1) and excess kurtosis.

    Spark's ``skewness``/``kurtosis`` are the population g1, g2; the
    corrections are G1 = g1 sqrt(n(n-1))/(n-2), G2 = (n-1)/((n-2)(n-3)) ((n+1) g2 + 6).
    """
    x = nan_to_null(col)
    med = quantiles(df, [col], [0.5], exact=exact)[col][0]
    n = F.col("n")
    agg = df.agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.skewness(x).alias("g1"),
                 F.kurtosis(x).alias("g2"))
    return agg.select(
        F.lit(col).alias("variable"), "n", "mean", F.lit(med).cast("double").alias("median"),
        F.when(n > 2, F.col("g1") * F.sqrt(n * (n - 1)) / (n - 2)).alias("skewness"),
        F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("g2") + 6)).alias("kurtosis"))


def _minmax(df: DataFrame, cols: list[str]) -> dict[str, tuple[float, float]]:
    r = df.agg(*[F.min(nan_to_null(c)).alias(f"a{i}") for i, c in enumerate(cols)],
               *[F.max(nan_to_null(c)).alias(f"b{i}") for i, c in enumerate(cols)]).collect()[0]
    return {c: (r[f"a{i}"], r[f"b{i}"]) for i, c in enumerate(cols)}


def _bin_expr(x, lo: float, hi: float, bins: int):
    width = (hi - lo) / bins
    if width == 0:
        return F.when(x.isNotNull(), F.lit(0))
    return F.least(F.floor((x - F.lit(lo)) / F.lit(width)), F.lit(bins - 1)).cast("int")


def histogram(df: DataFrame, col: str, bins: int = 30) -> DataFrame:
    """A3: bin, lo, hi, count over ``bins`` equal-width bins of [min, max] (2..150), empty bins kept."""
    if not 2 <= bins <= 150:
        raise ValueError("bins must be within 2..150")
    lo, hi = _minmax(df, [col])[col]
    spark = df.sparkSession
    if lo is None:
        return spark.createDataFrame([], "bin int, lo double, hi double, count long")
    x = nan_to_null(col)
    width = (hi - lo) / bins
    counts = df.select(_bin_expr(x, lo, hi, bins).alias("bin")).where("bin IS NOT NULL").groupBy("bin").count()
    grid = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    return (grid.join(F.broadcast(counts), "bin", "left")   # at most `bins` rows on each side
            .select("bin", (F.lit(lo) + F.col("bin") * F.lit(width)).alias("lo"),
                    (F.lit(lo) + (F.col("bin") + 1) * F.lit(width)).alias("hi"),
                    F.coalesce(F.col("count"), F.lit(0)).cast("long").alias("count")))


def kde(df: DataFrame, col: str, points: int = 500) -> DataFrame:
    """A4: Gaussian KDE with Scott's bandwidth (h = sample std * n^(-1/5)) on a
    ``points`` grid over [min, max]: point, x, density.

    Exact: each task adds the kernels of its own rows (equal values of a batch once) to the grid, and the
    ``points`` sums of the tasks are added up.  Rows are not shuffled.
    """
    x = nan_to_null(col)
    r = df.agg(F.count(x).alias("n"), F.stddev_samp(x).alias("s"), F.min(x).alias("a"),
               F.max(x).alias("b")).collect()[0]
    spark = df.sparkSession
    n = r["n"]
    if not n or r["s"] is None or r["s"] == 0:
        return spark.createDataFrame([], "point int, x double, density double")
    h = r["s"] * n ** (-1.0 / 5.0)
    grid = np.linspace(r["a"], r["b"], points)
    norm = 1.0 / (n * h * math.sqrt(2 * math.pi))

    def sums(batches):
        import numpy as np
        import pandas as pd

        total = np.zeros(len(grid))
        for batch in batches:
            values, counts = np.unique(batch["v"].to_numpy(dtype=float), return_counts=True)
            for i in range(0, len(values), 2048):
                z = (grid[:, None] - values[None, i:i + 2048]) / h
                total += np.exp(-0.5 * z * z) @ counts[i:i + 2048]
        yield pd.DataFrame({"point": np.arange(len(grid), dtype="int32"), "x": grid, "t": total})

    parts = df.select(x.alias("v")).where("v IS NOT NULL").mapInPandas(sums, "point int, x double, t double")
    return parts.groupBy("point", "x").agg((F.sum("t") * F.lit(norm)).alias("density"))


def kde_binned(df: DataFrame, col: str, points: int = 500, per: int = 32, reach: float = 5.0) -> DataFrame:
    """A4 with a stated error: point, x, density, bound (largest difference from :func:`kde`).

    Each value is dealt to its two neighbouring bins of width h / ``per`` (linear binning); bin weights are map-side combined
    sums, so only bins are shuffled, and the kernel is evaluated a bin, up to ``reach`` bandwidths away.  Linear interpolation
    over the bin width errs by at most width^2 / 8 times the kernel's largest second derivative, 1 / (h^3 sqrt(2 pi)), and the
    cut tail by at most the kernel at ``reach``.
    """
    x = nan_to_null(col)
    r = df.agg(F.count(x).alias("n"), F.stddev_samp(x).alias("s"), F.min(x).alias("a"),
               F.max(x).alias("b")).collect()[0]
    spark = df.sparkSession
    n = r["n"]
    if not n or r["s"] is None or r["s"] == 0:
        return spark.createDataFrame([], "point int, x double, density double, bound double")
    h = r["s"] * n ** (-1.0 / 5.0)
    peak = 1.0 / (h * math.sqrt(2 * math.pi))
    bound = peak * (1.0 / (8 * per * per) + math.exp(-0.5 * reach * reach))
    low, step = F.lit(r["a"]), (r["b"] - r["a"]) / (points - 1)
    at = (F.col("v") - low) / F.lit(h / per)
    down = F.floor(at)
    halves = F.explode(F.array(F.struct(down.alias("j"), (1 - (at - down)).alias("w")), F.struct((down + 1).alias("j"), (at - down).alias("w"))))
    bins = (df.select(x.alias("v")).where("v IS NOT NULL").select(halves.alias("p"))
            .groupBy("p.j").agg(F.sum("p.w").alias("w")))
    away = F.lit((reach + 0.5 / per) * h)      # half a bin more, so that no bin lies just at the end
    mid = F.col("j") * F.lit(h / per)
    first = F.greatest(F.ceil((mid - away) / F.lit(step)), F.lit(0))
    last = F.least(F.floor((mid + away) / F.lit(step)), F.lit(points - 1))
    near = bins.where(first <= last).select("w", mid.alias("m"), F.explode(F.sequence(first, last)).alias("point"))
    z = (F.col("point") * F.lit(step) - F.col("m")) / F.lit(h)
    sums = near.groupBy("point").agg(F.sum(F.col("w") * F.exp(F.lit(-0.5) * z * z)).alias("t"))
    grid = spark.range(points).select(F.col("id").alias("point"))
    return (grid.join(F.broadcast(sums), "point", "left")   # at most `points` rows on each side
            .select(F.col("point").cast("int").alias("point"),
                    F.when(F.col("point") == points - 1, F.lit(r["b"])).otherwise(F.col("point") * F.lit(step) + low).alias("x"),
                    (F.coalesce("t", F.lit(0.0)) * F.lit(peak / n)).alias("density"), F.lit(bound).alias("bound")))


def box_stats(df: DataFrame, col: str, k: float = 1.5, exact: bool = True) -> DataFrame:
    """A5: q1, median, q3, whiskers (furthest values within k IQR), outlier count, min, max."""
    q1, med, q3 = quantiles(df, [col], [0.25, 0.5, 0.75], exact=exact)[col]
    x = nan_to_null(col)
    spark = df.sparkSession
    if q1 is None:
        return spark.createDataFrame([], "variable string, q1 double, median double, q3 double, "
                                         "lower_whisker double, upper_whisker double, n_outliers long, "
                                         "min double, max double")
    lo, hi = q1 - k * (q3 - q1), q3 + k * (q3 - q1)
    return df.agg(
        F.lit(col).alias("variable"), F.lit(q1).alias("q1"), F.lit(med).alias("median"), F.lit(q3).alias("q3"),
        F.min(F.when(x >= lo, x)).alias("lower_whisker"), F.max(F.when(x <= hi, x)).alias("upper_whisker"),
        F.count(F.when((x < lo) | (x > hi), 1)).cast("long").alias("n_outliers"),
        F.min(x).alias("min"), F.max(x).alias("max"))


def box_outliers(df: DataFrame, col: str, k: float = 1.5, exact: bool = True) -> DataFrame:
    """A5 (rows): the rows drawn as outlier points (a filter, nothing collected)."""
    q1, q3 = quantiles(df, [col], [0.25, 0.75], exact=exact)[col]
    if q1 is None:
        return df.limit(0)
    lo, hi = q1 - k * (q3 - q1), q3 + k * (q3 - q1)
    x = nan_to_null(col)
    return df.where((x < lo) | (x > hi))


def qq_points(df: DataFrame, col: str, m: int = 100, exact: bool = True) -> DataFrame:
    """I, prob, theoretical (standard normal quantile of (i - 0.5)/m), sample quantile."""
    probs = [(i - 0.5) / m for i in range(1, m + 1)]
    sample = quantiles(df, [col], probs, exact=exact)[col]
    nd = NormalDist()
    rows = [(i + 1, p, nd.inv_cdf(p), s) for i, (p, s) in enumerate(zip(probs, sample))]
    return df.sparkSession.createDataFrame(rows, "i int, prob double, theoretical double, sample double")


def pair_grid(df: DataFrame, cols: list[str], hue: str | None = None, bins: int = 10) -> DataFrame:
    """Binned scatter matrix: x_var, y_var, bin_x, bin_y, [hue], count.

    Off-diagonal pairs (i < j) give 2-D bin counts, the diagonal
    (x_var = y_var) the histogram of each variable.  One min/max aggregate,
    then one Expand over all pairs and one aggregate; output size is bounded
    by pairs x bins^2 x hue levels.
    """
    mm = _minmax(df, cols)
    b = {c: _bin_expr(nan_to_null(c), mm[c][0], mm[c][1], bins) if mm[c][0] is not None
         else F.lit(None).cast("int") for c in cols}
    items = []
    for i, xc in enumerate(cols):
        for yc in cols[i:]:
            items.append(F.struct(F.lit(xc).alias("x_var"), F.lit(yc).alias("y_var"),
                                  b[xc].alias("bin_x"), b[yc].alias("bin_y")))
    keep = [F.col(hue).alias("hue")] if hue else []
    long = df.select(F.explode(F.array(*items)).alias("p"), *keep).select("p.*", *(["hue"] if hue else []))
    long = long.where("bin_x IS NOT NULL AND bin_y IS NOT NULL")
    keys = ["x_var", "y_var", "bin_x", "bin_y"] + (["hue"] if hue else [])
    return long.groupBy(*keys).agg(F.count("*").alias("count"))


def standardize_stats(df: DataFrame, cols: list[str]) -> dict[str, tuple[float, float]]:
    """{col: (mean, population std with 0 -> 1)} from one aggregate."""
    r = df.agg(*[F.avg(nan_to_null(c)).alias(f"m{i}") for i, c in enumerate(cols)],
               *[F.stddev_pop(nan_to_null(c)).alias(f"s{i}") for i, c in enumerate(cols)]).collect()[0]
    out = {}
    for i, c in enumerate(cols):
        s = r[f"s{i}"]
        out[c] = (r[f"m{i}"], 1.0 if (s is None or s == 0) else s)
    return out


def apply_standardize(df: DataFrame, stats: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: (nan_to_null(c) - F.lit(m)) / F.lit(s) for c, (m, s) in stats.items()})


def standardize(df: DataFrame, cols: list[str]) -> DataFrame:
    """(x - mean) / population std (zero std -> 1), as scikit-learn's StandardScaler."""
    return apply_standardize(df, standardize_stats(df, cols))

"""Evaluation (V1-V9) over a predictions frame (y, prediction, score).

Classification metrics come from the confusion counts (one aggregate,
classes^2 rows).  Curves first reduce to one row per distinct score, then
use distributed running sums; areas are trapezoids computed from the
running sums of each point and its predecessor (no lag across tasks).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.prefix import running_sums


def _safe_div(a, b):
    return F.when(b != 0, a / b).otherwise(F.lit(0.0))


def binary_metrics(df: DataFrame, y: str = "y", pred: str = "prediction", positive=1) -> DataFrame:
    """V1: accuracy, precision, recall, f1 (positive class ``positive``; 0 when undefined)."""
    t, p = F.col(y) == F.lit(positive), F.col(pred) == F.lit(positive)
    agg = df.agg(F.count("*").alias("n"), F.count(F.when(t & p, 1)).alias("tp"),
                 F.count(F.when(~t & p, 1)).alias("fp"), F.count(F.when(t & ~p, 1)).alias("fn"),
                 F.count(F.when(F.col(y) == F.col(pred), 1)).alias("correct"))
    prec = _safe_div(F.col("tp"), F.col("tp") + F.col("fp"))
    rec = _safe_div(F.col("tp"), F.col("tp") + F.col("fn"))
    return agg.select(_safe_div(F.col("correct"), F.col("n")).alias("accuracy"), prec.alias("precision"),
                      rec.alias("recall"), _safe_div(2 * prec * rec, prec + rec).alias("f1"))


def _counts(df: DataFrame, y: str, pred: str) -> DataFrame:
    dt = df.schema[y].dataType
    return df.groupBy(F.col(y).alias("actual"), F.col(pred).cast(dt).alias("predicted")).agg(F.count("*").alias("count"))


def confusion_matrix(df: DataFrame, y: str = "y", pred: str = "prediction") -> DataFrame:
    """V3: actual, predicted, count for every label pair (zeros kept, labels sorted): classes^2 rows, by definition."""
    counts = _counts(df, y, pred).where(F.col("actual").isNotNull() & F.col("predicted").isNotNull())
    labels = df.select(F.array(F.col(y), F.col(pred).cast(df.schema[y].dataType)).alias("l")).agg(
        F.array_compact(F.array_distinct(F.flatten(F.collect_set("l")))).alias("l"))
    grid = labels.select("l", F.explode("l").alias("actual")).select("actual", F.explode("l").alias("predicted"))
    return (grid.join(counts, ["actual", "predicted"], "left")
            .select("actual", "predicted", F.coalesce("count", F.lit(0)).cast("long").alias("count")))


def _per_class(df: DataFrame, y: str, pred: str) -> DataFrame:
    """label, precision, recall, f1, support, tp from the counts; no grid of label pairs."""
    c = _counts(df, y, pred).where(F.col("actual").isNotNull() & F.col("predicted").isNotNull())
    sides = F.explode(F.array(
        F.struct(F.col("actual").alias("label"), F.col("count").alias("support"), F.lit(0).cast("long").alias("npred"),
                 F.when(F.col("actual") == F.col("predicted"), F.col("count")).otherwise(0).alias("tp")),
        F.struct(F.col("predicted").alias("label"), F.lit(0).cast("long").alias("support"), F.col("count").alias("npred"),
                 F.lit(0).cast("long").alias("tp"))))
    t = c.select(sides.alias("s")).select("s.*").groupBy("label").agg(F.sum("support").alias("support"), F.sum("npred").alias("npred"), F.sum("tp").alias("tp"))
    prec = _safe_div(F.col("tp"), F.col("npred"))
    rec = _safe_div(F.col("tp"), F.col("support"))
    return t.select("label", prec.alias("precision"), rec.alias("recall"),
                    _safe_div(2 * prec * rec, prec + rec).alias("f1"), F.col("support").cast("long"),
                    "tp")


def classification_report(df: DataFrame, y: str = "y", pred: str = "prediction") -> DataFrame:
    """V4: label (string), precision, recall, f1, support; plus 'macro avg' and 'weighted avg' rows.

    One pass: a rollup-like aggregate over the rows of the classes gives both averages.
    """
    pc = _per_class(df, y, pred)
    kinds = F.explode(F.array(F.lit("class"), F.lit("macro avg"), F.lit("weighted avg"))).alias("kind")
    label = F.when(F.col("kind") == "class", F.col("label").cast("string")).otherwise(F.col("kind")).alias("label")
    rows = pc.select("label", "precision", "recall", "f1", "support", kinds).select("kind", label, "precision", "recall", "f1", "support")
    share = F.when(F.col("kind") == "weighted avg", F.col("support")).otherwise(F.lit(1)).cast("double")
    return rows.groupBy("kind", "label").agg(
        *[F.try_divide(F.sum(F.col(m) * share), F.sum(share)).alias(m) for m in ("precision", "recall", "f1")],
        F.sum("support").cast("long").alias("support")).drop("kind")


def multiclass_metrics(df: DataFrame, y: str = "y", pred: str = "prediction") -> DataFrame:
    """V2: accuracy, macro f1, weighted f1."""
    pc = _per_class(df, y, pred)
    return pc.agg(F.try_divide(F.sum("tp"), F.sum("support")).alias("accuracy"), F.avg("f1").alias("f1_macro"),
                  F.try_divide(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("f1_weighted"))


def _score_table(df: DataFrame, y: str, score: str, positive, with_next: bool = False) -> DataFrame:
    """One row per distinct score: tp, fp increments, and running totals from the highest score down."""
    pos = (F.col(y) == F.lit(positive)).cast("double")
    per = df.where(F.col(score).isNotNull()).groupBy(F.col(score).cast("double").alias("threshold")).agg(
        F.sum(pos).alias("tp"), F.sum(1.0 - pos).alias("fp"))
    return running_sums(per, "threshold", ["tp", "fp"], descending=True, with_next=with_next)


def _totals(df: DataFrame, y: str, positive):
    r = df.agg(F.sum((F.col(y) == F.lit(positive)).cast("double")).alias("P"),
               F.count("*").alias("n")).collect()[0]
    return float(r["P"] or 0), float(r["n"] - (r["P"] or 0))


def roc_curve(df: DataFrame, y: str = "y", score: str = "score", positive=1,
              drop_intermediate: bool = False) -> DataFrame:
    """V5: threshold, fpr, tpr for every distinct score (highest first), plus the (0, 0) start
    point with threshold +inf.  ``drop_intermediate`` keeps only the first and last points and
    the points where the slope changes (the next score's (fp, tp) increments differ), as
    scikit-learn's default."""
    P, N = _totals(df, y, positive)
    st = _score_table(df, y, score, positive, with_next=drop_intermediate)
    if drop_intermediate:
        first = F.col("cum_tp") + F.col("cum_fp") == F.col("tp") + F.col("fp")
        st = st.where(first | F.col("next_tp").isNull()
                      | (F.col("next_tp") != F.col("tp")) | (F.col("next_fp") != F.col("fp")))
    pts = st.select("threshold", F.try_divide(F.col("cum_fp"), F.lit(N)).alias("fpr"), F.try_divide(F.col("cum_tp"), F.lit(P)).alias("tpr"))
    start = df.sparkSession.createDataFrame([(float("inf"), 0.0, 0.0)], "threshold double, fpr double, tpr double")
    return start.unionByName(pts)


def roc_auc(df: DataFrame, y: str = "y", score: str = "score", positive=1) -> DataFrame:
    """V5: trapezoid area under the ROC curve (= Mann-Whitney with ties counted half)."""
    P, N = _totals(df, y, positive)
    st = _score_table(df, y, score, positive)
    seg = F.try_divide(F.col("fp") * (2 * F.col("cum_tp") - F.col("tp")), F.lit(2 * P * N))   # NULL with one class only
    return st.agg(F.sum(seg).alias("roc_auc"))


def pr_curve(df: DataFrame, y: str = "y", score: str = "score", positive=1) -> DataFrame:
    """V6: threshold, precision, recall per distinct score down to the first point of full
    recall, plus the end point (recall 0, precision 1, threshold NULL)."""
    P, _ = _totals(df, y, positive)
    st = _score_table(df, y, score, positive)
    prev_tp = F.col("cum_tp") - F.col("tp")
    pts = st.where(prev_tp < F.lit(P)).select(
        "threshold", (F.col("cum_tp") / (F.col("cum_tp") + F.col("cum_fp"))).alias("precision"),
        (F.col("cum_tp") / F.lit(P)).alias("recall"))
    end = df.sparkSession.createDataFrame([(None, 1.0, 0.0)], "threshold double, precision double, recall double")
    return pts.unionByName(end)


def pr_auc(df: DataFrame, y: str = "y", score: str = "score", positive=1) -> DataFrame:
    """V6: trapezoid area under the precision-recall curve (not average precision)."""
    P, _ = _totals(df, y, positive)
    st = _score_table(df, y, score, positive)
    prev_tp, prev_fp = F.col("cum_tp") - F.col("tp"), F.col("cum_fp") - F.col("fp")
    prec = F.col("cum_tp") / (F.col("cum_tp") + F.col("cum_fp"))
    prev_prec = F.when(prev_tp + prev_fp == 0, F.lit(1.0)).otherwise(prev_tp / (prev_tp + prev_fp))
    seg = F.col("tp") / F.lit(P) * (prec + prev_prec) / 2
    return st.where(prev_tp < F.lit(P)).agg(F.sum(seg).alias("pr_auc"))


def regression_metrics(df: DataFrame, y: str = "y", pred: str = "prediction") -> DataFrame:
    """V7: mse, rmse, mae, r2 (one aggregate; r2 = 1 - SSE / (n var_pop(y)))."""
    e = F.col(y) - F.col(pred)
    # A constant y: 1 if it is met exactly, else 0.
    constant = F.when(F.col("sse") == 0, F.lit(1.0)).otherwise(F.lit(0.0))
    agg = df.agg(F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.sum(e * e).alias("sse"),
                 F.var_pop(y).alias("vy"), F.count("*").alias("n"))
    return agg.select("mse", F.sqrt("mse").alias("rmse"), "mae",
                      F.when(F.col("vy") == 0, constant).otherwise(1 - F.try_divide(F.col("sse"), F.col("n") * F.col("vy"))).alias("r2"))


def actual_vs_predicted(df: DataFrame, y: str = "y", pred: str = "prediction", keys: list[str] | None = None) -> DataFrame:
    """V8 (points): actual, predicted (a projection; sample it for display when large)."""
    return df.select(*(keys or []), F.col(y).alias("actual"), F.col(pred).alias("predicted"))


def identity_line(df: DataFrame, y: str = "y", pred: str = "prediction") -> DataFrame:
    """V8 (line): the y = x reference segment over [min, max] of actual and predicted."""
    return df.agg(F.least(F.min(y), F.min(pred)).alias("line_min"), F.greatest(F.max(y), F.max(pred)).alias("line_max"))


def residuals(df: DataFrame, y: str = "y", pred: str = "prediction", keys: list[str] | None = None) -> DataFrame:
    """V9: predicted, residual = actual - predicted."""
    return df.select(*(keys or []), F.col(pred).alias("predicted"), (F.col(y) - F.col(pred)).alias("residual"))

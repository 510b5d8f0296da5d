import numpy as np
import pandas as pd
import pytest

from tessera.operators import clean as CL
from tessera.operators import dedup as D
from tessera.operators import evaluate as V
from tessera.operators.columns import lowercase_columns, rename_column


def col(df, c, order="k"):
    return [r[c] for r in df.orderBy(order).collect()]


def test_qcut_merged_edges(spark):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate([1, 1, 1, 1, 2, 3])], "k int, x double")
    assert col(CL.bucketize_quantile(df, "x", 4), "x") == [0, 0, 0, 0, 1, 1]


def test_qcut_constant_is_null(spark):
    df = spark.createDataFrame([(i, 5.0) for i in range(4)], "k int, x double")
    assert col(CL.bucketize_quantile(df, "x", 4), "x") == [None] * 4


def test_cut_constant_and_right_closed(spark):
    df = spark.createDataFrame([(i, 5.0) for i in range(3)], "k int, x double")
    assert col(CL.bucketize_width(df, "x", 4), "x") == [1, 1, 1]
    df2 = spark.createDataFrame([(0, 0.0), (1, 5.0), (2, 10.0)], "k int, x double")
    assert col(CL.bucketize_width(df2, "x", 2), "x") == [0, 0, 1]    # 5 falls in the first (right-closed) bin


def test_to_binary_tf_null(spark):
    df = spark.createDataFrame([(0, " Yes"), (1, "n"), (2, "t"), (3, None)], "k int, s string")
    assert col(CL.to_binary(df, "s"), "s") == [1, 0, None, None]
    assert col(CL.to_binary(df, "s", include_tf=True), "s") == [1, 0, 1, None]


def test_label_encode_first_appearance(spark):
    df = spark.createDataFrame([(0, "z"), (1, "a"), (2, "z"), (3, None)], "k int, s string")
    assert col(CL.label_encode(df, "s", ["k"]), "s") == [0, 1, 0, None]


def test_cap_and_impute(spark):
    df = spark.createDataFrame([(i, float(v) if v is not None else None) for i, v in enumerate([1, 2, 3, 4, 100, None])],
                               "k int, x double")
    capped = col(CL.cap_iqr(df, "x"), "x")
    assert capped[4] == pytest.approx(4 + 1.5 * 2) and capped[5] is None
    assert col(CL.impute_median(df, "x"), "x")[5] == 3.0
    assert col(CL.impute_mode(spark.createDataFrame([(0, "b"), (1, "a"), (2, None)], "k int, s string"), "s"), "s")[2] == "a"


def test_dedup_keep_first_and_none(spark):
    df = spark.createDataFrame([(1, "u", "x"), (2, "u", "y"), (3, "v", "z")], "k int, g string, p string")
    assert sorted(col(D.drop_duplicates(df, ["g"], "first", ["k"]), "k")) == [1, 3]
    assert col(D.drop_duplicates(df, ["g"], keep=False), "k") == [3]


def test_rename_and_lowercase_collisions(spark):
    df = spark.createDataFrame([(1, 2)], "Ab int, aB int")
    with pytest.raises(ValueError):
        lowercase_columns(df, ["Ab", "aB"])
    with pytest.raises(ValueError):
        rename_column(spark.createDataFrame([(1, 2)], "a int, b int"), "a", "b")


def test_confusion_and_report(spark):
    rows = [("a", "a"), ("a", "b"), ("b", "b"), ("c", "b")]
    df = spark.createDataFrame(rows, "y string, prediction string")
    cm = V.confusion_matrix(df).collect()
    assert len(cm) == 9 and sum(r["count"] for r in cm) == 4
    rep = {r["label"]: r for r in V.classification_report(df).collect()}
    assert rep["b"]["precision"] == pytest.approx(1 / 3) and rep["c"]["f1"] == 0.0
    assert rep["weighted avg"]["support"] == 4


def test_auc_matches_mann_whitney(spark):
    rng = np.random.RandomState(1)
    y = rng.randint(0, 2, 300)
    s = np.round(rng.rand(300) + 0.3 * y, 1)       # many ties
    df = spark.createDataFrame(pd.DataFrame({"y": y, "score": s}))
    auc = V.roc_auc(df).collect()[0]["roc_auc"]
    pos, neg = s[y == 1], s[y == 0]
    mw = ((pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()) / (len(pos) * len(neg))
    assert auc == pytest.approx(mw) and 0 <= auc <= 1
    pr = V.pr_auc(df).collect()[0]["pr_auc"]
    assert 0 <= pr <= 1


def test_roc_drop_intermediate_across_ranges(spark, monkeypatch):
    conf = spark.conf.get("spark.sql.shuffle.partitions")
    monkeypatch.setattr(spark.conf, "get", lambda key, *a, f=spark.conf.get: "17" if key == "spark.sql.shuffle.partitions" else f(key, *a))
    assert conf
    # scores 0.00..0.99; positives in runs so many consecutive points are collinear
    s = np.repeat(np.arange(100) / 100.0, 2)
    y = np.array([(int(v * 100) // 10) % 2 for v in s])
    df = spark.createDataFrame(pd.DataFrame({"y": y, "score": s}))
    got = V.roc_curve(df, drop_intermediate=True).toPandas()
    # numpy reference of the same rule
    order = np.argsort(-s, kind="stable")
    ss, yy = s[order], y[order]
    thr = np.unique(ss)[::-1]
    tps = np.array([yy[ss >= t].sum() for t in thr], dtype=float)
    fps = np.array([(1 - yy[ss >= t]).sum() for t in thr], dtype=float)
    keep = np.where(np.r_[True, np.logical_or(np.diff(fps, 2), np.diff(tps, 2)), True])[0]
    exp = sorted(zip(thr[keep], fps[keep] / (1 - y).sum(), tps[keep] / y.sum()))
    got_pts = sorted((r.threshold, r.fpr, r.tpr) for r in got.itertuples() if np.isfinite(r.threshold))
    assert len(got_pts) == len(exp) < len(thr)
    assert np.allclose(np.array(got_pts), np.array(exp))

"""Cases that once gave wrong answers: CSV text, missing values, dates, one-class curves, KNN donors, support-vector regression."""

import math

import numpy as np
import pandas as pd

from pyspark.sql import functions as F
from tessera.operators import clean
from tessera.operators import evaluate as V
from tessera.operators.models import bayes, knn, svm
from tessera.session import scratch_path
from tessera.sources.io import read_csv, write_csv


def test_csv_text_round_trip(spark):
    rows = [(1, 'say "hi" now', "a\nb", " Y ", "10D", "TRUE", "1e3"), (2, "x,y", '"', "z", "3f", "false", ".5"), (3, "back\\slash", "c", "é", "7", "True", "-2.")]
    df = spark.createDataFrame(rows, "id int, q string, n string, p string, code string, flag string, num string")
    path = scratch_path(spark, "csv")
    write_csv(df, path)
    back = read_csv(spark, path)
    assert dict(back.dtypes) == {"id": "bigint", "q": "string", "n": "string", "p": "string", "code": "string", "flag": "boolean", "num": "double"}
    got = sorted(back.collect())
    assert [tuple(r[:5]) for r in got] == [r[:5] for r in rows]
    assert [r["flag"] for r in got] == [True, False, True] and [r["num"] for r in got] == [1000.0, 0.5, -2.0]


def test_documents_survive_csv(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    path = scratch_path(spark, "csv")
    write_csv(docs, path)
    back = read_csv(spark, path)
    assert sorted(back.select("doc_id", "text").collect()) == sorted(docs.select("doc_id", "text").collect())


def test_clipping_keeps_missing_values(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (4.0,), (float("nan"),), (None,), (99.0,)], "x double")
    got = [r[0] for r in clean.cap_iqr(df, "x").collect()]
    assert math.isnan(got[4]) and got[5] is None and got[6] < 99


def test_one_date_pattern_for_a_column(spark):
    day = lambda values, c="d": [None if r[0] is None else str(r[0])[:10] for r in clean.parse_datetime(
        spark.createDataFrame([(v,) for v in values], "d string"), c).collect()]
    assert day(["01-13-2020", "01-02-2020"]) == ["2020-01-13", "2020-01-02"]
    assert day(["12/25/2020", "01/02/2020"]) == ["2020-12-25", "2020-01-02"]
    assert day(["25/12/2020", "01/02/2020", "bad"]) == ["2020-12-25", "2020-02-01", None]
    assert day(["3 Mar 2021"]) == ["2021-03-03"] and day(["x", None]) == [None, None]


def test_one_class_and_constant_targets(spark):
    df = spark.createDataFrame([(1, 0.5), (1, 0.7)], "y int, score double")
    assert V.roc_auc(df).first()[0] is None and all(r["fpr"] in (None, 0.0) for r in V.roc_curve(df).collect())
    same = spark.createDataFrame([(2.0, 2.0), (2.0, 3.0)], "y double, prediction double")
    assert V.regression_metrics(same).first()["r2"] == 0.0
    assert V.regression_metrics(same.where("prediction = 2")).first()["r2"] == 1.0


def test_constant_features_and_clashing_names(spark):
    df = spark.createDataFrame([(1.0, 0), (1.0, 1), (1.0, 1)], "x double, y int")
    assert [r["prediction"] for r in bayes._predict(bayes.gaussian_nb(df, "y", ["x"]), df).collect()] == [1, 1, 1]
    named = spark.createDataFrame([(1, "b", 7), (2, "a", 8), (3, "b", 9), (4, None, 1)], "id int, value string, code int")
    assert [tuple(r) for r in clean.label_encode(named, "value", ["id"]).orderBy("id").collect()] == [(1, 0, 7), (2, 1, 8), (3, 0, 9), (4, None, 1)]


def test_knn_blocks_equal_plain_search(spark, monkeypatch):
    rng = np.random.RandomState(0)
    x = rng.randint(0, 6, size=(300, 2)).astype(float)     # many ties
    pdf = pd.DataFrame({"id": [f"r{i:03d}" for i in range(300)], "a": x[:, 0], "b": x[:, 1], "v": rng.rand(300)})
    df = spark.createDataFrame(pdf)
    query, ref = df.where("id < 'r050'"), df.where("id >= 'r050'")
    q, r = pdf[pdf.id < "r050"], pdf[pdf.id >= "r050"]
    want = {}
    for i, a, b in zip(q.id, q.a, q.b):
        d = np.sqrt((r.a - a) ** 2 + (r.b - b) ** 2)
        want[i] = [j for _, j in sorted(zip(d, r.id))][:7]
    for blocks, chunks in ((8192, 8192), (40, 13)):
        monkeypatch.setattr(knn, "BLOCK_ROWS", blocks)
        monkeypatch.setattr(knn, "CHUNK_ROWS", chunks)
        got = {}
        for n in knn.nearest(query, "id", ref, "id", "v", ["a", "b"], 7).orderBy("qid", "rank").collect():
            got.setdefault(n["qid"], []).append(n["rid"])
        assert got == want


def test_imputation_ignores_donors_without_a_shared_feature(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, 1.0, None, 10.0), (2, 2.0, None, 20.0), (3, None, 5.0, 1000.0), (4, 1.5, None, None), (5, inf, 5.0, nan), (6, None, None, None)]
    df = spark.createDataFrame(rows, "id int, a double, b double, v double")
    got = {r["id"]: r["v"] for r in knn.impute_knn(df, "id", "v", ["a", "b"], k=3).collect()}
    assert got[4] == 15.0 and got[5] == 1000.0 and got[6] is None and got[1] == 10.0


def test_support_vector_regression_meets_the_objective(spark):
    rng = np.random.RandomState(1)
    x = rng.randn(400, 2)
    y = 50_000 + 9000 * x[:, 0] - 4000 * x[:, 1] + 500 * rng.randn(400)
    df = spark.createDataFrame(pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "y": y}))
    fm = svm.svm_regress(df, "y", ["a", "b"], C=1.0, kernel="linear", epsilon=0.1)
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    objective = lambda w, b, C=1.0: 0.5 * w @ w + C * np.maximum(0, np.abs(y - z @ w - b) - 0.1).sum()
    mine = objective(np.array(fm.extra["w"]), fm.extra["b"])
    w, b, best = np.zeros(2), y.mean(), np.inf
    for it in range(1, 60_000):     # plain sub-gradient steps, long enough
        r = z @ w + b - y
        g = np.sign(r) * (np.abs(r) > 0.1)
        w, b = w - 40 / math.sqrt(it) * (w / 400 + z.T @ g / 400) * 10, b - 40 / math.sqrt(it) * g.mean() * 10
        best = min(best, objective(w, b)) if it % 50 == 0 else best
    assert mine <= best * 1.01
    for kernel in ("rbf", "poly", "sigmoid"):
        out = svm._svr_predict(svm.svm_regress(df.limit(80), "y", ["a", "b"], kernel=kernel, max_evaluations=20), df).agg(F.count("prediction")).first()[0]
        assert out == 400

import numpy as np
import pandas as pd
import pytest

from tessera.operators import select as M
from tessera.operators.models import bayes, knn


def test_knn_matches_brute_force(spark):
    rng = np.random.RandomState(3)
    n = 120
    pdf = pd.DataFrame({"id": np.arange(n), "a": rng.rand(n), "b": rng.rand(n), "y": rng.randint(0, 3, n)})
    df = spark.createDataFrame(pdf)
    train, test = pdf[pdf.id % 4 != 0], pdf[pdf.id % 4 == 0]
    fm = knn.knn_fit(df.where("id % 4 != 0"), "y", ["a", "b"], "classification_multi", "id", n_neighbors=5)
    got = {r["id"]: r["prediction"] for r in fm.transform(df.where("id % 4 = 0")).collect()}
    mu, sd = train[["a", "b"]].mean(), train[["a", "b"]].std(ddof=0)
    Z, Q = ((train[["a", "b"]] - mu) / sd).to_numpy(), ((test[["a", "b"]] - mu) / sd).to_numpy()
    for qi, q in zip(test.id, Q):
        d = np.sqrt(((Z - q) ** 2).sum(axis=1))
        idx = np.lexsort((train.id.to_numpy(), d))[:5]
        votes = pd.Series(train.y.to_numpy()[idx]).value_counts()
        expect = min(votes[votes == votes.max()].index)
        assert got[qi] == expect


def test_knn_blocks_equal_single_block(spark, monkeypatch):
    rng = np.random.RandomState(4)
    pdf = pd.DataFrame({"id": np.arange(200), "a": rng.rand(200), "y": rng.rand(200)})
    df = spark.createDataFrame(pdf)
    one = knn.nearest(df, "id", df, "id", "y", ["a"], 3).select("qid", "rid").collect()
    monkeypatch.setattr(knn, "BLOCK_ROWS", 50)
    many = knn.nearest(df, "id", df, "id", "y", ["a"], 3).select("qid", "rid").collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, many))


def test_gaussian_nb_matches_manual(spark):
    rng = np.random.RandomState(5)
    pdf = pd.DataFrame({"a": rng.normal(size=200), "b": rng.normal(size=200)})
    pdf["y"] = (pdf.a + 0.5 * rng.normal(size=200) > 0).astype(int)
    df = spark.createDataFrame(pdf)
    fm = bayes.gaussian_nb(df, "y", ["a", "b"], scale=False)
    got = np.array([r["prediction"] for r in fm.transform(df).collect()])
    X = pdf[["a", "b"]].to_numpy()
    eps = 1e-9 * X.var(axis=0).max()
    jll = []
    for c in (0, 1):
        Xc = X[pdf.y == c]
        m, v = Xc.mean(axis=0), Xc.var(axis=0) + eps
        jll.append(np.log(len(Xc) / len(X)) - 0.5 * np.log(2 * np.pi * v).sum() - 0.5 * (((X - m) ** 2) / v).sum(axis=1))
    assert (got == np.argmax(np.vstack(jll), axis=0)).all()


def test_stratified_folds_balanced(spark):
    pdf = pd.DataFrame({"id": np.arange(103), "y": np.arange(103) % 3})
    f = M.assign_folds(spark.createDataFrame(pdf), ["id"], 5, stratify="y").toPandas()
    sizes = f.groupby(["y", "_fold"]).size().unstack()
    assert (sizes.max(axis=1) - sizes.min(axis=1) <= 1).all()


def test_param_grids(spark):
    g = M.build_param_grid("logistic", {"C": [1.0], "penalty": ["l1", "l2"], "solver": ["lbfgs", "liblinear"]})
    assert {"C": 1.0, "penalty": "l1", "solver": "lbfgs"} not in g and len(g) == 3
    with pytest.raises(ValueError):
        M.build_param_grid("knn", {"n_neighbors": []})


def test_score_stream(spark, tmp_path):
    from tessera.streaming.score import score_stream, write_scores
    rng = np.random.RandomState(6)
    pdf = pd.DataFrame({"a": rng.normal(size=100), "b": rng.normal(size=100)})
    pdf["y"] = (pdf.a > 0).astype(int)
    src = str(tmp_path / "src")
    spark.createDataFrame(pdf).write.parquet(src)
    fm = bayes.gaussian_nb(spark.read.parquet(src), "y", ["a", "b"])
    stream = spark.readStream.schema(spark.read.parquet(src).schema).parquet(src)
    q = write_scores(score_stream(fm, stream), str(tmp_path / "out"), name=f"t{rng.randint(1 << 30)}")
    q.awaitTermination(120)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == 100 and "prediction" in out.columns


@pytest.mark.parametrize("metric,weights", [("manhattan", "distance"), ("chebyshev", "uniform"), ("cosine", "uniform")])
def test_knn_regress_metrics_brute_force(spark, metric, weights):
    rng = np.random.RandomState(7)
    n = 90
    pdf = pd.DataFrame({"id": np.arange(n), "a": rng.rand(n), "b": rng.rand(n), "y": rng.rand(n)})
    df = spark.createDataFrame(pdf)
    train, test = pdf[pdf.id % 3 != 0], pdf[pdf.id % 3 == 0]
    fm = knn.knn_fit(df.where("id % 3 != 0"), "y", ["a", "b"], "regression", "id", n_neighbors=4,
                     weights=weights, metric=metric)
    got = {r["id"]: r["prediction"] for r in fm.transform(df.where("id % 3 = 0")).collect()}
    mu, sd = train[["a", "b"]].mean(), train[["a", "b"]].std(ddof=0)
    Z, Q = ((train[["a", "b"]] - mu) / sd).to_numpy(), ((test[["a", "b"]] - mu) / sd).to_numpy()
    for qi, q in zip(test.id, Q):
        if metric == "manhattan":
            d = np.abs(Z - q).sum(axis=1)
        elif metric == "chebyshev":
            d = np.abs(Z - q).max(axis=1)
        else:
            d = 1 - (Z @ q) / (np.linalg.norm(Z, axis=1) * np.linalg.norm(q))
        idx = np.lexsort((train.id.to_numpy(), d))[:4]
        w = 1 / d[idx] if weights == "distance" else np.ones(4)
        assert got[qi] == pytest.approx((w * train.y.to_numpy()[idx]).sum() / w.sum())


def test_feature_importance_small_grid(spark):
    from tessera.operators import search as S
    rng = np.random.RandomState(8)
    pdf = pd.DataFrame({"id": np.arange(300), "a": rng.rand(300), "b": rng.rand(300)})
    pdf["y"] = 3 * pdf.a + 0.1 * rng.rand(300)
    imp = S.feature_importance(spark.createDataFrame(pdf), "y", ["a", "b"], "regression", ["id"],
                               grid={"n_estimators": [5, 10], "max_depth": [3], "min_samples_split": [2]}, k=3,
                               parallelism=2).collect()
    assert [r["feature"] for r in imp][0] == "a" and abs(sum(r["importance"] for r in imp) - 1) < 1e-6

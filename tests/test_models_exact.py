"""Models against closed forms, optimality conditions and numpy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tessera.operators import explore as X
from tessera.operators import pca as PC
from tessera.operators import select as M
from tessera.operators.models import estimators, svm


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.RandomState(11)
    pdf = pd.DataFrame(rng.normal(size=(240, 3)), columns=["a", "b", "c"])
    pdf.insert(0, "id", np.arange(240))
    pdf["b"] += 0.6 * pdf.a
    pdf["y"] = 2 * pdf.a - 0.7 * pdf.b + 0.4 * rng.normal(size=240)
    pdf["k"] = np.digitize(pdf.y, [-1, 1])
    pdf["t"] = (pdf.y + rng.normal(size=240) > 0).astype(int)
    return pdf, spark.createDataFrame(pdf).coalesce(1).cache()


def _standardised(pdf):
    x = pdf[["a", "b", "c"]].to_numpy()
    return (x - x.mean(0)) / x.std(0)


def test_lasso_meets_its_optimality_conditions(data):
    pdf, df = data
    m = estimators.lasso(df, "y", ["a", "b", "c"], alpha=0.3).model
    z, w = _standardised(pdf), m.coefficients.toArray()
    pull = z.T @ (pdf.y.to_numpy() - z @ w - m.intercept) / len(z)
    assert (np.abs(pull[w == 0]) <= 0.3 + 1e-6).all()
    assert np.allclose(pull[w != 0], 0.3 * np.sign(w[w != 0]), atol=1e-6) and (w == 0).any() and (w != 0).any()


def test_ridge_and_ols_equal_the_closed_form(data):
    pdf, df = data
    z, y = _standardised(pdf), pdf.y.to_numpy()
    for alpha, fm in ((0.0, estimators.linear_regression(df, "y", ["a", "b", "c"])),
                      (5.0, estimators.ridge(df, "y", ["a", "b", "c"], alpha=5.0))):
        expect = np.linalg.solve(z.T @ z + alpha * np.eye(3), z.T @ (y - y.mean()))
        assert np.allclose(fm.model.coefficients.toArray(), expect)
        assert estimators.coefficient_table(fm).first()["coefficient"] == pytest.approx(y.mean())


def test_logistic_gradient_is_zero(data):
    pdf, df = data
    m = estimators.logistic_regression(df, "t", ["a", "b", "c"], C=0.5, tol=1e-10).model
    z, w = _standardised(pdf), m.coefficients.toArray()
    p = 1 / (1 + np.exp(-(z @ w + m.intercept)))
    assert np.allclose(w / 0.5 + z.T @ (p - pdf.t.to_numpy()), 0, atol=1e-3)


def test_polynomial_features_are_the_kernel(data):
    pdf, df = data
    spec = {"kernel": "poly", "degree": 3, "gamma": 0.4, "coef0": 0.7}
    rows = svm._mapped(df.where("id < 5"), ["a", "b", "c"], spec).orderBy("id").select(vector_to_array("features")).collect()
    phi, x = np.array([r[0] for r in rows]), pdf[["a", "b", "c"]].to_numpy()[:5]
    assert np.allclose(phi @ phi.T, (0.4 * x @ x.T + 0.7) ** 3)
    no_constant = svm._mapped(df.where("id < 2"), ["a", "b"], {**spec, "coef0": 0.0}).select(vector_to_array("features")).first()[0]
    assert len(no_constant) == 4


@pytest.mark.parametrize("kernel", ["poly", "sigmoid"])
def test_multi_class_svm_has_probabilities(data, kernel):
    _, df = data
    fm = svm.svm_classify(df, "k", ["a", "b", "c"], "classification_multi", kernel=kernel, coef0=1.0, degree=2, max_iter=10, landmarks=6)
    rows = fm.transform(df).collect()
    assert all(len(r["probability"]) == 3 and sum(r["probability"]) == pytest.approx(1) for r in rows)
    if kernel != "sigmoid":
        assert np.mean([int(np.argmax(r["probability"])) == r["k"] for r in rows]) > 0.7


def test_multi_class_boosting_has_probabilities(data):
    _, df = data
    fm = estimators.boosted_trees(df, "k", ["a", "b", "c"], "classification_multi", n_estimators=3, max_depth=2)
    rows = fm.transform(df).collect()
    assert all(sum(r["probability"]) == pytest.approx(1) and int(np.argmax(r["probability"])) == r["prediction"] for r in rows)


@pytest.mark.parametrize("kernel", ["poly", "sigmoid"])
def test_svr_kernels_fit(data, kernel):
    pdf, df = data
    fm = svm.svm_regress(df, "y", ["a", "b", "c"], C=10.0, kernel=kernel, coef0=0.0 if kernel == "sigmoid" else 1.0, degree=2, landmarks=6, max_evaluations=30)
    got = np.array([r["prediction"] for r in fm.transform(df).orderBy("id").collect()])
    assert 1 - ((got - pdf.y) ** 2).sum() / ((pdf.y - pdf.y.mean()) ** 2).sum() > 0.7


def test_pca_equals_eigen_decomposition(data):
    pdf, df = data
    fit = PC.pca_fit(df, ["a", "b", "c"], k=3)
    values, vectors = np.linalg.eigh(np.cov(_standardised(pdf).T))
    assert np.allclose(fit["eigen"], values[::-1])
    assert np.allclose(np.abs(np.array(fit["pc"])), np.abs(vectors[:, ::-1]))
    scores = PC.pca(df, "id", ["a", "b", "c"], fit=fit).toPandas()[["pc1", "pc2", "pc3"]]
    assert np.allclose(scores.var(ddof=1), values[::-1])


def test_kde_of_continuous_values(data):
    pdf, df = data
    got = X.kde(df.repartition(3), "y", 50).toPandas().sort_values("point")
    h = pdf.y.std() * len(pdf) ** -0.2
    z = (got.x.to_numpy()[:, None] - pdf.y.to_numpy()) / h
    assert np.allclose(got.density, np.exp(-0.5 * z * z).sum(1) / (len(pdf) * h * np.sqrt(2 * np.pi)))


def test_folds_are_balanced_and_do_not_depend_on_ranges(spark):
    df = spark.range(62).withColumn("y", F.when(F.col("id") % 5 > 0, F.col("id") % 3))
    seen = []
    for parts in ("1", "7"):
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        plain = {r["id"]: r["_fold"] for r in M.assign_folds(df, ["id"], 10).collect()}
        by_class = M.assign_folds(df, ["id"], 4, stratify="y").toPandas()
        spark.conf.set("spark.sql.shuffle.partitions", before)
        sizes = pd.Series(plain).value_counts()
        assert len(plain) == 62 and sizes.max() - sizes.min() <= 1
        per = by_class.groupby(["y", "_fold"], dropna=False).size().unstack(fill_value=0)
        assert len(by_class) == 62 and len(per) == 4 and (per.max(axis=1) - per.min(axis=1) <= 1).all()
        seen.append((plain, dict(zip(by_class.id, by_class._fold))))
    assert seen[0] == seen[1]
    assert M.assign_folds(df.limit(0), ["id"], 5).count() == 0


def test_grids_per_family():
    for model in M.DEFAULT_GRIDS:
        assert M.build_param_grid(model)
    grid = M.build_param_grid("logistic", {"C": [0.1, 1.0], "solver": ["saga", "liblinear"], "penalty": ["l1", "elasticnet", None, "none"]})
    assert sum(c["penalty"] == "elasticnet" for c in grid) == 6 and sum(c["penalty"] is None for c in grid) == 1
    assert sum(c["solver"] == "liblinear" for c in grid) == 2 and len(grid) == 11
    kernels = M.build_param_grid("svm", {"C": [1.0], "kernel": ["linear", "poly", "rbf"], "degree": [2, 3], "gamma": ["scale", "auto"]})
    assert [c["kernel"] for c in kernels].count("poly") == 4 and {"kernel": "linear", "C": 1.0} in kernels and len(kernels) == 7
    for model, spec in (("logistic", {"solver": ["lbfgs"]}), ("logistic", {"C": [1.0], "penalty": ["l1"], "solver": ["lbfgs"]}),
                        ("svm", {"C": [1.0], "kernel": ["cubic"]}), ("ridge", {}), ("other", {})):
        with pytest.raises(ValueError):
            M.build_param_grid(model, spec)

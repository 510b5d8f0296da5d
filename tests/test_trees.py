"""Forests, nested candidates, boosted trees and fold statistics against plain versions."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.operators import search as S
from tessera.operators.models import boosting, estimators, forest, gram


def frame(spark, n=400, seed=0, classes=0):
    rng = np.random.RandomState(seed)
    pdf = pd.DataFrame({"id": np.arange(n), "a": rng.randint(0, 40, n).astype(float), "b": rng.rand(n).round(2), "c": rng.randint(0, 3, n).astype(float)})
    pdf["y"] = np.sin(pdf.a / 6) * 10 + pdf.b * 4 + pdf.c + rng.randn(n) * 0.3
    if classes:
        pdf["y"] = np.digitize(pdf.y + rng.randn(n) * 2, np.quantile(pdf.y, np.arange(1, classes) / classes))
    return pdf, spark.createDataFrame(pdf)


def plain_tree(x, y, classes, depth, min_split):
    """Exhaustive search, a node at a time; predictions of the rows."""
    out = np.zeros((len(y), classes or 1))

    def impurity(v):
        return sum((v == k).mean() * (1 - (v == k).mean()) for k in range(classes)) if classes else v.var()

    def split(rows, d):
        v = y[rows]
        out[rows] = [(v == k).mean() for k in range(classes)] if classes else v.mean()
        if d == depth or len(rows) < max(2, min_split) or impurity(v) <= 1e-12:
            return
        best = None
        for f in range(x.shape[1]):
            for cut in np.unique(x[rows, f])[:-1]:
                left = x[rows, f] <= cut
                score = -(left.mean() * impurity(v[left]) + (~left).mean() * impurity(v[~left]))
                if best is None or score > best[0] + 1e-10:
                    best = (score, f, cut)
        if best is not None:
            left = x[rows, best[1]] <= best[2]
            split(rows[left], d + 1)
            split(rows[~left], d + 1)

    split(np.arange(len(y)), 0)
    return out


@pytest.mark.parametrize("classes, depth, min_split", [(0, 3, 2), (0, None, 25), (3, 4, 10), (2, None, 2)])
def test_one_tree_without_resampling_is_the_plain_tree(spark, classes, depth, min_split):
    pdf, df = frame(spark, 300, 1, classes)
    problem = "regression" if not classes else "classification_multi"
    fm = estimators.random_forest(df, "y", ["a", "b", "c"], problem, ["id"], n_estimators=1, max_depth=depth, min_samples_split=min_split, bootstrap=False,
                                  max_features=None)
    want = plain_tree(pdf[["a", "b", "c"]].to_numpy(), pdf.y.to_numpy(), classes, depth, min_split)
    got = fm.transform(df).orderBy("id").toPandas()
    if classes:
        assert np.allclose(np.stack(got.probability.to_numpy()), want)
    else:
        assert np.allclose(got.prediction, want[:, 0])


def same_trees(a, b):
    assert len(a) == len(b)
    for s, t in zip(a, b):
        x = np.random.RandomState(0).randint(0, 45, (500, 3)).astype(np.uint8)
        assert np.allclose(s["value"][forest.descend(s, x)], t["value"][forest.descend(t, x)])
        assert sorted(zip(s["depth"], s["n"], np.round(s["gain"], 6))) == sorted(zip(t["depth"], t["n"], np.round(t["gain"], 6)))


@pytest.mark.parametrize("classes", [0, 3])
def test_levels_of_large_nodes_give_the_same_trees(spark, classes, monkeypatch):
    _, df = frame(spark, 600, 2, classes)
    problem = "regression" if not classes else "classification_multi"
    rows, bins, labels, shift = estimators.forest_rows(df, "y", ["a", "b", "c"], problem, {}, ["id"])
    spec = estimators.forest_spec(problem, {"n_estimators": 4, "max_depth": 7}, 3, classes, shift)
    one = forest.fit_trees(rows, spec, bins)
    monkeypatch.setattr(forest, "CELLS_AT_ONCE", 3 * 256 * 4 * 3)  # several waves a level
    same_trees(one, forest.fit_trees(rows.repartition(5), spec, bins, local_rows=60))
    bounded = forest.grow_tops(rows, spec, bins, [0], {0: 600}, 60)
    assert all(len(t.nodes) > 3 for t in bounded.values())


@pytest.mark.parametrize("classes, local", [(0, None), (3, None), (0, 70)])
def test_nested_candidates_equal_separate_fits(spark, classes, local):
    pdf, df = frame(spark, 260, 3, classes)
    problem = "regression" if not classes else "classification_multi"
    features, counts, depths, splits = ["a", "b", "c"], [2, 5, 9], [3, 6, None], [2, 5, 12]
    folded = df.withColumn("_fold", (F.col("id") % 3).cast("int"))
    rows, bins, labels, shift = estimators.forest_rows(folded, "y", features, problem, {}, ["id"], F.col("_fold"))
    spec = estimators.forest_spec(problem, {}, 3, len(labels or []), shift)
    got = {(r["forest"], r["n_estimators"], r["max_depth"], r["min_samples_split"]): r
           for r in forest.nested_scores(rows, spec, bins, [0, 1, 2], counts, depths, splits, local).collect()}
    assert len(got) == 3 * 27
    for f in range(3):
        for trees, depth, small in [(2, 3, 2), (5, None, 12), (9, 6, 5), (9, None, 2)]:
            fm = estimators.random_forest(df.where(F.col("id") % 3 != f), "y", features, problem, ["id"], n_estimators=trees, max_depth=depth, min_samples_split=small)
            p = fm.transform(df.where(F.col("id") % 3 == f)).toPandas()
            r = got[f, trees, depth, small]
            assert r["n"] == len(p)
            if classes:
                assert r["correct"] == (p.prediction == p.y).sum()
            else:
                assert math.isclose(r["sq_error"], ((p.prediction - p.y) ** 2).sum(), rel_tol=1e-9)
                assert math.isclose(r["abs_error"], (p.prediction - p.y).abs().sum(), rel_tol=1e-9)


def test_feature_importance_equals_a_search_with_separate_fits(spark, monkeypatch):
    _, df = frame(spark, 240, 4)
    grid = {"n_estimators": [3, 8], "max_depth": [6], "min_samples_split": [2, 10]}
    got = S.feature_importance(df, "y", ["a", "b", "c"], "regression", ["id"], grid, k=3).collect()
    assert abs(sum(r["importance"] for r in got) - 1) < 1e-9 and got[0]["feature"] == "a"
    nested, best = S.halving_search(df, "y", ["a", "b", "c"], "regression", "random_forest", estimators_grid(grid), ["id"], k=3)

    def separate(folded, target, features, problem, cands, key, k):
        out = []
        for p, f in itertools.product(cands, range(k)):
            fm = estimators.random_forest(folded.where(F.col("_fold") != f), target, features, problem, key, **p)
            out += [(S.json.dumps(p, sort_keys=True), f, m, s) for m, s in S.score_predictions(fm.transform(folded.where(F.col("_fold") == f)), target, problem).items()]
        return out

    monkeypatch.setattr(S, "forest_scores", separate)
    plain, plain_best = S.halving_search(df, "y", ["a", "b", "c"], "regression", "random_forest", estimators_grid(grid), ["id"], k=3)
    assert best == plain_best
    one, two = ({(r["round"], r["params"], r["fold"], r["metric"]): r["score"] for r in x.collect()} for x in (nested, plain))
    assert one.keys() == two.keys() and all(math.isclose(one[k], two[k], rel_tol=1e-8) for k in one)


def estimators_grid(grid):
    from tessera.operators.select import build_param_grid
    return build_param_grid("random_forest", grid)


def test_forest_edges(spark):
    df = spark.createDataFrame([(i, float(i % 2), None if i == 3 else 1.0, "u" if i % 2 else "v") for i in range(12)], "id int, a double, b double, y string")
    fm = estimators.random_forest(df, "y", ["a", "b"], "classification_binary", ["id"], n_estimators=9)
    out = fm.transform(df).collect()
    assert all(r["prediction"] == r["y"] for r in out if r["b"] is not None)  # rows with a missing value are not learned from
    assert {r["prediction"] for r in fm.transform(df.withColumn("a", F.lit(None).cast("double"))).collect()} <= {"u", "v"}
    one = estimators.random_forest(df.where("y = 'u'"), "y", ["a"], "classification_binary", ["id"], n_estimators=3)
    assert {r["prediction"] for r in one.transform(df).collect()} == {"u"}
    with pytest.raises(ValueError, match="no rows"):
        estimators.random_forest(df.where("false"), "y", ["a"], "classification_binary", ["id"])
    w = forest.row_weights(forest.Spec(), forest.tree_seed(forest.Spec(), 3), np.arange(200_000, dtype=np.int64))
    assert abs(w.mean() - 1) < 0.02 and abs((w == 0).mean() - math.exp(-1)) < 0.01


def test_bins_keep_every_value_or_quantiles(spark):
    df = spark.createDataFrame([(float(i % 7), float(i)) for i in range(5000)], "a double, b double")
    a, b = forest.fit_bins(df, ["a", "b"])
    assert a.edges.tolist() == [0.5, 1.5, 2.5, 3.5, 4.5, 5.5] and 200 <= len(b.edges) <= 255
    x = forest.to_bins([a, b], [np.array([0.0, 6.0, np.nan]), np.array([-1.0, 1e9, 10.0])])
    cut, at = a.between(np.array([1, 1]), np.array([2, 6]))
    assert cut.tolist() == [1, 3] and at.tolist() == [1.5, 3.5]
    assert x[:, 0].tolist() == [0, 6, 6] and x[0, 1] == 0 and x[1, 1] == len(b.edges)


def plain_boosting(x, y, rounds, depth, eta, classes):
    """Second-order boosting by exhaustive search; margins of the rows."""
    outputs = classes if classes > 2 else 1
    base = y.mean() if not classes else math.log(y.mean() / (1 - y.mean())) if classes == 2 else 0.0
    margin = np.full((len(y), outputs), base)
    for _ in range(rounds):
        g, h = boosting.gradients(boosting.Spec(classes=classes), margin, y)
        for k in range(outputs):
            def grow(rows, d):
                G, H = g[rows, k].sum(), h[rows, k].sum()
                best = None
                for f in range(x.shape[1] if d < depth else 0):
                    for cut in np.unique(x[rows, f])[:-1]:
                        left = rows[x[rows, f] <= cut]
                        gl, hl = g[left, k].sum(), h[left, k].sum()
                        gain = gl ** 2 / (hl + 1) + (G - gl) ** 2 / (H - hl + 1) - G ** 2 / (H + 1)
                        if hl >= 1 and H - hl >= 1 and gain > 1e-6 and (best is None or gain > best[0] + 1e-9):
                            best = (gain, f, cut)
                if best is None:
                    step[rows] = -G / (H + 1) * eta
                    return
                inside = x[rows, best[1]] <= best[2]
                grow(rows[inside], d + 1)
                grow(rows[~inside], d + 1)

            step = np.zeros(len(y))
            grow(np.arange(len(y)), 0)
            margin[:, k] += step
    return margin


@pytest.mark.parametrize("classes", [0, 2, 3])
def test_boosting_equals_the_plain_version(spark, classes, monkeypatch):
    monkeypatch.setattr(boosting, "WRITE_ROUNDS", 3)
    monkeypatch.setattr(boosting, "CELLS_AT_ONCE", 3 * 256 * 3)  # several waves a level
    pdf, df = frame(spark, 200, 5, classes)
    problem = {0: "regression", 2: "classification_binary", 3: "classification_multi"}[classes]
    fm = estimators.boosted_trees(df.repartition(3), "y", ["a", "b", "c"], problem, ["id"], n_estimators=7, max_depth=3, learning_rate=0.2)
    want = plain_boosting(pdf[["a", "b", "c"]].to_numpy(), pdf.y.to_numpy().astype(float), 7, 3, 0.2, classes)
    got = fm.transform(df).orderBy("id").toPandas()
    if not classes:
        assert np.allclose(got.prediction, want[:, 0])
    else:
        p = np.stack(got.probability.to_numpy())
        e = boosting.softmax(want) if classes > 2 else np.stack([1 / (1 + np.exp(want[:, 0])), 1 / (1 + np.exp(-want[:, 0]))], axis=1)
        assert np.allclose(p, e) and (got.prediction == p.argmax(axis=1)).all()


def test_column_and_row_sampling(spark):
    spec = boosting.Spec(colsample=0.5, subsample=0.7)
    sets = {tuple(boosting.tree_columns(spec, 6, r, 0)) for r in range(30)}
    assert all(len(s) == 3 for s in sets) and len(sets) > 5 and {f for s in sets for f in s} == set(range(6))
    pdf, df = frame(spark, 300, 6, 2)
    a, b = (estimators.boosted_trees(df.repartition(n), "y", ["a", "b", "c"], "classification_binary", ["id"], n_estimators=5, max_depth=2, subsample=0.6,
                                     colsample_bytree=0.67).transform(df).orderBy("id").toPandas().score for n in (1, 4))
    assert np.allclose(a, b) and a.std() > 0


@pytest.mark.parametrize("kind", ["linear", "ridge", "lasso"])
def test_fold_statistics_equal_fits_of_each_fold(spark, kind):
    pdf, df = frame(spark, 300, 7)
    pdf["y"] += 1e6  # a large mean costs no digits
    pdf["flat"] = 2.0
    features = ["a", "b", "c", "flat"]
    folded = spark.createDataFrame(pdf).withColumn("_fold", (F.col("id") % 4).cast("int"))
    cands = [(str(a), kind, a) for a in (0.05, 1.0, 30.0)]
    got = {(p, f, m): s for p, f, m, s in gram.grid_scores(folded, "y", features, cands, 4)}
    assert len(got) == 36
    for name, _, alpha in cands:
        for f in range(4):
            tr, te = pdf[pdf.id % 4 != f], pdf[pdf.id % 4 == f]
            mu, sd = tr[features].mean(), tr[features].std(ddof=0).replace(0, 1)
            z, v = ((tr[features] - mu) / sd).to_numpy(), (tr.y - tr.y.mean()).to_numpy()
            if kind == "lasso":
                b = np.zeros(4)
                for _ in range(3000):  # proximal gradient steps
                    b = b - z.T @ (z @ b - v) / len(v) / 2
                    b = np.sign(b) * np.maximum(np.abs(b) - alpha / 2, 0)
            else:
                b = np.linalg.pinv(z.T @ z + (alpha if kind == "ridge" else 0.0) * np.eye(4)) @ z.T @ v
            miss = ((te[features] - mu) / sd).to_numpy() @ b + tr.y.mean() - te.y
            assert math.isclose(got[name, f, "rmse"], math.sqrt((miss ** 2).mean()), rel_tol=1e-8)
            assert math.isclose(got[name, f, "mae"], miss.abs().mean(), rel_tol=1e-8)
            assert math.isclose(got[name, f, "r2"], 1 - (miss ** 2).sum() / ((te.y - te.y.mean()) ** 2).sum(), rel_tol=1e-7, abs_tol=1e-9)


def test_a_grid_of_linear_models_reads_the_rows_twice(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(gram, "_numbers", lambda *a, plain=gram._numbers: calls.append(1) or plain(*a))
    _, df = frame(spark, 100, 8)
    res, best, fm = S.grid_search(df, "y", ["a", "b", "c"], "regression", "lasso", [{"alpha": a} for a in (0.001, 0.01, 0.1, 1.0, 10.0)], ["id"])
    assert len(calls) == 3 and res.count() == 5 * 5 * 3  # moments, scores, and the refit of the winner
    assert best["alpha"] < 1 and fm.transform(df).count() == 100


def test_carried_statistics_equal_fits_from_nothing(spark, monkeypatch):
    from tessera.operators.models import bayes, carried
    pdf, df = frame(spark, 500, 9, 3)
    passes = []
    monkeypatch.setattr(carried.gram, "fold_moments", lambda *a, plain=gram.fold_moments: passes.append(1) or plain(*a))
    grid = [{"var_smoothing": v} for v in (1e-9, 0.05, 0.5, 5.0)]
    res, best = S.halving_search(df, "y", ["a", "b", "c"], "classification_multi", "naive_bayes", grid, ["id"], k=4, min_rows=60)
    assert len(passes) == 1 and best in grid  # rows are summed once for all rounds
    from tessera.functions.exprs import hash_unit
    folded = S.assign_folds(df, ["id"], 4, stratify="y", seed=42).withColumn("_u", hash_unit(["id"], 43)).cache()
    got = {(r["round"], r["params"], r["fold"]): r["score"] for r in res.collect()}
    assert {k[0] for k in got} == {0, 1}
    for (rnd, params, fold), score in got.items():
        rows = folded.where(F.col("_u") < min(1.0, 60 * 3 ** rnd / 500))
        fm = bayes.gaussian_nb(rows.where(F.col("_fold") != fold), "y", ["a", "b", "c"], "classification_multi", **S.json.loads(params))
        plain = S.score_predictions(fm.transform(rows.where(F.col("_fold") == fold)), "y", "classification_multi")["accuracy"]
        assert math.isclose(score, plain, rel_tol=1e-12)

"""Trees from cells of equal rows: work that follows the cells, with the trees of the rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.operators.models import boosting, estimators, forest


def frame(spark, n, classes=0):
    rng = np.random.RandomState(3)
    pdf = pd.DataFrame({"id": np.arange(n), "a": rng.randint(0, 6, n).astype(float), "b": rng.randint(0, 4, n).astype(float), "c": rng.randint(0, 3, n).astype(float)})
    pdf["y"] = np.sin(pdf.a) * 5 + pdf.b + rng.randn(n)
    if classes:
        pdf["y"] = np.digitize(pdf.y, np.quantile(pdf.y, np.arange(1, classes) / classes))
    return spark.createDataFrame(pdf)


@pytest.mark.parametrize("classes", [2, 3])
def test_boosting_passes_read_a_row_for_equal_bins(spark, classes):
    problem = "classification_binary" if classes == 2 else "classification_multi"
    rows, *_ = estimators.forest_rows(frame(spark, 3000, classes), "y", ["a", "b", "c"], problem, {}, ["id"])
    spec = boosting.Spec(classes=classes)
    n = [len(b) // 8 for r in boosting._blocks(rows, spec, 3).select("n").collect() for b in [r["n"]]]
    assert sum(n) == rows.select("x").distinct().count() <= 72
    counts = np.concatenate([np.frombuffer(r["n"], dtype=np.int64) for r in boosting._blocks(rows, spec, 3).collect()])
    assert counts.sum() == 3000
    each = boosting._blocks(rows, boosting.Spec(classes=classes, subsample=0.5), 3).collect()
    assert sum(len(r["n"]) // 8 for r in each) == 3000  # rows are picked one by one


@pytest.mark.parametrize("classes", [0, 3])
def test_rows_of_a_final_leaf_go_to_no_task(spark, classes):
    problem = "regression" if not classes else "classification_multi"
    rows, bins, labels, shift = estimators.forest_rows(frame(spark, 900, classes), "y", ["a", "b", "c"], problem, {}, ["id"])
    spec = estimators.forest_spec(problem, {"n_estimators": 1, "max_depth": 1, "bootstrap": False}, 3, classes, shift)
    tops = forest.grow_tops(rows, spec, bins, [0], {0: 900}, 40)
    assert forest._dealt(rows, spec, 3, [0], tops, 1, 1).count() == 0
    tree = forest.fit_trees(rows, spec, bins, 40)[0]
    want = forest.fit_trees(rows, spec, bins)[0]
    assert sorted(tree["n"]) == sorted(want["n"]) and np.allclose(tree["value"][0], want["value"][0])


@pytest.mark.parametrize("classes", [0, 3])
def test_cells_give_the_trees_of_the_rows(spark, classes):
    problem = "regression" if not classes else "classification_multi"
    rows, bins, labels, shift = estimators.forest_rows(frame(spark, 1500, classes), "y", ["a", "b", "c"], problem, {}, ["id"])
    spec = estimators.forest_spec(problem, {"n_estimators": 3, "max_depth": 5}, 3, classes, shift)
    assert forest.cells_fit(rows, 3, 200) and not forest.cells_fit(rows, 3, 1500) and not forest.cells_fit(rows, 3, 20)
    x = np.random.RandomState(0).randint(0, 7, (400, 3)).astype(np.uint8)
    for s, t in zip(forest.fit_trees(rows, spec, bins, 200), forest.fit_trees(rows, spec, bins), strict=True):
        assert np.allclose(s["value"][forest.descend(s, x)], t["value"][forest.descend(t, x)])
        assert sorted(zip(s["depth"], s["n"])) == sorted(zip(t["depth"], t["n"]))


def test_repeated_keys_and_null_like_bins(spark):
    df = frame(spark, 400, 2).withColumn("id", F.lit(1)).withColumn("a", F.lit(1.0))
    rows, bins, labels, _ = estimators.forest_rows(df, "y", ["a", "b", "c"], "classification_binary", {}, ["id"])
    spec = estimators.forest_spec("classification_binary", {"n_estimators": 4}, 3, 2, 0.0)
    assert len(forest.fit_trees(rows, spec, bins, 100)) == len(forest.fit_trees(rows, spec, bins))


@pytest.mark.parametrize("classes", [0, 3])
def test_nested_scores_from_cells_are_those_of_the_rows(spark, classes, monkeypatch):
    problem = "regression" if not classes else "classification_multi"
    df = frame(spark, 1500, classes).withColumn("_fold", F.col("id") % 3)
    rows, bins, labels, shift = estimators.forest_rows(df, "y", ["a", "b", "c"], problem, {}, ["id"], F.col("_fold"))
    spec = estimators.forest_spec(problem, {}, 3, classes, shift)
    args = (rows, spec, bins, [0, 1, 2], [2, 5, 12], [None, 2, 4], [2, 30])
    dealt = []
    plain = forest._dealt
    monkeypatch.setattr(forest, "_dealt", lambda *a: dealt.append(1) or plain(*a))
    got = {tuple(r[:4]): r for r in forest.nested_scores(*args).collect()}
    assert not dealt  # no tree's rows are dealt
    monkeypatch.setattr(forest, "CELL_SHARE", 10**6)
    want = {tuple(r[:4]): r for r in forest.nested_scores(*args).collect()}
    assert dealt and set(got) == set(want) and len(got) == 3 * 3 * 3 * 2
    for at, r in want.items():
        assert tuple(got[at][4:6]) == tuple(r[4:6]) and np.allclose(got[at][6:], r[6:])

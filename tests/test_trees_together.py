"""Trees of a chunk grow together, and only as far as the candidates of a search ask."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.operators.models import estimators, forest


@pytest.mark.parametrize("classes, tries", [(3, 1), (3, 2), (0, None)])
def test_trees_grown_together_are_those_grown_alone(classes, tries):
    rng = np.random.RandomState(5)
    x = rng.randint(0, 30, (500, 3)).astype(np.uint8)
    x[:, 1] = 7  # a feature without a cut
    y, h = rng.randint(0, 3, 500).astype(float), rng.randint(-2**62, 2**62, 500)
    spec = forest.Spec(trees=4, depth=12, classes=classes, tries=tries)
    bins = [forest.Bins(np.arange(29) + 0.5, np.arange(30.0), np.arange(30.0))] * 3
    tops = {(0, t): forest.Top.root(forest.tree_seed(spec, t)) for t in range(4)}
    [(trees, grown, above)] = forest._subtrees(spec, bins, 0, 0, 0, 4, tops, (None, h, y, x))
    assert trees == [0, 1, 2, 3] and above == []
    for t, one in zip(trees, forest.apart(grown, 4), strict=True):
        order = np.lexsort((y, h))
        _, cells, n, stats = next(forest.cells_by_tree(spec, x[order], y[order], h[order], [(t, tops[0, t].seed)]))
        alone = forest.grow_cells(spec, bins, cells, n, stats, tops[0, t].seed)
        assert n.sum() == alone["n"][0] == (forest.row_weights(spec, tops[0, t].seed, h) > 0).sum()
        for c in alone:
            assert np.allclose(one[c], alone[c]), c


def test_a_tree_grows_as_far_as_its_candidates_ask():
    spec = forest.Spec(trees=30, depth=20, min_split=2, nested=((10, 20, 5), (30, 5, 2)))
    assert [(s.deepest, s.min_split) for s in (spec.of(0), spec.of(9), spec.of(10), spec.of(29))] == [(20, 2), (20, 2), (5, 2), (5, 2)]


@pytest.mark.parametrize("classes, local", [(0, None), (3, None), (3, 70)])
def test_wanted_candidates_have_the_scores_of_all(spark, classes, local):
    rng = np.random.RandomState(6)
    pdf = pd.DataFrame({"id": np.arange(300), "a": rng.rand(300), "b": rng.rand(300), "y": rng.randint(0, 3, 300).astype(float)})
    df = spark.createDataFrame(pdf).withColumn("_fold", F.col("id") % 3)
    problem = "regression" if not classes else "classification_multi"
    rows, bins, labels, shift = estimators.forest_rows(df, "y", ["a", "b"], problem, {}, ["id"], F.col("_fold"))
    spec = estimators.forest_spec(problem, {}, 2, classes, shift)
    args = (rows, spec, bins, [0, 1, 2], [2, 5, 9], [2, 6, None], [2, 12], local)
    wanted = {(9, 2, 12), (5, 6, 2), (2, None, 2)}
    every = {tuple(r[:4]): r for r in forest.nested_scores(*args).collect()}
    some = {tuple(r[:4]): r for r in forest.nested_scores(*args, wanted=wanted).collect()}
    assert set(some) == {(f, *w) for f in range(3) for w in wanted} and len(every) == 54
    for at, r in some.items():
        assert all(math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9) for a, b in zip(r[4:], every[at][4:], strict=True))

"""Class trees whose nodes look at one feature: grown by counting and sorting packed sums, and in one task up to ``CLASS_ROWS`` rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.operators.models import estimators, forest


@pytest.mark.parametrize("rows, values, classes, heavy", [(3000, 256, 3, 1), (2500, 3, 2, 1), (900, 40, 40, 1), (1200, 9, 3, 70_000), (1, 5, 3, 1)])
def test_drawn_features_give_the_trees_of_the_plain_way(rows, values, classes, heavy):
    rng = np.random.RandomState(rows)
    x = rng.randint(0, values, (rows, 4)).astype(np.uint8)
    x[:, 2] = 1  # a feature without a cut
    edges = np.sort(rng.rand(255))
    bins = [forest.Bins(edges, np.r_[edges[:1], edges], np.r_[edges, edges[-1:]])] * 4
    count = rng.randint(1, 4, rows)
    stats = np.zeros((rows, classes))
    stats[np.arange(rows), rng.randint(0, classes, rows)] = count * rng.choice([1, heavy], rows)
    root = rng.randint(0, 2, rows)
    root[0] = 0
    spec = forest.Spec(depth=14, min_split=3, classes=classes, tries=1)
    args = (spec, bins, x, count, stats, root, np.array([forest.tree_seed(spec, t) for t in range(root.max() + 1)], dtype=np.uint64), 2)
    one, other = forest.grow_together(*args), forest._grow_any(*args)
    assert set(one) == set(other)
    for c in other:
        assert one[c].dtype == other[c].dtype and np.array_equal(one[c], other[c]), c


def test_class_trees_above_local_rows_need_no_level_passes(spark, monkeypatch):
    rng = np.random.RandomState(8)
    pdf = pd.DataFrame({"id": np.arange(400), "a": rng.rand(400), "b": rng.rand(400), "y": rng.randint(0, 3, 400).astype(float)})
    df = spark.createDataFrame(pdf).withColumn("_fold", F.col("id") % 3)
    rows, bins, _, _ = estimators.forest_rows(df, "y", ["a", "b"], "classification_multi", {}, ["id"], F.col("_fold"))
    spec = estimators.forest_spec("classification_multi", {}, 2, 3, 0.0)
    args = (rows, spec, bins, [0, 1, 2], [2, 5], [3, None], [2, 8])
    with_levels = sorted(map(str, forest.nested_scores(*args, local_rows=60).collect()))
    grown = []
    monkeypatch.setattr(forest, "LOCAL_ROWS", 60)
    monkeypatch.setattr(forest, "DEALT_BYTES", 500)  # many small batches of blocks
    tops = forest.grow_tops
    monkeypatch.setattr(forest, "grow_tops", lambda *a: grown.append(tops(*a)) or grown[-1])
    assert sorted(map(str, forest.nested_scores(*args).collect())) == with_levels
    assert all(len(t.nodes) == 1 for t in grown[-1].values())

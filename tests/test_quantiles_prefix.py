import numpy as np
import pandas as pd

from tessera.functions.prefix import running_sums
from tessera.functions.quantiles import approx_quantiles, exact_quantiles


def test_exact_quantiles_multi_bucket(spark):
    rng = np.random.RandomState(0)
    x = np.concatenate([rng.normal(size=3000), np.full(2000, 0.5)])   # a hot value: 40 % of rows
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": np.round(x * 3)}))
    probs = [0, 0.1, 0.25, 0.5, 0.75, 0.9, 1]
    for parts, values in ((1, 10_000_000), (40, 300), (3, 10)):
        q = exact_quantiles(df, ["x", "y"], probs, bucket_values=values, parts=parts)
        assert np.allclose(q["x"], np.quantile(x, probs))
        assert np.allclose(q["y"], np.quantile(np.round(x * 3), probs))


def test_exact_quantiles_recursive_refinement(spark):
    rng = np.random.RandomState(2)
    x = np.concatenate([rng.standard_cauchy(4000), np.full(1500, 0.25)])
    df = spark.createDataFrame(pd.DataFrame({"x": x}))
    probs = [0.0, 0.01, 0.3, 0.5, 0.77, 0.999, 1.0]
    # 3 buckets per level and 100 distinct values per final bucket: forces several levels
    q = exact_quantiles(df, ["x"], probs, bucket_values=100, parts=3)
    assert np.allclose(q["x"], np.quantile(x, probs))


def test_quantiles_edge_frames(spark):
    df = spark.createDataFrame([(1.0,), (1.0,), (1.0,), (1.0,), (2.0,), (3.0,)], "x double")
    assert exact_quantiles(df, ["x"], [0.5])["x"] == [1.0]
    empty = spark.createDataFrame([(None,)], "x double")
    assert exact_quantiles(empty, ["x"], [0.5])["x"] == [None]
    inf = spark.createDataFrame([(float("inf"),), (1.0,), (2.0,)], "x double")
    assert exact_quantiles(inf, ["x"], [0.5])["x"] == [1.5]     # +-inf treated as missing
    assert len(approx_quantiles(df, ["x"], [0.5])["x"]) == 1


def test_running_sums_many_ranges(spark):
    pdf = pd.DataFrame({"t": np.arange(1000, dtype=float), "v": np.arange(1000) % 7})
    df = spark.createDataFrame(pdf)
    out = running_sums(df, "t", ["v"], descending=True, ranges=20).toPandas().sort_values("t", ascending=False)
    assert np.allclose(out["cum_v"].values, pdf.sort_values("t", ascending=False)["v"].cumsum().values)
    one = running_sums(df, "t", ["v"], descending=True, ranges=1).toPandas().sort_values("t", ascending=False)
    assert (one.reset_index(drop=True) == out.reset_index(drop=True)).all().all()


def test_a_hot_least_value_is_refined(spark):
    x = np.concatenate([np.zeros(5000), np.arange(1, 400)])
    df = spark.createDataFrame(pd.DataFrame({"x": x}))
    probs = [0.0, 0.5, 0.93, 0.99, 1.0]
    assert np.allclose(exact_quantiles(df, ["x"], probs, bucket_values=20, parts=2)["x"], np.quantile(x, probs))


def test_narrowing_reaches_single_values(spark, monkeypatch):
    from tessera.functions import quantiles as Q

    def other_way(*_):
        raise AssertionError("not narrowed")

    rng = np.random.RandomState(5)
    x = np.concatenate([rng.standard_cauchy(40_000), np.full(20_000, 0.25)])     # a third of the rows are one value
    pdf = pd.DataFrame({"x": x, "y": np.r_[np.full(59_999, 7.0), 8.0], "z": np.arange(60_000) % 50})
    df = spark.createDataFrame(pdf).repartition(5)
    probs = [0.0, 0.01, 0.3, 0.5, 0.50001, 0.77, 0.999, 1.0]
    with monkeypatch.context() as m:
        m.setattr(Q, "_by_buckets", other_way)
        for values in (1_000_000, 60):           # 60: the intervals are narrowed again
            got = exact_quantiles(df, ["x", "y", "z"], probs, bucket_values=values)
            for c in pdf:
                assert np.allclose(got[c], np.quantile(pdf[c], probs)), c
    with monkeypatch.context() as m:             # a sketch that misses its rank is noticed
        m.setattr(Q, "MARGIN", -0.01)
        assert np.allclose(exact_quantiles(df, ["x"], [0.1, 0.9])["x"], np.quantile(x, [0.1, 0.9]))

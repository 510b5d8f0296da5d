import math

import pytest

from tessera.operators import profile as P


def facts(spark, rows, schema):
    return P.column_facts(spark.createDataFrame(rows, schema))


def test_integer_autotypes(spark):
    f = facts(spark, [(1, 1, i % 20 + 1, i) for i in range(21)], "a bigint, b bigint, c bigint, d bigint")
    assert f["a"]["autotype"] == "Continuous"          # one distinct value
    assert f["c"]["autotype"] == "Categorical"         # 20 distinct
    assert f["d"]["autotype"] == "Continuous"          # 21 distinct
    f2 = facts(spark, [(1,), (2,), (1,)], "x bigint")
    assert f2["x"]["autotype"] == "Binary"


def test_integer_with_null_is_continuous(spark):
    f = facts(spark, [(1,), (2,), (None,)], "i bigint")
    assert f["i"]["autotype"] == "Continuous"
    assert f["i"]["dtype"] == "float64"
    assert f["i"]["pct_missing"] == pytest.approx(33.33)


def test_string_autotypes_and_bool_like(spark):
    f = facts(spark, [("TRUE", "t", " Yes", "a"), ("true", "f", "no", "b")], "s1 string, s2 string, s3 string, s4 string")
    assert f["s1"]["autotype"] == "Binary"     # one folded value
    assert f["s2"]["autotype"] == "Boolean"
    assert f["s3"]["autotype"] == "Boolean"
    assert f["s4"]["autotype"] == "Binary"
    many = facts(spark, [(f"v{i}",) for i in range(21)], "s string")
    assert many["s"]["autotype"] == "Descriptive"


def test_mode_tie_smallest(spark):
    f = facts(spark, [("b",), ("a",), ("b",), ("a",), (None,)], "s string")
    assert f["s"]["mode"] == "a"
    assert f["s"]["n_unique"] == 2


def test_double_nan_is_missing(spark):
    f = facts(spark, [(1.0,), (float("nan"),), (3.0,)], "x double")
    assert f["x"]["n_missing"] == 1
    assert f["x"]["dmean"] == pytest.approx(2.0)


def test_outlier_percent_and_empty(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 2, 3, 4, 100]], "x double")
    assert P.iqr_outlier_percent(df, "x") == 20.0
    empty = spark.createDataFrame([(None,)], "x double")
    assert P.iqr_outlier_percent(empty, "x") is None


def test_count_duplicates_nulls_equal(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, "a")], "a int, b string")
    assert P.count_duplicates(df) == 1


def test_datetime_format_guess(spark):
    df = spark.createDataFrame([(2, "2020-01-31"), (1, "31/01/2020")], "k int, d string")
    assert P.infer_datetime_format(df, "d", ["k"]).collect()[0]["format_guess"] == "DD/MM/YYYY"

import math

import numpy as np
import pytest

from tessera.llm import whitening


def exact(rows, components=32):
    """Eigen-decomposition of the covariance matrix, from exact integers."""
    x = [[math.floor(64.0 * c) + 1_000_000 for c in v] for _, v in rows]
    n, sums = len(x), [sum(col) for col in zip(*x)]
    dev = [sum((n * a - s) ** 2 for a, s in zip(row, sums)) for row in x]
    a = np.array([[float(n * b - s) / n for b, s in zip(row, sums)] for row in x])
    e, v = np.linalg.eigh(a.T @ a / n)
    e, v = e[::-1], v[:, ::-1]
    return n, dev, a, e, v[:, :components]


def check(got, rows, components):
    n, dev, a, e, v = exact(rows, components)
    by_row = {}
    for r in got:
        by_row.setdefault(r["vec_id"], {})[r["component"]] = r
    assert set(by_row) == {i for i, _ in rows}
    w = np.array([[by_row[i][c + 1]["whitened"] for c in range(v.shape[1])] for i, _ in rows])
    want = a @ v / np.sqrt(e[:v.shape[1]])
    sign = np.sign((w * want).sum(axis=0))
    assert np.abs(w - want * sign).max() < 1e-6
    for (i, _), d in zip(rows, dev):
        assert by_row[i][1]["deviation"] == d and by_row[i][1]["n"] == n
    for c in range(v.shape[1]):
        assert abs(by_row[rows[0][0]][c + 1]["explained"] / (e[c] / e.sum()) - 1) < 1e-9
    errors = {r["identity_error"] for r in got}
    assert len(errors) == 1 and errors.pop() < 1e-9
    assert np.abs(w.T @ w / n - np.eye(v.shape[1])).max() < 1e-9


def test_query_against_eigenvectors(spark, sf):
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = [(r["vec_id"], [float(x) for x in r["embedding"]]) for r in vectors.collect()]
    got = whitening.op12_whitening_qr(vectors).collect()
    n, _, a, e, _ = exact(rows)
    rank = min(32, int((e > 1e-18 * e[0]).sum()))
    assert len(got) == rank * len(rows)
    check(got, rows, rank)


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>")


def test_ill_conditioned_columns(spark):
    rng = np.random.RandomState(1)
    x = rng.randn(500, 40) * 1e4
    x[:, 1] = x[:, 0] + rng.randn(500) * 0.05  # nearly dependent
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = whitening.op12_whitening_qr(frame(spark, rows)).collect()
    assert len(got) == 500 * 32
    check(got, rows, 32)
    model = whitening.fit(whitening.integer_vectors(frame(spark, rows)), 40)
    assert len(model.eigenvalues) == 40 and model.passes >= 2
    a = exact(rows)[2]
    assert abs(np.linalg.svd(a)[1][-1] / np.sqrt(model.eigenvalues[-1] * 500) - 1) < 1e-6  # the smallest, lost to a plain covariance's rounding


def test_dependent_dimensions_are_left_out(spark):
    rng = np.random.RandomState(2)
    base = rng.randint(-300, 300, (200, 3))
    rows = [(i, [float(a), float(a), 5.0, float(b), float(c), float(a + b)]) for i, (a, b, c) in enumerate(base)]
    got = whitening.op12_whitening_qr(frame(spark, rows)).collect()
    assert {r["component"] for r in got} == {1, 2, 3}
    check(got, rows, 3)
    few = whitening.op12_whitening_qr(frame(spark, rows[:3])).collect()  # three rows span two directions
    assert {r["component"] for r in few} == {1, 2} and len(few) == 6


def test_odd_rows(spark):
    nan = float("nan")
    rows = [(0, [1.0, 2.0]), (1, [3.0, -1.0]), (1, [0.5, 0.25]), (None, [2.0, 2.0]), (2, None), (3, []), (4, [1.0, nan]), (5, [None, 1.0]),
            (6, [float("inf"), 0.0]), (7, [1.0, 2.0, 3.0]), (8, [0.0, 0.0])]
    df = spark.createDataFrame([(i, v, "a", 1) for i, v in rows], "vec_id long, embedding array<double>, n string, component int")
    got = whitening.op12_whitening_qr(df).collect()
    assert len(got) == 10 and all(r["n"] == 5 for r in got)
    kept = [(0, [1.0, 2.0]), (1, [3.0, -1.0]), (1, [0.5, 0.25]), (None, [2.0, 2.0]), (8, [0.0, 0.0])]
    assert sorted(r["deviation"] for r in got if r["component"] == 1) == sorted(exact(kept)[1])
    for empty in (df.where("false"), df.where("vec_id = 0"), df.where("vec_id = 0").union(df.where("vec_id = 0")), df.where("vec_id = 3")):
        assert whitening.op12_whitening_qr(empty).collect() == []
    with pytest.raises(Exception, match="too large"):
        whitening.op12_whitening_qr(frame(spark, [(1, [1e300])])).collect()


def test_exact_deviation_beyond_64_bits():
    x = np.array([[10 ** 15, 3], [-(10 ** 15), 4]])
    sums = [7 * 10 ** 14, 11]
    y = whitening.scaled_deviation(x, 10 ** 6, sums)
    want = [[10 ** 6 * a - s for a, s in zip(row, sums)] for row in x.tolist()]
    assert y.tolist() == want and whitening.squared_sum(y) == [sum(v * v for v in row) for row in want]
    z = whitening.scaled_deviation(np.array([[1_000_064, 999_936]]), 50_000, [50_000 * 1_000_000 + 17, 5])
    assert z.tolist() == [[50_000 * 1_000_064 - 50_000 * 1_000_000 - 17, 50_000 * 999_936 - 5]]


def test_triangular_solve_and_shift():
    rng = np.random.RandomState(3)
    r = np.triu(rng.randn(6, 6)) + 5 * np.eye(6)
    a = rng.randn(10, 6)
    assert np.allclose(whitening.solve_right(a, r) @ r, a)
    g = np.ones((3, 3))  # singular
    f = whitening.triangular_factor(g, 0.0)
    assert np.allclose(f.T @ f, g, atol=1e-12) and np.allclose(f, np.triu(f))

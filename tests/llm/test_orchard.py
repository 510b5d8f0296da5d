import hashlib
import math

import numpy as np
import pytest

from tessera.llm import orchard


def brute(rows, k=8, rounds=10, dims=64):
    """The contract, with Python integers."""
    kept = [(i, [math.floor(1024.0 * x) for x in v]) for i, v in rows
            if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [list(v) for _, v in order[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        centroids = [[sum(col) // len(groups[j]) for col in zip(*groups[j])] if j in groups else c for j, c in enumerate(centroids)]
    out = [(i, *reversed(nearest(v))) for i, v in kept]
    inertia = {j: sum(d for _, c, d in out if c == j) for j in range(len(centroids))}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, c, d, inertia[c], sum(inertia.values()), digest[c]) for i, c, d in out), key=repr)


def test_query_against_brute_force(spark, sf):
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = [(r["vec_id"], [float(x) for x in r["embedding"]]) for r in vectors.select("vec_id", "embedding").collect()]
    got = sorted((tuple(r) for r in orchard.op11_orchard_clusters(vectors).collect()), key=repr)
    assert got == brute(rows) and len(got) == len(rows)


def test_odd_rows(spark):
    rng = np.random.RandomState(0)
    v = [(rng.randn(64) * 3).tolist() for _ in range(30)]
    nan = float("nan")
    rows = [(i, x) for i, x in enumerate(v)] + [(5, v[5]), (5, v[6]), (None, v[1]), (31, None), (32, []), (33, v[0][:63]), (34, v[0] + [1.0]),
            (35, [nan] + v[0][1:]), (36, [None] + v[0][1:]), (37, [float("-inf")] + v[0][1:]), (38, [0.0] * 64), (39, [-0.0] * 64)]
    df = spark.createDataFrame([(i, x, 7, "a") for i, x in rows], "vec_id long, embedding array<double>, cluster int, distance string")
    got = sorted((tuple(r) for r in orchard.op11_orchard_clusters(df).collect()), key=repr)
    assert got == brute(rows) and len(got) == 35
    assert orchard.op11_orchard_clusters(df.where("false")).collect() == []
    few = orchard.op11_orchard_clusters(df.where("vec_id < 3")).collect()  # fewer rows than centroids: each is its own
    assert sorted(r["cluster"] for r in few) == [0, 1, 2] and all(r["distance"] == r["inertia"] == 0 for r in few)
    same = spark.createDataFrame([(i, v[0]) for i in range(20)], "vec_id long, embedding array<double>")
    assert {r["cluster"] for r in orchard.op11_orchard_clusters(same).collect()} == {0}  # ties: the smaller number
    with pytest.raises(Exception, match="too large"):
        orchard.op11_orchard_clusters(spark.createDataFrame([(1, [1e30] * 64)], "vec_id long, embedding array<double>")).collect()


@pytest.mark.parametrize("dims, k", [(2, 40), (3, 100), (8, 30)])
def test_orchard_is_exact_and_measures_less(dims, k):
    rng = np.random.RandomState(k)
    centroids = rng.randint(-50, 50, (k, dims))
    centroids[3] = centroids[7]  # equal centroids
    x = rng.randint(-60, 60, (4000, dims))
    all_d = ((x[:, None, :] - centroids[None]) ** 2).sum(axis=2)
    search = orchard.Orchard(centroids)
    for start in (0, k - 1):
        at, d, measured = search.nearest(x, start)
        assert (at == all_d.argmin(axis=1)).all() and (d == all_d.min(axis=1)).all()  # argmin takes the smaller number
        assert measured <= (0.8 if dims < 8 else 1.0) * len(x) * k


def test_lists_are_sorted_and_complete():
    c = np.array([[0, 0], [3, 0], [1, 0], [0, 2]])
    o = orchard.Orchard(c)
    assert o.lists[0].tolist() == [2, 3, 1] and o.gaps[0].tolist() == [1, 4, 9]
    assert orchard.Orchard(c[:1]).nearest(np.array([[5, 5]]))[0].tolist() == [0]


def test_many_clusters_and_partitions(spark):
    rng = np.random.RandomState(5)
    rows = [(i, (rng.randn(3) * 4).tolist()) for i in range(3000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(13)
    got, centroids = orchard.cluster_vectors(df, k=50, rounds=2, dims=3)
    x = np.array([[math.floor(1024 * a) for a in v] for _, v in rows])
    d = ((x[:, None, :] - centroids[None]) ** 2).sum(axis=2)
    assert {r["vec_id"]: (r["cluster"], r["distance"]) for r in got.collect()} == {i: (int(d[i].argmin()), int(d[i].min())) for i in range(3000)}

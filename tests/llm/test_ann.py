import numpy as np

from pyspark.sql import functions as F
from tessera.llm import ann


def exact(ids, x, queries, k):
    out = {}
    for i in queries:
        q = x[list(ids).index(i)]
        ranked = sorted((-float((v * q).sum()), j) for j, v in zip(ids, x) if j != i)[:k]
        out[i] = [(j, -s) for s, j in ranked]
    return out


def collected(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return {i: [x[1:] for x in sorted(v)] for i, v in out.items()}


def test_recall_of_the_query(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = vectors.collect()
    ids, x = [r["vec_id"] for r in rows], np.array([r["embedding"] for r in rows], dtype=np.float64)
    want = exact(ids, x, [i for i in ids if i % 20 == 0], 20)
    got = collected(ann.op10_ann_kmeans_tree(vectors))
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    hits = sum(len({j for j, _ in got[i]} & {j for j, _ in want[i]}) for i in want)
    assert hits / (20 * len(want)) >= 0.9
    place = dict(zip(ids, x))
    for i, v in got.items():
        assert v == sorted(v, key=lambda r: (-r[1], r[0]))
        assert all(abs(s - float((place[i] * place[j]).sum())) < 1e-12 for j, s in v)


def test_all_leaves_give_the_exact_answer(spark, sf):
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = vectors.collect()
    ids, x = [r["vec_id"] for r in rows], np.array([r["embedding"] for r in rows], dtype=np.float64)
    got = collected(ann.search(vectors, F.col("vec_id") % 20 == 0, k=7, recall=1.01))
    want = exact(ids, x, [i for i in ids if i % 20 == 0], 7)
    assert {i: [j for j, _ in v] for i, v in got.items()} == {i: [j for j, _ in v] for i, v in want.items()}


def test_ties_in_split_leaves_go_to_the_smaller_id(spark, monkeypatch):
    monkeypatch.setattr(ann, "VECTOR_BLOCK", 16)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 2)
    rng = np.random.RandomState(0)
    rows = [(i, [1.0, 0.0, 0.0] if i % 3 else rng.randn(3).tolist()) for i in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    ids, x = [i for i, _ in rows], np.array([v for _, v in rows])
    got = collected(ann.search(df, F.col("vec_id") % 20 == 0, recall=1.01))
    assert got == {i: v for i, v in exact(ids, x, [i for i in ids if i % 20 == 0], 20).items()}


def test_best_bins_come_off_the_queue_in_order():
    rng = np.random.RandomState(1)
    x = rng.randn(500, 8)
    tree = ann.Tree.fit(x, 30)
    assert tree.leaves == 30 and sorted(set(tree.assign(x))) == list(range(30))
    for bins in tree.best_bins(x[:5], 30):
        assert sorted(bins) == list(range(30))
    assert all(len(b) == 4 for b in tree.best_bins(x[:5], 4))


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0], "a"), (20, [0.5, 0.5], "a"), (1, None, "a"), (2, [0.0, 0.0], "a"), (3, [1.0, nan], "a"), (4, [inf, 1.0], "a"), (5, [1.0, None], "a"),
            (None, [1.0, 1.0], "a"), (6, [1.0, 1.0, 1.0], "a"), (7, [3.0, 1.0], "a"), (7, [3.0, 1.0], "a"), (8, [], "a"), (40, [0.0, 0.0], "a"), (60, None, "a")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    got = collected(ann.search(df, F.col("vec_id") % 20 == 0))
    assert got == {0: [(7, 5.0), (20, 1.5)], 20: [(7, 2.0), (0, 1.5)]}
    assert ann.op10_ann_kmeans_tree(df.where("false")).collect() == []
    assert ann.search(df.where("vec_id = 7"), F.col("vec_id") % 20 == 0).collect() == []
    assert ann.search(df.where("vec_id = 20"), F.col("vec_id") % 20 == 0).collect() == []


def test_every_query_gets_k_rows_where_leaves_are_small(spark):
    rng = np.random.RandomState(3)
    centers = rng.randn(20, 8) * 5
    of = [g for g in range(10) for _ in range(590)] + [g for g in range(10, 20) for _ in range(10)]
    order = rng.permutation(len(of))
    df = spark.createDataFrame([(i, centers[of[j]].tolist()) for i, j in enumerate(order)], "vec_id long, embedding array<double>")
    got = collected(ann.op10_ann_kmeans_tree(df))
    assert len(got) == 300 and all(len(v) == 20 for v in got.values())
    few = collected(ann.search(df.where("vec_id < 15"), F.col("vec_id") % 5 == 0, leaves=8))
    assert len(few) == 3 and all(len(v) == 14 for v in few.values())  # fewer candidates than k: all of them


def test_vectors_are_copied_to_chunks_of_their_own_leaf(spark, monkeypatch):
    monkeypatch.setattr(ann, "VECTOR_BLOCK", 64)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 4)
    copies = []
    for n in (1280, 2560, 5120):  # as many leaves as there are groups of 64
        leaves = n // 64
        placed = spark.range(n).select(F.col("id").alias("vec_id"), F.array(F.lit(1.0)).alias("v"), (F.col("id") % leaves).cast("int").alias("leaf"))
        routed = placed.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"), F.array(
            "leaf", ((F.col("leaf") + 1) % leaves).cast("int")).alias("leaf"))
        blocks, questions = ann.blocks_of(placed, routed, {leaf: 64 for leaf in range(leaves)})
        copies.append((blocks.count(), questions.count()))
        asked = {r["leaf"] for r in questions.select("leaf").distinct().collect()}
        assert {r["leaf"] for r in blocks.select("leaf").distinct().collect()} == asked  # leaves without queries are not copied
    assert copies[1] == tuple(2 * c for c in copies[0]) and copies[2] == tuple(4 * c for c in copies[0])


def test_odd_columns_of_the_query(spark):
    df = spark.createDataFrame([(0, [1.0], 5, "x"), (20, [2.0], 5, "x"), (3, [-1.0], 5, "x")], "vec_id long, embedding array<double>, rank int, leaf string")
    assert collected(ann.op10_ann_kmeans_tree(df)) == {0: [(20, 2.0), (3, -1.0)], 20: [(0, 2.0), (3, -2.0)]}

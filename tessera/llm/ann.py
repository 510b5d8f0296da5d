"""Nearest neighbours with a hierarchical k-means tree and best-bin-first search.

The tree is fitted on a bounded sample (``FIT_ROWS`` vectors chosen by a hash of
the id) and broadcast: at most ``MAX_LEAVES`` leaves and their ancestors.  Every
vector is put into the leaf that it descends to.  A query walks the tree with a
priority queue over nodes, the node with the largest inner product first, and
visits leaves in the order in which they leave the queue.

How many leaves are visited is calibrated: for ``CALIBRATION`` queries the exact
neighbours are found by brute force over all rows, and the visits are widened
until the mean recall reaches ``RECALL``.

A query whose visited leaves hold too few vectors goes on down its queue until they hold ``k`` besides its own.

The search itself is a join by leaf.  A leaf's vectors are dealt to shards and the
queries that visit it to chunks, so no task holds more than a block of each; a shard is
copied only to the chunks of its own leaf, and not at all if no query visits the leaf.
A block gives each of its queries the best ``k`` it has, and the best of all
blocks are the answer.  Scores are computed again in double precision, one
vector at a time, so equal vectors score alike and ties go to the smaller id.

Defined cases: vectors that are null, empty, all zero, or have null or
non-finite components take no part, nor do rows without an id, nor vectors that
have not the commonest length (of two, the smaller); an id that repeats is one
vector, the smallest in array order; every query gets ``k`` rows, or all
candidates if there are fewer; equal scores go to the smaller id; without queries
or vectors the result is empty.  Texts are not read.  Columns of the input other than the id and
the vector are not read, so their names cannot clash with the result's.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import hash_fraction, materialize

K = 20
FIT_ROWS = 20_000
MAX_LEAVES = 4096
BRANCHES = 8
CALIBRATION = 200
RECALL = 0.97
VECTOR_BLOCK, QUERY_BLOCK = 4096, 8192


class Tree:
    """Centroids, children and leaf numbers of a k-means tree; node 0 is the root."""

    def __init__(self, dims: int):
        self.centroids = [np.zeros(dims)]
        self.children: list[list[int]] = [[]]
        self.leaf = [-1]
        self.leaves = 0

    @classmethod
    def fit(cls, sample: np.ndarray, leaves: int, seed: int = 3) -> Tree:
        tree = cls(sample.shape[1])
        rng = np.random.RandomState(seed)
        todo = [(-len(sample), 0, np.arange(len(sample)))]
        count = 1
        while todo:
            size, node, rows = heapq.heappop(todo)  # the largest node is split first
            k = min(BRANCHES, leaves - count + 1, len(rows))
            parts = cls._cluster(sample[rows], k, rng) if k > 1 else []
            if len(parts) < 2:
                tree.leaf[node] = tree.leaves
                tree.leaves += 1
                continue
            count += len(parts) - 1
            for part in parts:
                child = len(tree.centroids)
                tree.centroids.append(sample[rows[part]].mean(axis=0))
                tree.children.append([])
                tree.leaf.append(-1)
                tree.children[node].append(child)
                heapq.heappush(todo, (-len(part), child, rows[part]))
        tree.points = np.stack(tree.centroids)
        return tree

    @staticmethod
    def _cluster(x: np.ndarray, k: int, rng) -> list[np.ndarray]:
        centers = x[rng.permutation(len(x))[:k]].copy()
        own = np.zeros(len(x), dtype=int)
        for _ in range(12):
            own = ((centers ** 2).sum(axis=1) - 2 * x @ centers.T).argmin(axis=1)
            for j in range(k):
                if (own == j).any():
                    centers[j] = x[own == j].mean(axis=0)
        return [p for j in range(k) if len(p := np.flatnonzero(own == j))]

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector: at each node the child with the nearest centroid."""
        out = np.empty(len(x), dtype=np.int32)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            kids = self.children[node]
            if not kids:
                out[rows] = self.leaf[node]
                continue
            c = self.points[kids]
            own = ((c ** 2).sum(axis=1) - 2 * x[rows] @ c.T).argmin(axis=1)
            todo += [(kid, rows[own == j]) for j, kid in enumerate(kids) if (own == j).any()]
        return out

    def best_bins(self, queries: np.ndarray, visits: int, sizes: np.ndarray | None = None, need: int = 0) -> list[list[int]]:
        """The leaves each query visits, best bin first: ``visits`` of them, and more while those hold fewer than ``need`` vectors."""
        near = queries @ self.points.T
        held = np.zeros(self.leaves, dtype=np.int64) if sizes is None else sizes
        out = []
        for row in near.tolist():
            queue, found, have = [(0.0, 0)], [], 0
            while queue and (len(found) < visits or have < need):
                _, node = heapq.heappop(queue)
                if self.children[node]:
                    for kid in self.children[node]:
                        heapq.heappush(queue, (-row[kid], kid))
                else:
                    found.append(self.leaf[node])
                    have += held[self.leaf[node]]
            out.append(found)
        return out


def usable(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``vec_id, v``: one finite non-zero vector an id, all of one length."""
    base = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"))
    good = (F.col("vec_id").isNotNull() & F.col("v").isNotNull() & F.exists("v", lambda x: x != 0)
            & ~F.coalesce(F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(True)))
    base = base.where(F.coalesce(good, F.lit(False)))
    sizes = base.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    if sizes is None:
        return base
    return base.where(F.size("v") == sizes["d"]).groupBy("vec_id").agg(F.min("v").alias("v"))


def _top(ids: np.ndarray, x: np.ndarray, query_id: int, query: np.ndarray, rough: np.ndarray, k: int):
    """The best ``k`` rows other than the query's own: ids and scores, by exact score, then id."""
    rough = np.where(ids == query_id, -np.inf, rough)
    n = min(k, int(np.isfinite(rough).sum()))
    if not n:
        return ids[:0], rough[:0]
    edge = np.partition(rough, len(rough) - n)[len(rough) - n]
    some = np.flatnonzero(rough >= edge - 1e-9 * (1.0 + abs(edge)))
    score = (x[some] * query).sum(axis=1)
    order = np.lexsort((ids[some], -score))[:n]
    return ids[some][order], score[order]


def _matrix(column) -> np.ndarray:
    return np.stack(column.to_numpy()) if len(column) else np.zeros((0, 0))


def _block_search(k: int):
    def run(vectors: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], "vec_id": [], "score": []}
        if len(vectors) and len(queries):
            ids, x = vectors["vec_id"].to_numpy(), _matrix(vectors["v"])
            for a in range(0, len(queries), 256):
                part = queries.iloc[a:a + 256]
                q = _matrix(part["q"])
                for qid, one, rough in zip(part["query_id"].to_numpy(), q, q @ x.T):
                    got, score = _top(ids, x, qid, one, rough, k)
                    out["query_id"].append(np.full(len(got), qid))
                    out["vec_id"].append(got)
                    out["score"].append(score)
        return pd.DataFrame({c: np.concatenate(v) if v else np.zeros(0, np.float64 if c == "score" else np.int64) for c, v in out.items()})

    return run


def _ranked(found: DataFrame, k: int) -> DataFrame:
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", best).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def brute_force(vectors: DataFrame, ids: np.ndarray, queries: np.ndarray, k: int) -> DataFrame:
    """Exact neighbours of a few given queries: each task returns its best ``k`` for each query."""

    def run(batches):
        for batch in batches:
            own, x = batch["vec_id"].to_numpy(), _matrix(batch["v"])
            if not len(own):
                continue
            parts = [(qid, *_top(own, x, qid, q, x @ q, k)) for qid, q in zip(ids, queries)]
            yield pd.DataFrame({"query_id": np.concatenate([np.full(len(g), i) for i, g, _ in parts]),
                                "vec_id": np.concatenate([g for _, g, _ in parts]), "score": np.concatenate([s for _, _, s in parts])})

    return _ranked(vectors.mapInPandas(run, "query_id long, vec_id long, score double"), k)


def build(vectors: DataFrame, fit_rows: int = FIT_ROWS, leaves: int | None = None) -> tuple[Tree, int] | None:
    """The tree and the number of vectors; the number of leaves follows the cube root of the rows."""
    n = vectors.count()
    if not n:
        return None
    chosen = vectors.where(hash_fraction(F.col("vec_id").cast("string"), "ann-fit") < min(1.0, fit_rows / n)).limit(2 * fit_rows)
    sample = chosen.toPandas().sort_values("vec_id")
    if not len(sample):
        sample = vectors.orderBy("vec_id").limit(1).toPandas()
    if leaves is None:
        leaves = max(1, min(MAX_LEAVES, round(2 * n ** (1 / 3))))
    return Tree.fit(_matrix(sample["v"]), leaves), n


def calibrate(vectors: DataFrame, queries: DataFrame, tree: Tree, k: int = K, recall: float = RECALL, size: int = CALIBRATION) -> int:
    """The fewest leaf visits whose mean recall over a bounded sample of the queries reaches ``recall``."""
    n = queries.count()
    part = queries.where(hash_fraction(F.col("vec_id").cast("string"), "ann-cal") < min(1.0, 1.5 * size / max(n, 1)))
    sample = part.orderBy(F.xxhash64("vec_id")).limit(size).toPandas()
    if not len(sample):
        return tree.leaves
    ids, q = sample["vec_id"].to_numpy(), _matrix(sample["v"])
    exact = brute_force(vectors.select("vec_id", "v"), ids, q, k)
    exact = exact.join(vectors.select("vec_id", "leaf"), "vec_id").select("query_id", "leaf").toPandas()  # at most size * k rows
    if not len(exact):
        return tree.leaves
    order = {i: {leaf: at for at, leaf in enumerate(bins)} for i, bins in zip(ids, tree.best_bins(q, tree.leaves))}
    needed = np.array([order[i][leaf] for i, leaf in zip(exact["query_id"], exact["leaf"])]) + 1
    weight = 1.0 / exact.groupby("query_id")["leaf"].transform("size").to_numpy()
    visits = 1
    while visits < tree.leaves and weight[needed <= visits].sum() < recall * weight.sum():
        visits += 1
    return visits


def search(vectors: DataFrame, is_query, k: int = K, recall: float = RECALL, leaves: int | None = None, vec_id: str = "vec_id",
           embedding: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` vectors with the largest inner product for each query.

    ``is_query`` is a condition on ``vec_id``.
    """
    spark = vectors.sparkSession
    empty = "query_id long, rank int, vec_id long, score double"
    rows = materialize(usable(vectors, vec_id, embedding), "ann-vectors")
    built = build(rows, leaves=leaves)
    if built is None:
        return spark.createDataFrame([], empty)
    tree, n = built
    shared = spark.sparkContext.broadcast(tree)  # at most MAX_LEAVES leaves and fewer inner nodes

    def leaf_of(batches):
        for batch in batches:
            if len(batch):
                yield batch.assign(leaf=shared.value.assign(_matrix(batch["v"])))

    placed = materialize(rows.mapInPandas(leaf_of, "vec_id long, v array<double>, leaf int"), "ann-leaves")
    asked = rows.where(is_query)
    visits = calibrate(placed, asked, tree, k, recall)
    sizes = {r["leaf"]: r["n"] for r in placed.groupBy("leaf").agg(F.count("*").alias("n")).collect()}  # a row a leaf
    held = np.array([sizes.get(leaf, 0) for leaf in range(tree.leaves)], dtype=np.int64)

    def bins_of(batches):
        for batch in batches:
            if len(batch):
                yield pd.DataFrame({"query_id": batch["vec_id"], "q": batch["v"], "leaf": shared.value.best_bins(_matrix(batch["v"]), visits, held, k + 1)})

    routed = materialize(asked.select("vec_id", "v").mapInPandas(bins_of, "query_id long, q array<double>, leaf array<int>"), "ann-queries")
    blocks, questions = blocks_of(placed, routed, sizes)
    keys = ["leaf", "shard", "chunk"]
    found = blocks.groupBy(*keys).cogroup(questions.groupBy(*keys)).applyInPandas(
        _block_search(k), "query_id long, vec_id long, score double")
    return _ranked(found, k)


def blocks_of(placed: DataFrame, routed: DataFrame, sizes: dict[int, int]) -> tuple[DataFrame, DataFrame]:
    """Vectors and queries by (leaf, shard, chunk): a leaf has shards by its vectors and chunks by the queries that visit it."""
    visits = routed.select(F.explode("leaf").alias("leaf")).groupBy("leaf").agg(F.count("*").alias("n")).collect()  # a row a leaf
    dealt = [(r["leaf"], -(-sizes.get(r["leaf"], 0) // VECTOR_BLOCK), -(-r["n"] // QUERY_BLOCK)) for r in visits if sizes.get(r["leaf"])]
    parts = F.broadcast(placed.sparkSession.createDataFrame(dealt, "leaf int, shards int, chunks int"))  # at most MAX_LEAVES rows
    blocks = placed.join(parts, "leaf").select(
        "vec_id", "v", "leaf", F.pmod(F.xxhash64("vec_id"), F.col("shards")).cast("int").alias("shard"),
        F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
    questions = routed.select("query_id", "q", F.explode("leaf").alias("leaf")).join(parts, "leaf").select(
        "query_id", "q", "leaf", F.pmod(F.xxhash64("query_id"), F.col("chunks")).cast("int").alias("chunk"),
        F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"))
    return blocks, questions


def op10_ann_kmeans_tree(vectors: DataFrame) -> DataFrame:
    return search(vectors.select("vec_id", "embedding"), F.col("vec_id") % 20 == 0)

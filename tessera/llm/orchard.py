"""Centroid clustering whose assignment step is Orchard's search.

Vectors become integers, so distances, sums and means are exact and reruns agree on any cluster.
Every centroid has the list of the other centroids by rising distance.  The search for a vector
starts at one centroid and walks that centroid's list.  A centroid that was looked at is marked and
not measured again; whenever a closer one is found the walk jumps to its list; it stops at the
first listed centroid that lies strictly beyond twice the current distance, because by the triangle
inequality no centroid from there on can be as near.  A batch of vectors walks in step with numpy.

A round is one pass over the written integer table.  A task returns the sums and counts of its
clusters, which one aggregate adds up: a few numbers a cluster reach the driver and nothing else.

Defined cases: rows whose vector is null, has null or non-finite components or not exactly ``dims``
of them take no part and are not in the result; ids may be null or repeat, each row is a vector of its
own; the start centroids are the rows with the smallest hashes (a null id after all others, equal ids by their
components); fewer rows than ``k`` make fewer centroids; equal distances go to the smaller centroid number; a
centroid without vectors stays where it is; an empty table gives no rows; components whose
integer is beyond ``2^27`` (for 64 of them) raise an error, since distances would not fit 64 bits.
Columns of the input other than the id and the vector are not read, so their names cannot clash.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialize
from tessera.llm.vectors import is_finite, matrix, keyed, scaled_integers, sum_by_key

DIMS, FACTOR, CLUSTERS, ROUNDS, SEED = 64, 1024, 8, 10, "3"
#: Neighbour lists hold CLUSTERS^2 numbers on every worker.
MAX_CLUSTERS = 4096


class Orchard:
    """Integer centroids with each one's neighbours by rising distance (its own number left out)."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = np.ascontiguousarray(centroids, dtype=np.int64)
        k = len(self.centroids)
        gaps = np.stack([((self.centroids - c) ** 2).sum(axis=1) for c in self.centroids])
        order = np.argsort(gaps, axis=1, kind="stable")
        self.lists = np.stack([row[row != i] for i, row in enumerate(order)]) if k > 1 else np.zeros((k, 0), int)
        self.gaps = np.take_along_axis(gaps, self.lists, axis=1)

    def nearest(self, x: np.ndarray, start: int = 0) -> tuple[np.ndarray, np.ndarray, int]:
        """The nearest centroid of each row (ties: smaller number), its squared distance, and how many distances were measured."""
        n, k = len(x), len(self.centroids)
        at = np.full(n, start)
        d = ((x - self.centroids[start]) ** 2).sum(axis=1)
        visited = np.zeros((n, k), dtype=bool)
        visited[:, start] = True
        place = np.zeros(n, dtype=int)
        active, measured = np.arange(n), n
        while True:
            active = active[place[active] < k - 1]
            # Twice the distance is four times its square; equality goes on, it may hold a tie.  (gap <= 4 d without overflow)
            active = active[-(-self.gaps[at[active], place[active]] // 4) <= d[active]]
            if not len(active):
                return at, d, measured
            other = self.lists[at[active], place[active]]
            place[active] += 1
            new = ~visited[active, other]
            rows, other = active[new], other[new]
            visited[rows, other] = True
            dist = ((x[rows] - self.centroids[other]) ** 2).sum(axis=1)
            measured += len(rows)
            closer = (dist < d[rows]) | ((dist == d[rows]) & (other < at[rows]))
            rows, other, dist = rows[closer], other[closer], dist[closer]
            at[rows], d[rows], place[rows] = other, dist, 0


def integer_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", dims: int = DIMS, factor: int = FACTOR) -> DataFrame:
    """``vec_id, x``: the rows that take part, with integer components."""
    largest = 1 << ((62 - math.ceil(math.log2(max(dims, 1)))) // 2 - 1)
    base = vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"))
    kept = base.where(is_finite(F.col("v")) & (F.size("v") == dims))
    return kept.select("vec_id", scaled_integers(F.col("v"), factor, largest).cast("array<int>").alias("x"))


def first_centroids(rows: DataFrame, k: int, seed: str = SEED) -> np.ndarray:
    """The ``k`` rows with the smallest sha256 of ``seed:id``, in the order of the hashes (a top-k report of ``k`` rows)."""
    by = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    first = rows.select("x", by.alias("h")).orderBy(F.asc_nulls_last("h"), "x").limit(k).collect()
    return np.array([r["x"] for r in first], dtype=np.int64)


def _partial_sums(search, dims: int):
    def run(batches):
        orchard = search.value
        total = np.zeros((len(orchard.centroids), dims), dtype=np.int64)
        count = np.zeros(len(orchard.centroids), dtype=np.int64)
        for batch in batches:
            x = matrix(batch.column("x"), dims).astype(np.int64)
            own, _, _ = orchard.nearest(x)
            order = np.argsort(own, kind="stable")
            used, first = np.unique(own[order], return_index=True)
            if len(used):
                total[used] += np.add.reduceat(x[order], first, axis=0)
                count += np.bincount(own, minlength=len(count))
        if count.any():
            yield keyed(np.column_stack([total, count]), pa.int64())

    return run


def refine(rows: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """One round: every non-empty centroid becomes the floor of the exact mean of its vectors."""
    dims = centroids.shape[1]
    search = rows.sparkSession.sparkContext.broadcast(Orchard(centroids))  # k centroids and k lists, k bounded
    try:
        parts = rows.select("x").mapInArrow(_partial_sums(search, dims), "key int, v array<long>")
        sums = sum_by_key(parts, exact=True)
    finally:
        search.unpersist()
    out = centroids.copy()
    for cluster, (*total, n) in sums.items():
        if n:
            out[cluster] = [s // n for s in total]
    return out


def assign(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``vec_id, cluster, distance`` for every row."""
    dims, kind = centroids.shape[1], rows.schema["vec_id"].dataType.simpleString()
    search = rows.sparkSession.sparkContext.broadcast(Orchard(centroids))

    def run(batches):
        for batch in batches:
            own, d, _ = search.value.nearest(matrix(batch.column("x"), dims).astype(np.int64))
            yield pa.RecordBatch.from_pydict({"vec_id": batch.column("vec_id"), "cluster": pa.array(own, pa.int32()), "distance": pa.array(d, pa.int64())})

    return rows.select("vec_id", "x").mapInArrow(run, f"vec_id {kind}, cluster int, distance long")


def cluster_vectors(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, seed: str = SEED, vec_id: str = "vec_id",
                    embedding: str = "embedding", dims: int = DIMS, factor: int = FACTOR) -> tuple[DataFrame, np.ndarray]:
    """``vec_id, cluster, distance`` for every vector that takes part, and the final integer centroids."""
    if not 1 <= k <= MAX_CLUSTERS:
        raise ValueError(f"k must be from 1 to {MAX_CLUSTERS}")
    rows = materialize(integer_vectors(vectors, vec_id, embedding, dims, factor), "orchard-vectors")
    centroids = first_centroids(rows, k, seed)
    if not len(centroids):
        return rows.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), np.zeros((0, dims), dtype=np.int64)
    for _ in range(rounds):
        moved = refine(rows, centroids)
        if (moved == centroids).all():
            break  # every further round would give the same centroids
        centroids = moved
    return materialize(assign(rows, centroids), "orchard-clusters"), centroids


def op11_orchard_clusters(vectors: DataFrame) -> DataFrame:
    spark = vectors.sparkSession
    assigned, centroids = cluster_vectors(vectors.select("vec_id", "embedding"))
    inertia = {r["cluster"]: r["s"] for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).cast("long").alias("s")).collect()}
    digest = [hashlib.sha256(",".join(str(int(c)) for c in row).encode()).hexdigest() for row in centroids]
    facts = spark.createDataFrame([(i, int(inertia.get(i, 0)), int(sum(inertia.values())), d) for i, d in enumerate(digest)],
                                  "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")  # a row a centroid
    return assigned.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")

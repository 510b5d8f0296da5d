"""Embedding whitening by shifted CholeskyQR.

With ``A`` the centred rows (a row a vector), ``A = Q R`` gives the covariance ``R'R / n``; the right singular
vectors of the small ``R`` are the components and its squared singular values, over ``n``, their eigenvalues.

``R`` is found in passes over the rows.  A pass computes the Gram matrix of ``A R^-1``: each task solves
its rows against the triangular ``R`` (by columns) and sums outer products, one aggregate adds the tasks'
matrices, and the driver, which only sees that small matrix, takes its Cholesky factor and multiplies it
onto ``R``.  The first pass adds a shift of rounding size to the diagonal so that the factor exists for any
condition number; the later passes bring ``Q`` back to orthogonal columns.  Passes end when the Gram
matrix is a projector (the identity if all dimensions vary), and its square root becomes the last factor.

Rows are integers; they are centred exactly (``n x - S``) before anything is multiplied, so no
digits are lost to a large mean.

Defined cases: rows whose vector is null, empty, or holds null or non-finite entries are dropped, and so are
rows of another length than the commonest (of two, the smaller), since one covariance needs one length; ids
may be null or repeat, each row is a vector of its own; components whose singular value is below ``RANK``
times the largest are no directions of the data (constant or dependent dimensions, or fewer rows) and are left out,
so one row, or equal rows only, give no result rows; of equal eigenvalues any orthonormal basis serves; a component's largest entry
is positive (of entries equal in size, the first); an empty table gives no rows; a component whose integer is beyond ``2^53``
raises an error; a ``deviation`` that does not fit 64 bits is null in the query.  Columns other than the id and the vector
are not read, so their names cannot clash.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialize
from tessera.llm.vectors import is_finite, lists, matrix, keyed, scaled_integers, sum_by_key

FACTOR, OFFSET, COMPONENTS = 64, 1_000_000, 32
RANK, PASSES, BLOCK = 1e-10, 12, 4096
EPS = float(np.finfo(np.float64).eps)


@dataclass
class Fit:
    """``n`` rows with exact sums; ``directions`` (a row a component) with eigenvalues and the share of all variance."""

    n: int
    sums: list[int]
    directions: np.ndarray
    eigenvalues: np.ndarray
    explained: np.ndarray
    passes: int


def integer_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", factor: int = FACTOR, offset: int = OFFSET) -> DataFrame:
    """``vec_id, x``: the rows that take part, with entries ``floor(factor * c) + offset``."""
    base = vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"))
    kept = base.where(is_finite(F.col("v")) & (F.size("v") > 0))
    common = kept.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    if common is not None:
        kept = kept.where(F.size("v") == common["d"])
    x = F.transform(scaled_integers(F.col("v"), factor, 1 << 53), lambda y: y + F.lit(offset))
    return kept.select("vec_id", x.alias("x"))


def scaled_deviation(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """``n * x - S``, exact: 64-bit integers, or Python integers where those would not do."""
    mean = [s // n for s in sums]
    rest = [s - n * m for s, m in zip(sums, mean)]  # 0 .. n - 1
    near = x - np.array(mean, dtype=np.int64)
    if len(near) and n * (int(np.abs(near).max()) + 1) >= 1 << 62:
        return near.astype(object) * n - np.array(rest, dtype=object)
    return near * n - np.array(rest, dtype=np.int64)


def squared_sum(y: np.ndarray) -> list[int]:
    """The exact sum of squares of each row."""
    if y.dtype != object and (not y.size or int(np.abs(y).max()) < 1 << int((62 - np.ceil(np.log2(y.shape[1]))) // 2)):
        return (y * y).sum(axis=1).tolist()
    return [sum(v * v for v in row) for row in y.tolist()]


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    return scaled_deviation(x, n, sums).astype(np.float64) / n


def solve_right(a: np.ndarray, r: np.ndarray) -> np.ndarray:
    """``a r^-1`` for an upper triangular ``r``, column by column."""
    q = np.empty_like(a)
    for j in range(r.shape[0]):
        q[:, j] = (a[:, j] - q[:, :j] @ r[:j, j]) / r[j, j]
    return q


def _sum_rows(batches):
    total, n = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        x = matrix(batch.column("x"), len(batch.column("x")[0]))
        # Halves of 26 bits: their sums stay exact in 64 bits for any task.
        part = np.stack([(x >> 26).sum(axis=0), (x & ((1 << 26) - 1)).sum(axis=0)])
        total, n = part if total is None else total + part, n + batch.num_rows
    if n:
        yield keyed(np.column_stack([total, [n, 1]]), pa.int64())


def totals(rows: DataFrame) -> tuple[int, list[int], int]:
    """The number of rows, the exact sums a dimension, and the number of tasks that had rows."""
    sums = sum_by_key(rows.select("x").mapInArrow(_sum_rows, "key int, v array<long>"), True)
    if not sums:
        return 0, [], 0
    (*high, n), (*low, tasks) = sums[0], sums[1]
    return n, [(h << 26) + lo for h, lo in zip(high, low)], tasks


def gram(rows: DataFrame, n: int, sums: list[int], change) -> np.ndarray:
    """The Gram matrix of the centred rows after ``change`` (matrix -> matrix), summed block by block, then over tasks."""
    d = len(sums)

    def run(batches):
        total = None
        for batch in batches:
            x = matrix(batch.column("x"), d)
            for at in range(0, len(x), BLOCK):
                q = change(centred(x[at:at + BLOCK], n, sums))
                total = q.T @ q if total is None else total + q.T @ q
        if total is not None:
            yield keyed(total, pa.float64())

    parts = sum_by_key(rows.select("x").mapInArrow(run, "key int, v array<double>"), False)
    g = np.array([parts[i] for i in range(len(parts))])
    return (g + g.T) / 2


def triangular_factor(g: np.ndarray, shift: float) -> np.ndarray:
    """The upper Cholesky factor of ``g``; where it has none, of ``g`` with a growing diagonal shift."""
    top = float(np.trace(g))
    while True:
        try:
            return np.linalg.cholesky(g + shift * np.eye(len(g))).T
        except np.linalg.LinAlgError:
            shift = max(10 * shift, len(g) * EPS * top)


def fit(rows: DataFrame, components: int = COMPONENTS) -> Fit | None:
    """Components of the integer rows ``x``; ``rows`` is read once a pass: pass a written table."""
    n, sums, tasks = totals(rows)
    if not n:
        return None
    d = len(sums)
    none = Fit(n, sums, np.zeros((0, d)), np.zeros(0), np.zeros(0), 1)
    shared = rows.sparkSession.sparkContext.broadcast
    r, passes = np.eye(d), 0
    while True:
        held = shared(r)  # d x d
        first = passes == 0
        g = gram(rows, n, sums, (lambda a: a) if first else (lambda a, held=held: solve_right(a, held.value)))
        held.unpersist()
        passes += 1
        if not np.trace(g) > 0:
            return none
        if not first and np.abs(g @ g - g).max() < 100 * d * EPS or passes >= PASSES:
            break
        # The rounding bound of a sum over a block, then blocks and tasks; 1/100 of the norm keeps the passes converging.
        terms = min(n, BLOCK) + -(-n // BLOCK) // max(tasks, 1) + tasks
        shift = min(11 * (d * terms + d * (d + 1)) * EPS / 2, 0.01) * float(np.linalg.norm(g, 2)) if first else 0.0
        r = triangular_factor(g, shift) @ r
    own, turn = np.linalg.eigh(g)
    half = (turn * np.sqrt(np.clip(own, 0, None))) @ turn.T
    _, sing, right = np.linalg.svd(half @ r)
    eig = sing ** 2 / n
    keep = min(components, int((sing > RANK * sing[0]).sum()))
    right = right[:keep]
    biggest = np.abs(right).argmax(axis=1)
    right = right * np.sign(right[np.arange(keep), biggest])[:, None]
    return Fit(n, sums, right, eig[:keep], eig[:keep] / eig.sum(), passes)


def whiten(rows: DataFrame, model: Fit) -> DataFrame:
    """``vec_id, deviation decimal(38,0), whitened array<double>``: a row's exact scaled squared distance from the mean, and its whitened components."""
    n, sums, kind = model.n, model.sums, rows.schema["vec_id"].dataType.simpleString()
    turn = rows.sparkSession.sparkContext.broadcast((model.directions / np.sqrt(model.eigenvalues)[:, None]).T)  # d x components

    def run(batches):
        for batch in batches:
            x = matrix(batch.column("x"), len(sums))
            for at in range(0, len(x), BLOCK):
                y = scaled_deviation(x[at:at + BLOCK], n, sums)
                yield pa.RecordBatch.from_pydict({
                    "vec_id": batch.column("vec_id").slice(at, len(y)), "deviation": pa.array([str(s) for s in squared_sum(y)], pa.string()),
                    "whitened": lists((y.astype(np.float64) / n) @ turn.value, pa.float64())})

    out = rows.select("vec_id", "x").mapInArrow(run, f"vec_id {kind}, deviation string, whitened array<double>")
    return out.withColumn("deviation", F.col("deviation").cast("decimal(38,0)"))


def identity_error(rows: DataFrame, model: Fit) -> float:
    """The largest absolute entry of the whitened rows' covariance minus the identity (centred rows have mean zero)."""
    turn = rows.sparkSession.sparkContext.broadcast((model.directions / np.sqrt(model.eigenvalues)[:, None]).T)
    return float(np.abs(gram(rows, model.n, model.sums, lambda a: a @ turn.value) / model.n - np.eye(len(model.eigenvalues))).max())


def op12_whitening_qr(vectors: DataFrame) -> DataFrame:
    spark = vectors.sparkSession
    rows = materialize(integer_vectors(vectors.select("vec_id", "embedding")), "whitening-vectors")
    model = fit(rows)
    if model is None or not len(model.eigenvalues):
        return spark.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    explained = F.array(*[F.lit(float(e)) for e in model.explained])
    each = whiten(rows, model).select("vec_id", F.expr("try_cast(deviation AS long)").alias("deviation"), F.posexplode("whitened").alias("at", "whitened"))
    return each.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
                       F.get(explained, F.col("at")).alias("explained"), F.lit(identity_error(rows, model)).alias("identity_error"))

"""Helpers for columns of vectors: which rows take part, Arrow batches as matrices, exact sums by key."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def is_finite(v):
    """True for an array column that is not null and has no null, NaN or infinite component."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(v.isNotNull() & ~F.coalesce(bad, F.lit(True)), F.lit(False))


def scaled_integers(v, factor: int, largest: int):
    """``floor(factor * x)`` of each component (a double) as a long; an error if it is beyond ``largest``."""

    def one(x):
        y = F.floor(F.lit(float(factor)) * x)
        return F.when(F.abs(F.lit(float(factor)) * x) <= F.lit(float(largest)), y).otherwise(
            F.raise_error(F.concat(F.lit("component too large for exact 64-bit arithmetic: "), x.cast("string"))).cast("long"))

    return F.transform(v.cast("array<double>"), one)


def matrix(column, dims: int) -> np.ndarray:
    """An Arrow list column (no nulls, ``dims`` numbers a row) as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def lists(values: np.ndarray, kind) -> pa.Array:
    """A matrix as an Arrow list column."""
    rows, dims = values.shape
    offsets = pa.array(np.arange(rows + 1, dtype=np.int32) * dims)
    return pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(values).reshape(-1), type=kind))


def keyed(values: np.ndarray, kind) -> pa.RecordBatch:
    """The rows of a matrix as a batch ``key int, v array``; the key is the row's number."""
    return pa.RecordBatch.from_pydict({"key": pa.array(np.arange(len(values)), pa.int32()), "v": lists(values, kind)})


def sum_by_key(parts: DataFrame, exact: bool) -> dict[int, list]:
    """``key -> sum of its vectors`` for parts ``key, v`` as ``keyed`` gives them, one set a task.

    One map-side combined aggregate; the result has a row for each key and position, whatever the
    input.  ``exact`` sums integers as decimals (Python integers come back).
    """
    kind = "decimal(38,0)" if exact else "double"
    cells = parts.select("key", F.posexplode("v").alias("at", "x"))
    out: dict[int, list] = {}
    for r in sorted(cells.groupBy("key", "at").agg(F.sum(F.col("x").cast(kind)).alias("x")).collect()):
        out.setdefault(r["key"], []).append(int(r["x"]) if exact else r["x"])
    return out

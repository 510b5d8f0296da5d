"""Running sums over a globally ordered DataFrame without a one-task window.

``Window.orderBy(x)`` with no partition moves every row to one task.  Here
rows are split into value ranges, as many as Spark shuffles to at any size
(``percentile_approx`` cut points, so the split survives task retries); one aggregate gives each
range's totals (-> offsets) and its first row; then every range (bounded
size) is sorted and summed with numpy inside its own task
(``applyInPandas``), adding its offset.  Spark's window operator is avoided
on purpose: it buffers a whole group through a small in-memory threshold
and is several times slower than a numpy cumulative sum on the same group.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def running_sums(df: DataFrame, order_col: str, sum_cols: list[str], descending: bool = False,
                 ranges: int | None = None, tiebreak: list[str] | None = None,
                 with_next: bool = False) -> DataFrame:
    """Add ``cum_<c>`` = sum of ``c`` over all rows up to and including this one,
    ordered by the numeric ``order_col`` then ``tiebreak`` (together unique).
    Ranges are cut on ``order_col`` only, so ties never straddle two ranges.
    ``with_next`` also adds ``next_<c>``: c on the following row (NULL on the last)."""
    tiebreak = list(tiebreak or [])
    parts = ranges or max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    key = (-F.col(order_col) if descending else F.col(order_col)).cast("double")
    keyed = df.withColumn("_key", key)
    cuts = keyed.agg(F.percentile_approx("_key", [i / parts for i in range(1, parts)] or [0.5], max(1000, 20 * parts)).alias("c")).collect()[0]["c"]
    inf = float("inf")
    # MLlib's Bucketizer: a binary search in the JVM.  The cut itself begins the next range.
    inner = sorted({float(c) for c in (cuts or []) if abs(c) != inf}) if parts > 1 else []
    ranged = Bucketizer(splits=[-inf, *inner, inf], inputCol="_key", outputCol="_rg", handleInvalid="keep").transform(keyed) if inner else (
        keyed.withColumn("_rg", F.lit(0)))
    ranged = ranged.withColumn("_rg", F.col("_rg").cast("int"))
    first = F.min(F.struct(F.col("_key"), *[F.col(t) for t in tiebreak],
                           *[F.col(c).cast("double").alias(f"f_{c}") for c in sum_cols]))
    totals = ranged.groupBy("_rg").agg(*[F.sum(c).alias(c) for c in sum_cols], first.alias("_first")).collect()
    offsets, firsts, acc = {}, {}, {c: 0.0 for c in sum_cols}
    for r in sorted(totals, key=lambda r: r["_rg"]):
        offsets[r["_rg"]] = dict(acc)
        firsts[r["_rg"]] = {c: r["_first"][f"f_{c}"] for c in sum_cols}
        for c in sum_cols:
            acc[c] += float(r[c] or 0)
    filled = sorted(offsets)
    next_first = {rg: firsts[filled[i + 1]] if i + 1 < len(filled) else None for i, rg in enumerate(filled)}

    out_fields = list(df.schema.fields) + [T.StructField(f"cum_{c}", T.DoubleType()) for c in sum_cols]
    if with_next:
        out_fields += [T.StructField(f"next_{c}", T.DoubleType()) for c in sum_cols]
    schema = T.StructType(out_fields)
    cols = df.columns

    def per_range(pdf: pd.DataFrame) -> pd.DataFrame:
        rg = int(pdf["_rg"].iloc[0])
        pdf = pdf.sort_values(["_key", *tiebreak], kind="mergesort")
        out = pdf[cols].copy()
        for c in sum_cols:
            out[f"cum_{c}"] = pdf[c].to_numpy(dtype=float).cumsum() + offsets[rg][c]
        if with_next:
            nf = next_first[rg]
            for c in sum_cols:
                v = pdf[c].to_numpy(dtype=float)
                nxt = np.empty(len(v))
                nxt[:-1] = v[1:]
                nxt[-1] = np.nan if nf is None else nf[c]
                out[f"next_{c}"] = nxt
        return out

    return ranged.groupBy("_rg").applyInPandas(per_range, schema)

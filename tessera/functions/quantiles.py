"""Exact (linear-interpolated) quantiles as a distributed selection.

Spark's exact ``percentile`` keeps every distinct value of a group in one
aggregation buffer; for a global quantile of a 100 TB column that buffer is
one task holding the whole column.  Here the selection is done in bounded
pieces.

Narrowing (:func:`_narrow`) serves almost all columns without an unpivot of rows and columns.  A level is two aggregates over
the wide rows, whatever the number of columns:

1. a sketch a column gives two values around each wanted rank, a few sketch errors away on both sides;
2. the rows below and inside each such interval, and its approximate distinct count, are counted, so that an interval that misses its
   rank is noticed.

Intervals with at most ``BUCKET_VALUES`` distinct values go to the selection: only the rows inside them are read out, as (interval, value,
count); others are narrowed again inside their own range.  Columns whose sketch missed a rank or did not narrow take the steps below.

1. one aggregate per column: the non-missing count and ``percentile_approx``
   cut points (bounded sketch memory), as many as Spark shuffles to;
2. bucket = number of cut points not above the value; bucket sizes and
   approximate distinct counts per bucket (a columns x buckets table);
3. only the buckets holding the wanted ranks are read again, reduced to
   (value, count) pairs (hot values collapse to one row); a running sum inside
   a bucket finds the value at each rank.  A bucket with more than
   ``BUCKET_VALUES`` distinct values is cut again inside its own value range,
   as often as needed.

The interpolation is numpy's "linear" rule (= pandas ``quantile`` =
``percentile`` in Spark = ``quantile_cont`` in DuckDB):
``pos = (n-1) q``, ``v[floor] + (v[ceil] - v[floor]) * (pos - floor)``.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.exprs import nan_to_null, stack_columns

BUCKET_VALUES = 1_000_000   # distinct values of a bucket that one task selects from


def _interp(lo_v: float, hi_v: float, frac: float) -> float:
    if frac == 0.0 or lo_v == hi_v:
        return lo_v
    return lo_v + (hi_v - lo_v) * frac


def _bucketize_wide(df: DataFrame, cols: list[str], cuts: dict[str, list[float]]) -> DataFrame:
    """(g, v, b) rows with b from a binary search over each column's cut points
    (MLlib ``Bucketizer``, JVM-side) applied before the unpivot."""
    from pyspark.ml.feature import Bucketizer
    inf = float("inf")
    vals = df.select(*[nan_to_null(c).alias(f"_v{i}") for i, c in enumerate(cols)])
    # Bucketizer wants one inner cut at least; any will do.
    splits = [[-inf] + ([x for x in cuts.get(c, []) if x not in (-inf, inf)] or [0.0]) + [inf] for c in cols]
    bz = Bucketizer(splitsArray=splits, inputCols=[f"_v{i}" for i in range(len(cols))],
                    outputCols=[f"_b{i}" for i in range(len(cols))], handleInvalid="keep")
    b = bz.transform(vals)
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("g"), F.col(f"_v{i}").alias("v"),
                                         F.col(f"_b{i}").cast("int").alias("b")) for i, c in enumerate(cols)]))
    return b.select(pairs.alias("p")).select("p.g", "p.v", "p.b").where(F.col("v").isNotNull())


def _cuts(long: DataFrame, parts: int):
    """Count and cut points of each group: {g: (n, cuts)}."""
    probs = [i / parts for i in range(1, parts)] or [0.5]
    rows = long.groupBy("g").agg(F.count("*").alias("n"), F.percentile_approx("v", probs, max(1000, 20 * parts)).alias("cuts")).collect()
    return {r["g"]: (r["n"], sorted({float(x) for x in r["cuts"]})) for r in rows}


def _select(long: DataFrame, targets: dict[str, set[int]], cuts: dict[str, list[float]], bucket_values: int, parts: int,
            wide: tuple | None = None) -> dict[tuple[str, int], float]:
    """Values at 0-based ranks: {(group, rank): value}.  ``long`` has columns (g, v);
    ``wide`` = (df, cols) lets the top level bucket the original columns directly."""
    spark = long.sparkSession
    groups = [g for g in targets if targets[g]]
    if not groups:
        return {}
    long = long.where(F.col("g").isin(groups))
    if wide is not None:
        bucketed = _bucketize_wide(wide[0], wide[1], cuts)
    else:
        # refinement levels (rare): interpreted search over the group's cuts (groups x parts numbers)
        cut_df = F.broadcast(spark.createDataFrame([(g, cuts[g]) for g in groups], "g string, cuts array<double>"))
        bucketed = (long.join(cut_df, "g")
                    .select("g", "v", F.size(F.filter("cuts", lambda c: c <= F.col("v"))).alias("b")))
    sizes = {(r["g"], r["b"]): r["n"] for r in bucketed.groupBy("g", "b").agg(F.count("*").alias("n")).collect()}

    # rank -> (bucket, local rank) on the small group x bucket table
    wanted: dict[tuple[str, int], list[tuple[int, int]]] = {}
    for g in groups:
        acc = 0
        for b in sorted(b for (gg, b) in sizes if gg == g):
            for r in targets[g]:
                if acc <= r < acc + sizes[(g, b)]:
                    wanted.setdefault((g, b), []).append((r - acc, r))
            acc += sizes[(g, b)]
    # Only buckets with many rows can have many distinct values; those are counted.
    many = [gb for gb in wanted if sizes[gb] > bucket_values]
    values: dict[tuple[str, int], int] = {}
    if many:
        part = bucketed.join(F.broadcast(spark.createDataFrame(many, "g string, b int")), ["g", "b"])
        values = {(r["g"], r["b"]): r["nd"] for r in part.groupBy("g", "b").agg(F.approx_count_distinct("v").alias("nd")).collect()}
    small, big = [], {}
    for gb, pairs in wanted.items():
        if values.get(gb, 0) > bucket_values:
            big[gb] = set(pairs)
        else:
            small += [(*gb, lr, gr) for lr, gr in pairs]

    found: dict[tuple[str, int], float] = {}
    if small:
        want: dict[tuple[str, int], list[tuple[int, int]]] = {}
        for g, b, lr, gr in set(small):
            want.setdefault((g, b), []).append((lr, gr))
        need = F.broadcast(spark.createDataFrame(list(want), "g string, b int"))   # buckets to read

        def pick(pdf: pd.DataFrame) -> pd.DataFrame:
            # one bucket: its distinct values with counts (bounded); value at each local rank
            pdf = pdf.sort_values("v")
            cum = pdf["cnt"].to_numpy().cumsum()
            key = (pdf["g"].iloc[0], int(pdf["b"].iloc[0]))
            lrs = [lr for lr, _ in want[key]]
            idx = np.searchsorted(cum, np.array(lrs) + 1, side="left")
            return pd.DataFrame({"g": key[0], "b": key[1], "lr": lrs, "v": pdf["v"].to_numpy()[idx]})

        vals = (bucketed.join(need, ["g", "b"])
                .groupBy("g", "b", "v").agg(F.count("*").alias("cnt"))   # hot values collapse to one row
                .groupBy("g", "b").applyInPandas(pick, "g string, b int, lr long, v double"))
        for r in vals.collect():
            for lr, gr in want[(r["g"], r["b"])]:
                if lr == r["lr"]:
                    found[(r["g"], gr)] = r["v"]
    if big:
        # refine oversized buckets inside their own value range: group key g#b
        sub_targets, back = {}, {}
        for (g, b), pairs in big.items():
            key = f"{g}#{b}"
            sub_targets[key] = {lr for lr, _ in pairs}
            for lr, gr in pairs:
                back[(key, lr)] = (g, gr)
        sub = (bucketed.select(F.concat_ws("#", "g", F.col("b").cast("string")).alias("g"), "v")
               .where(F.col("g").isin(list(sub_targets))))
        # Cut points of the distinct values: with three or more some cut lies above the least, so each level splits the bucket.
        sub_cuts = {g: c for g, (_, c) in _cuts(sub.distinct(), max(3, parts)).items()}
        for (key, lr), v in _select(sub, sub_targets, sub_cuts, max(2, bucket_values), max(3, parts)).items():
            found[back[(key, lr)]] = v
    return found


SKETCH = 10_000      # accuracy of the sketch: ranks within n / SKETCH
MARGIN = 4.0 / SKETCH
WHOLE = 20_000       # rows a column's interval keeps whole: fewer ranks than the margin needs


def _narrow(df: DataFrame, ranks: dict[str, set[int]], sizes: dict[str, int], bucket_values: int) -> dict[tuple[str, int], float]:
    """Values at 0-based ranks, {(column, rank): value}, without those of columns that need another way."""
    inf = float("inf")
    cols = list(ranks)
    wide = df.select(*[nan_to_null(c).alias(f"v{i}") for i, c in enumerate(cols)])
    # An interval: (column, least value, largest value, rows below it, rows in it, its ranks).
    open_ = [(i, -inf, inf, 0, sizes[c], sorted(ranks[c])) for i, c in enumerate(cols)]
    closed, lost = [(x, 0) for x in open_ if x[4] <= min(WHOLE, bucket_values)], set()
    open_ = [x for x in open_ if x[4] > min(WHOLE, bucket_values)]

    def within(i, lo, hi):
        v = F.col(f"v{i}")
        test = v.isNotNull()
        if lo != -inf:
            test = test & (v >= F.lit(lo))
        return test if hi == inf else test & (v <= F.lit(hi))

    while open_:
        probs = []
        for _, _, _, below, n, rs in open_:
            at = [((r - below + 0.5) / n) for r in rs]
            probs.append([min(max(p, 0.0), 1.0) for q in at for p in (q - MARGIN, q + MARGIN)])
        row = wide.agg(*[F.percentile_approx(F.when(within(i, lo, hi), F.col(f"v{i}")), probs[k], SKETCH).alias(f"q{k}")
                         for k, (i, lo, hi, *_) in enumerate(open_)]).collect()[0]
        merged = []
        for k, (i, lo, hi, below, n, rs) in enumerate(open_):
            own: list[list] = []
            for j, r in enumerate(rs):       # ranks in rising order: intervals that meet become one
                a = lo if probs[k][2 * j] == 0.0 else float(row[f"q{k}"][2 * j])
                b = hi if probs[k][2 * j + 1] == 1.0 else float(row[f"q{k}"][2 * j + 1])
                if own and a <= own[-1][1]:
                    own[-1][1] = max(own[-1][1], b)
                    own[-1][2].append(r)
                else:
                    own.append([a, b, [r]])
            merged += [(i, a, b, part, n) for a, b, part in own]
        aggs = []
        for k, (i, a, b, _, _) in enumerate(merged):
            aggs += [F.count(F.when(F.col(f"v{i}") < F.lit(a), 1)).alias(f"l{k}"), F.count(F.when(within(i, a, b), 1)).alias(f"n{k}"),
                     F.approx_count_distinct(F.when(within(i, a, b), F.col(f"v{i}"))).alias(f"u{k}")]
        row, open_ = wide.agg(*aggs).collect()[0], []
        for k, (i, a, b, rs, before) in enumerate(merged):
            below, n = row[f"l{k}"], row[f"n{k}"]
            if not all(below <= r < below + n for r in rs):
                lost.add(i)
            elif row[f"u{k}"] <= bucket_values:
                closed.append(((i, a, b, below, n, rs), below))
            elif n > before // 2:
                lost.add(i)
            else:
                open_.append((i, a, b, below, n, rs))

    chosen = [x for x, _ in closed if x[0] not in lost]
    if not chosen:
        return {}
    pairs = F.array(*[F.when(within(i, a, b), F.struct(F.lit(k).alias("k"), F.col(f"v{i}").alias("v"))) for k, (i, a, b, *_) in enumerate(chosen)])
    values = (wide.select(F.explode(F.array_compact(pairs)).alias("p")).groupBy("p.k", "p.v").agg(F.count("*").alias("cnt"))
              .select("k", "v", "cnt"))
    ranked = [[r - below for r in rs] for _, _, _, below, _, rs in chosen]

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        # one interval: its distinct values with counts (bounded); value at each local rank
        pdf = pdf.sort_values("v")
        k = int(pdf["k"].iloc[0])
        at = np.searchsorted(pdf["cnt"].to_numpy().cumsum(), np.array(ranked[k]) + 1, side="left")
        return pd.DataFrame({"k": k, "r": ranked[k], "v": pdf["v"].to_numpy()[at]})

    found = {}
    for r in values.groupBy("k").applyInPandas(pick, "k int, r long, v double").collect():   # a row a wanted rank
        i, _, _, below, _, _ = chosen[r["k"]]
        found[(cols[i], r["r"] + below)] = r["v"]
    return found


def exact_quantiles(df: DataFrame, cols: list[str], probs: list[float], bucket_values: int = BUCKET_VALUES,
                    counts: dict[str, int] | None = None, parts: int | None = None) -> dict[str, list[float | None]]:
    """{col: [quantile at each prob]} with missing (NULL/NaN/inf) values ignored.

    The same plan at every size: counts (``counts`` where the caller knows them), narrowing, selection.
    """
    if not cols:
        return {}
    counts = dict(counts or {})
    unknown = [c for c in cols if c not in counts]
    if unknown:
        row = df.agg(*[F.count(nan_to_null(c)).alias(f"n{i}") for i, c in enumerate(unknown)]).collect()[0]
        counts.update({c: row[f"n{i}"] for i, c in enumerate(unknown)})
    plan: dict[str, list[tuple[int, int, float] | None]] = {}
    targets: dict[str, set[int]] = {}
    for c in cols:
        n = counts[c]
        if n == 0:
            plan[c] = [None] * len(probs)
            continue
        entries = []
        for q in probs:
            pos = (n - 1) * float(q)
            lo, hi = int(math.floor(pos)), int(math.ceil(pos))
            entries.append((lo, hi, pos - lo))
            targets.setdefault(c, set()).update({lo, hi})
        plan[c] = entries
    found = _narrow(df, targets, counts, bucket_values) if targets else {}
    rest = [c for c in targets if any((c, r) not in found for r in targets[c])]
    if rest:
        found.update(_by_buckets(df, {c: targets[c] for c in rest}, bucket_values, parts))
    out: dict[str, list[float | None]] = {}
    for c in cols:
        out[c] = [None if e is None else _interp(found[(c, e[0])], found[(c, e[1])], e[2]) for e in plan[c]]
    return out


def _by_buckets(df: DataFrame, targets: dict[str, set[int]], bucket_values: int, parts: int | None) -> dict[tuple[str, int], float]:
    """Values at 0-based ranks by cut points, bucket sizes and a selection in the wanted buckets."""
    cols = list(targets)
    parts = parts or max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    qs, accuracy = [i / parts for i in range(1, parts)] or [0.5], max(1000, 20 * parts)
    row = df.agg(*[F.percentile_approx(nan_to_null(c), qs, accuracy).alias(f"c{i}") for i, c in enumerate(cols)]).collect()[0]
    cuts = {c: sorted({float(x) for x in row[f"c{i}"] or []}) if parts > 1 else [] for i, c in enumerate(cols)}
    return _select(stack_columns(df, cols, name_col="g"), targets, cuts, bucket_values, parts, wide=(df, cols))


def approx_quantiles(df: DataFrame, cols: list[str], probs: list[float],
                     accuracy: int = 10_000) -> dict[str, list[float | None]]:
    """One-pass sketch (``percentile_approx``); rank error <= n / accuracy."""
    if not cols:
        return {}
    long = stack_columns(df, cols)
    rows = long.groupBy("name").agg(F.percentile_approx("v", list(probs), accuracy).alias("q")).collect()
    got = {r["name"]: [float(x) for x in r["q"]] for r in rows}
    return {c: got.get(c, [None] * len(probs)) for c in cols}


def quantiles(df: DataFrame, cols: list[str], probs: list[float], exact: bool = True,
              accuracy: int = 10_000, counts: dict[str, int] | None = None) -> dict[str, list[float | None]]:
    if exact:
        return exact_quantiles(df, cols, probs, counts=counts)
    return approx_quantiles(df, cols, probs, accuracy)

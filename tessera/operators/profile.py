"""Profiling: semantic types (AutoType) and per-column summaries.

One wide aggregate gives every column's counts, missing values, min, max, mean
and the folded min/max used by the boolean test.  Distinct counts (and the mode
of text, ties -> smallest) come from one small sub-plan a column, which reads
only that column in its own type and combines map-side; the sub-plans are one
job.  Quantiles (median, IQR) use the bounded exact selection of
:mod:`tessera.functions.quantiles`.  The driver only sees one row per column.
"""

from __future__ import annotations

import datetime as _dt
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.exprs import (BOOL_LIKE_PAIRS, CATEGORICAL_MAX_DISTINCT, FRACTIONAL_TYPES,
                                     INTEGRAL_TYPES, NUMERIC_TYPES, TIME_TYPES, fold,
                                     pandas_dtype_name, present)
from tessera.functions.quantiles import quantiles

NUMERIC_AUTOTYPES = ("Continuous", "Categorical", "Binary")
STRING_AUTOTYPES = ("Boolean", "Binary", "Categorical", "Descriptive")


# ---------------------------------------------------------------------------
# facts
# ---------------------------------------------------------------------------
def column_facts(df: DataFrame, cols: list[str] | None = None, approx: bool = False) -> dict[str, dict]:
    """{col: facts} from a wide aggregate and a distinct count for each column (see module doc).

    ``approx=True`` replaces the exact distinct count by HyperLogLog++
    (``approx_count_distinct``), which needs no shuffle of distinct values;
    the mode is then not computed.
    """
    cols = list(cols or df.columns)
    if not cols:
        return {}
    if approx:
        return _approx_facts(df, cols)
    # One wide aggregate over the scan for what needs no distinct values ...
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, c in enumerate(cols):
        p = present(df, c)
        aggs.append(F.count(F.when(p, 1)).alias(f"p{i}"))
        if isinstance(df.schema[c].dataType, NUMERIC_TYPES):
            num = F.when(p, F.col(c).cast("double"))
            aggs += [F.min(num).alias(f"dmin{i}"), F.max(num).alias(f"dmax{i}"), F.avg(num).alias(f"dmean{i}")]
        else:
            text = F.when(p, F.col(c).cast("string"))
            aggs += [F.min(text).alias(f"smin{i}"), F.max(text).alias(f"smax{i}"), F.min(fold(text)).alias(f"fmin{i}"), F.max(fold(text)).alias(f"fmax{i}")]
    wide = df.agg(*aggs).collect()[0].asDict()
    if not wide["n"]:
        return {c: _finish(df, c, None) for c in cols}

    # ... and for each column its distinct values in their own type, counted apart (no row x column explode);
    # the sub-plans are one job, each reads one column and combines map-side.
    def distinct(i, c):
        part = df.where(present(df, c)).select(F.col(c).alias("v"))
        if isinstance(df.schema[c].dataType, NUMERIC_TYPES):
            return part.distinct().agg(F.lit(i).alias("i"), F.count("*").alias("n_unique"), F.lit(None).cast("string").alias("mode"))
        values = part.groupBy("v").agg(F.count("*").alias("cnt"))
        mode = F.min(F.struct((-F.col("cnt")).alias("k"), F.col("v").cast("string").alias("v")))["v"]
        return values.agg(F.lit(i).alias("i"), F.count("*").alias("n_unique"), mode.alias("mode"))

    parts = [distinct(i, c) for i, c in enumerate(cols)]
    whole = parts[0]
    for x in parts[1:]:
        whole = whole.unionByName(x)
    found = {r["i"]: r for r in whole.collect()}
    out = {}
    for i, c in enumerate(cols):
        row = {"n_rows": wide["n"], "n_present": wide[f"p{i}"], "n_unique": found[i]["n_unique"], "mode": found[i]["mode"]}
        row |= {k: wide.get(f"{k}{i}") for k in ("fmin", "fmax", "dmin", "dmax", "dmean", "smin", "smax")}
        out[c] = _finish(df, c, row)
    return out


def _approx_facts(df: DataFrame, cols: list[str]) -> dict[str, dict]:
    aggs = [F.count(F.lit(1)).alias("__n")]
    for i, c in enumerate(cols):
        p = present(df, c)
        aggs += [F.sum(p.cast("int")).alias(f"p{i}"),
                 F.approx_count_distinct(F.when(p, F.col(c))).alias(f"u{i}"),
                 F.min(F.when(p, fold(c))).alias(f"fa{i}"), F.max(F.when(p, fold(c))).alias(f"fb{i}")]
        if isinstance(df.schema[c].dataType, NUMERIC_TYPES):
            d = F.when(p, F.col(c).cast("double"))
            aggs += [F.min(d).alias(f"mi{i}"), F.max(d).alias(f"ma{i}"), F.avg(d).alias(f"me{i}")]
        elif isinstance(df.schema[c].dataType, TIME_TYPES):
            aggs += [F.min(c).cast("string").alias(f"si{i}"), F.max(c).cast("string").alias(f"sa{i}")]
    r = df.agg(*aggs).collect()[0].asDict()
    out = {}
    for i, c in enumerate(cols):
        raw = {"n_rows": r["__n"], "n_present": r[f"p{i}"] or 0, "n_unique": r[f"u{i}"], "mode": None,
               "fmin": r[f"fa{i}"], "fmax": r[f"fb{i}"], "dmin": r.get(f"mi{i}"), "dmax": r.get(f"ma{i}"),
               "dmean": r.get(f"me{i}"), "smin": r.get(f"si{i}"), "smax": r.get(f"sa{i}")}
        out[c] = _finish(df, c, raw)
    return out


def _finish(df: DataFrame, c: str, raw: dict | None) -> dict:
    dt = df.schema[c].dataType
    raw = dict(raw or {"n_rows": 0, "n_present": 0, "n_unique": 0})
    n_rows, n_present = raw.get("n_rows") or 0, raw.get("n_present") or 0
    raw["n_rows"], raw["n_present"] = n_rows, n_present
    raw["n_missing"] = n_rows - n_present
    raw["dtype"] = pandas_dtype_name(dt, has_null=raw["n_missing"] > 0)
    raw["autotype"] = autotype_rule(dt, raw["n_unique"] or 0, raw["n_missing"] > 0,
                                    raw.get("fmin"), raw.get("fmax"))
    raw["pct_missing"] = round(100.0 * raw["n_missing"] / n_rows, 2) if n_rows else None
    return raw


def autotype_rule(dt: T.DataType, n_unique: int, has_null: bool, fmin: str | None, fmax: str | None,
                  strict_pandas: bool = True) -> str:
    """The semantic type rule.

    ``strict_pandas``: an integral column with a missing value would be
    float64 after a CSV read, hence Continuous.
    """
    if isinstance(dt, FRACTIONAL_TYPES):
        return "Continuous"
    if isinstance(dt, INTEGRAL_TYPES):
        if has_null and strict_pandas:
            return "Continuous"
        if n_unique == 2:
            return "Binary"
        if 2 < n_unique <= CATEGORICAL_MAX_DISTINCT:
            return "Categorical"
        return "Continuous"
    if isinstance(dt, T.StringType):
        if n_unique == 0:
            return "Empty"
        if n_unique == 2:
            return "Boolean" if bool_pair(fmin, fmax) else "Binary"
        if n_unique > CATEGORICAL_MAX_DISTINCT:
            return "Descriptive"
        return "Categorical"
    if isinstance(dt, TIME_TYPES):
        return "Datetime"
    if isinstance(dt, T.BooleanType):
        return "Boolean"
    return dt.typeName().capitalize()


def bool_pair(fmin: str | None, fmax: str | None) -> bool:
    """Two distinct folded values forming exactly one known boolean pair."""
    if fmin is None or fmax is None or fmin == fmax:
        return False
    return any({fmin, fmax} == set(p) for p in BOOL_LIKE_PAIRS)


# ---------------------------------------------------------------------------
# P1, P2
# ---------------------------------------------------------------------------
def autotypes(df: DataFrame, approx: bool = False) -> dict[str, str]:
    return {c: f["autotype"] for c, f in column_facts(df, approx=approx).items()}


def infer_autotype(df: DataFrame, approx: bool = False) -> DataFrame:
    """One row per column: variable, dtype, autotype, n_unique."""
    facts = column_facts(df, approx=approx)
    rows = [(c, f["dtype"], f["autotype"], int(f["n_unique"] or 0)) for c, f in facts.items()]
    return df.sparkSession.createDataFrame(rows, "variable string, dtype string, autotype string, n_unique long")


def is_bool_like_expr_df(df: DataFrame, col: str) -> DataFrame:
    """P2 as a one-row DataFrame computed lazily: variable, is_bool_like."""
    f = F.when(F.col(col).isNotNull(), fold(col))
    agg = df.agg(F.count_distinct(f).alias("k"), F.min(f).alias("a"), F.max(f).alias("b"))
    cond = F.lit(False)
    for x, y in BOOL_LIKE_PAIRS:
        lo, hi = min(x, y), max(x, y)
        cond = cond | ((F.col("a") == lo) & (F.col("b") == hi))
    return agg.select(F.lit(col).alias("variable"),
                      ((F.col("k") == 2) & F.coalesce(cond, F.lit(False))).alias("is_bool_like"))


def is_bool_like(df: DataFrame, col: str) -> bool:
    return bool(is_bool_like_expr_df(df, col).collect()[0]["is_bool_like"])


# ---------------------------------------------------------------------------
# P7, P8
# ---------------------------------------------------------------------------
def missing_percent(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Variable, pct_missing (100 * missing / rows, 2 decimals); one aggregate, lazy."""
    cols = list(cols or df.columns)
    agg = df.agg(*[F.avg((~present(df, c)).cast("double")).alias(f"m{i}") for i, c in enumerate(cols)])
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("variable"),
                                         F.round(F.col(f"m{i}") * 100.0, 2).alias("pct_missing"))
                                for i, c in enumerate(cols)]))
    return agg.select(pairs.alias("p")).select("p.variable", "p.pct_missing")


def iqr_bounds(df: DataFrame, col: str, k: float = 1.5, exact: bool = True) -> tuple[float, float] | None:
    q1, q3 = quantiles(df, [col], [0.25, 0.75], exact=exact)[col]
    if q1 is None:
        return None
    iqr = q3 - q1
    return q1 - k * iqr, q3 + k * iqr


def outlier_percents(df: DataFrame, cols: list[str], k: float = 1.5, exact: bool = True,
                     qs: dict | None = None) -> dict[str, float | None]:
    """P8 for several columns: one quantile selection + one conditional-count aggregate.

    ``qs`` may carry precomputed {col: [q1, q3]}.
    """
    if not cols:
        return {}
    qs = qs or quantiles(df, cols, [0.25, 0.75], exact=exact)
    aggs, live = [], []
    for i, c in enumerate(cols):
        q1, q3 = qs[c]
        if q1 is None:
            continue
        lo, hi = q1 - k * (q3 - q1), q3 + k * (q3 - q1)
        x = F.col(c).cast("double")
        p = present(df, c)
        aggs += [F.sum(F.when(p & ((x < lo) | (x > hi)), 1).otherwise(0)).alias(f"o{i}"),
                 F.sum(F.when(p, 1).otherwise(0)).alias(f"n{i}")]
        live.append((i, c))
    out = {c: None for c in cols}
    if aggs:
        r = df.agg(*aggs).collect()[0]
        for i, c in live:
            n = r[f"n{i}"]
            out[c] = round(100.0 * r[f"o{i}"] / n, 2) if n else None
    return out


def iqr_outlier_percent(df: DataFrame, col: str, k: float = 1.5, exact: bool = True) -> float | None:
    return outlier_percents(df, [col], k, exact)[col]


# ---------------------------------------------------------------------------
# P9
# ---------------------------------------------------------------------------
# Date patterns tried in order on the first non-missing value.
DATE_PATTERNS = [
    (r"^\d{4}-\d{2}-\d{2}$", "YYYY-MM-DD"),
    (r"^\d{8}$", "YYYYMMDD"),
    (r"^\d{2}/\d{2}/\d{4}$", "DD/MM/YYYY"),
    (r"^\d{4}/\d{2}/\d{2}$", "YYYY/MM/DD"),
    (r"^\d{2}-\d{2}-\d{4}$", "DD-MM-YYYY"),
    (r"^\d{4}\.\d{2}\.\d{2}$", "YYYY.MM.DD"),
    (r"^\d{2}\.\d{2}\.\d{4}$", "DD.MM.YYYY"),
]


def datetime_format_expr(sample) -> F.Column:
    """Format name of one sample value (a string or timestamp column expression)."""
    s = sample.cast("string")
    out = None
    for rx, name in DATE_PATTERNS:
        out = F.when(s.rlike(rx), F.lit(name)) if out is None else out.when(s.rlike(rx), F.lit(name))
    parsed = F.coalesce(F.try_to_timestamp(s), F.try_to_timestamp(s, F.lit("yyyy-MM-dd HH:mm:ss")))
    return (out.when(sample.isNull(), F.lit(""))
            .when(parsed.isNotNull(), F.date_format(parsed, "yyyy-MM-dd HH:mm:ss"))
            .otherwise(F.lit("Unknown")))


def infer_datetime_format(df: DataFrame, col: str, order_by: list[str]) -> DataFrame:
    """Variable, format_guess from the first (by ``order_by``) non-missing value. Lazy, one aggregate."""
    first = df.where(F.col(col).isNotNull()).agg(
        F.min(F.struct(*[F.col(o) for o in order_by], F.col(col).alias("__v")))["__v"].alias("s"))
    return first.select(F.lit(col).alias("variable"), datetime_format_expr(F.col("s")).alias("format_guess"))


# ---------------------------------------------------------------------------
# P3-P6
# ---------------------------------------------------------------------------
NUMERIC_SCHEMA = ("variable string, dtype string, autotype string, min double, max double, mean double, "
                  "median double, pct_missing double, n_unique long, pct_outliers double")
STRING_SCHEMA = "variable string, dtype string, autotype string, n_unique long, most_frequent string, pct_missing double"
DATETIME_SCHEMA = ("variable string, dtype string, autotype string, format_guess string, min_time timestamp_ntz, "
                   "max_time timestamp_ntz, pct_missing double, n_unique long")


def _numeric_cols(df, facts):
    return [c for c, f in facts.items()
            if f["autotype"] in NUMERIC_AUTOTYPES and isinstance(df.schema[c].dataType, NUMERIC_TYPES)]


def _string_cols(df, facts):
    return [c for c, f in facts.items()
            if f["autotype"] in STRING_AUTOTYPES and isinstance(df.schema[c].dataType, (T.StringType, T.BooleanType))]


def _datetime_cols(df, facts):
    return [c for c, f in facts.items() if f["autotype"] == "Datetime"]


def numeric_summary(df: DataFrame, facts: dict | None = None, exact: bool = True) -> DataFrame:
    """Variable, dtype, autotype, min, max, mean, median, pct_missing, n_unique, pct_outliers."""
    facts = facts or column_facts(df)
    cols = _numeric_cols(df, facts)
    # present counts from the facts equal the quantile input when no +-inf is present
    known = {c: facts[c]["n_present"] for c in cols
             if facts[c].get("dmin") is not None and math.isfinite(facts[c]["dmin"]) and math.isfinite(facts[c]["dmax"])}
    qs = quantiles(df, cols, [0.25, 0.5, 0.75], exact=exact, counts=known if len(known) == len(cols) else None) \
        if cols else {}
    cont = [c for c in cols if facts[c]["autotype"] == "Continuous"]
    outl = outlier_percents(df, cont, exact=exact, qs={c: [qs[c][0], qs[c][2]] for c in cont})
    rows = [(c, facts[c]["dtype"], facts[c]["autotype"], facts[c]["dmin"], facts[c]["dmax"], facts[c]["dmean"],
             qs[c][1], facts[c]["pct_missing"], int(facts[c]["n_unique"] or 0), outl.get(c)) for c in cols]
    return df.sparkSession.createDataFrame(rows, NUMERIC_SCHEMA)


def string_summary(df: DataFrame, facts: dict | None = None) -> DataFrame:
    """Variable, dtype, autotype, n_unique, most_frequent (ties -> smallest), pct_missing."""
    facts = facts or column_facts(df)
    rows = [(c, facts[c]["dtype"], facts[c]["autotype"], int(facts[c]["n_unique"] or 0),
             facts[c]["mode"] if facts[c]["mode"] is not None else "", facts[c]["pct_missing"])
            for c in _string_cols(df, facts)]
    return df.sparkSession.createDataFrame(rows, STRING_SCHEMA)


def _ts(s):
    return None if s is None else _dt.datetime.fromisoformat(s)


def datetime_summary(df: DataFrame, order_by: list[str] | None = None, facts: dict | None = None) -> DataFrame:
    """P5: variable, dtype, autotype, format_guess, min_time, max_time, pct_missing, n_unique.

    The format guess looks at the first non-missing value by ``order_by``
    (default: the smallest value, as Spark rows have no order).
    """
    facts = facts or column_facts(df)
    cols = _datetime_cols(df, facts)
    guesses = {}
    if cols:
        aggs = []
        for i, c in enumerate(cols):
            key = [F.col(o) for o in (order_by or [])] + [F.col(c).alias("__v")]
            aggs.append(F.min(F.when(F.col(c).isNotNull(), F.struct(*key)))["__v"].alias(f"s{i}"))
        first = df.agg(*aggs)
        r = first.select(*[datetime_format_expr(F.col(f"s{i}")).alias(f"g{i}") for i in range(len(cols))]).collect()[0]
        guesses = {c: r[f"g{i}"] for i, c in enumerate(cols)}
    rows = [(c, facts[c]["dtype"], "Datetime", guesses.get(c, ""), _ts(facts[c]["smin"]), _ts(facts[c]["smax"]),
             facts[c]["pct_missing"], int(facts[c]["n_unique"] or 0)) for c in cols]
    return df.sparkSession.createDataFrame(rows, DATETIME_SCHEMA)


def profile(df: DataFrame, order_by: list[str] | None = None, exact: bool = True) -> DataFrame:
    """Numeric, string and datetime summaries in one frame (absent fields NULL)."""
    facts = column_facts(df)
    parts = [numeric_summary(df, facts, exact), string_summary(df, facts), datetime_summary(df, order_by, facts)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


# ---------------------------------------------------------------------------
# P10
# ---------------------------------------------------------------------------
def count_duplicates_df(df: DataFrame, subset: list[str] | None = None) -> DataFrame:
    """P10 lazily: one row n_duplicates = rows - distinct groups (NULLs compare equal)."""
    keys = list(subset or df.columns)
    groups = df.groupBy(*keys).agg(F.count("*").alias("c"))
    return groups.agg(F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).cast("long").alias("n_duplicates"))


def count_duplicates(df: DataFrame, subset: list[str] | None = None) -> int:
    return int(count_duplicates_df(df, subset).collect()[0]["n_duplicates"])

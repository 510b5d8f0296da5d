"""Cleaning, imputation, binning, encoding and dates (O, I, B, E, T).

Pattern: a statistics step (one aggregate, a handful of numbers collected)
followed by a projection that uses them as literals, so the final plan is a
single narrow scan + project (whole-stage codegen, no shuffle).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.exprs import nan_to_null, to_binary_expr
from tessera.functions.quantiles import quantiles
from tessera.functions.ranks import with_rank


def _clip(df: DataFrame, col: str, lo: float, hi: float) -> DataFrame:
    x = F.col(col)
    return df.withColumn(col, F.when(x.isNull() | F.isnan(x.cast("double")), x).otherwise(F.least(F.greatest(x, F.lit(lo)), F.lit(hi))))


def cap_iqr(df: DataFrame, col: str, k: float = 1.5, exact: bool = True) -> DataFrame:
    """O1: clip to [Q1 - k IQR, Q3 + k IQR] (k in 0..2.5); missing values (NULL, NaN) stay."""
    if not 0 <= k <= 2.5:
        raise ValueError("k must be within 0..2.5")
    q1, q3 = quantiles(df, [col], [0.25, 0.75], exact=exact)[col]
    if q1 is None:
        return df
    return _clip(df, col, q1 - k * (q3 - q1), q3 + k * (q3 - q1))


def cap_percentile(df: DataFrame, col: str, lo: float = 1, hi: float = 99, exact: bool = True) -> DataFrame:
    """O2: clip to the lo-th and hi-th percentiles (0..100)."""
    a, b = quantiles(df, [col], [lo / 100.0, hi / 100.0], exact=exact)[col]
    if a is None:
        return df
    return _clip(df, col, a, b)


def impute_mean(df: DataFrame, col: str) -> DataFrame:
    """Missing -> mean of the present values (result double, as pandas float64)."""
    m = df.agg(F.avg(nan_to_null(col)).alias("m")).collect()[0]["m"]
    return df.withColumn(col, F.coalesce(nan_to_null(col), F.lit(m).cast("double")))


def impute_median(df: DataFrame, col: str, exact: bool = True) -> DataFrame:
    """Missing -> exact median."""
    m = quantiles(df, [col], [0.5], exact=exact)[col][0]
    return df.withColumn(col, F.coalesce(nan_to_null(col), F.lit(m).cast("double")))


def mode_value(df: DataFrame, col: str):
    """Most frequent present value, ties -> smallest.  groupBy(value) with
    map-side combine, then one global min over (−count, value)."""
    c = F.col(col)
    r = (df.where(c.isNotNull()).groupBy(c.alias("v")).agg(F.count("*").alias("n"))
         .agg(F.min(F.struct((-F.col("n")).alias("k"), F.col("v").alias("v")))["v"].alias("m"))).collect()
    return r[0]["m"] if r else None


def impute_mode(df: DataFrame, col: str) -> DataFrame:
    """I4: missing -> most frequent value (ties -> smallest)."""
    m = mode_value(df, col)
    if m is None:
        return df
    dt = df.schema[col].dataType
    return df.withColumn(col, F.coalesce(F.col(col), F.lit(m).cast(dt)))


def _inner_edge_code(x: Column, inner: list[float]) -> Column:
    """Bin code = number of inner edges strictly below x (right-closed bins)."""
    if not inner:
        return F.when(x.isNotNull(), F.lit(0))
    code = sum((F.when(x > F.lit(float(e)), 1).otherwise(0) for e in inner), F.lit(0))
    return F.when(x.isNotNull(), code)


def quantile_edges(df: DataFrame, col: str, n: int = 4, exact: bool = True) -> list[float]:
    qs = quantiles(df, [col], [i / n for i in range(n + 1)], exact=exact)[col]
    if qs[0] is None:
        return []
    return sorted(set(qs))


def bucketize_quantile(df: DataFrame, col: str, n: int = 4, exact: bool = True) -> DataFrame:
    """B1: quantile bins (qcut), codes 0.., right-closed, lowest included, equal edges merged.

    A column with a single distinct edge gives all NULL.
    """
    edges = quantile_edges(df, col, n, exact)
    x = nan_to_null(col)
    if len(edges) < 2:
        return df.withColumn(col, F.lit(None).cast("long"))
    return df.withColumn(col, _inner_edge_code(x, edges[1:-1]).cast("long"))


def width_edges(mn: float, mx: float, n: int) -> list[float]:
    """Equal-width edges as pandas ``cut`` builds them (low edge moved 0.1 % down;
    a constant column widened by 0.1 % either side)."""
    if mn == mx:
        d = 0.001 * abs(mn) if mn != 0 else 0.001
        return list(np.linspace(mn - d, mx + d, n + 1))
    e = np.linspace(mn, mx, n + 1)
    e[0] -= (mx - mn) * 0.001
    return list(e)


def bucketize_width(df: DataFrame, col: str, n: int = 4) -> DataFrame:
    """B2: equal-width bins (cut), right-closed."""
    x = nan_to_null(col)
    r = df.agg(F.min(x).alias("a"), F.max(x).alias("b")).collect()[0]
    if r["a"] is None:
        return df.withColumn(col, F.lit(None).cast("long"))
    edges = width_edges(float(r["a"]), float(r["b"]), n)
    return df.withColumn(col, _inner_edge_code(x, edges[1:-1]).cast("long"))


def label_codes(df: DataFrame, col: str, order_by: list[str]) -> DataFrame:
    """(value, code): codes 0.. by first appearance of each value (by ``order_by``)."""
    firsts = (df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("value"))
              .agg(F.min(F.struct(*[F.col(o) for o in order_by])).alias("_first")))
    return with_rank(firsts, ["_first", "value"], "code").select("value", "code")


def label_encode(df: DataFrame, col: str, order_by: list[str]) -> DataFrame:
    """Replace values by their first-appearance code; NULLs stay NULL.

    A plain left join: NULL values match nothing, and Spark broadcasts the codes if their size allows it.
    """
    codes = label_codes(df, col, order_by).select(F.col("value").alias("__value"), F.col("code").alias("__code"))
    joined = df.join(codes, df[col] == codes["__value"], "left")
    return joined.select(*[F.col("__code").alias(c) if c == col else df[c] for c in df.columns])


def one_hot(df: DataFrame, col: str, max_values: int = 10_000) -> DataFrame:
    """Drop ``col``, add boolean ``{col}_{value}`` per sorted distinct value; NULL -> all false.

    The result has a column for each value; more than ``max_values`` of them is an error, found before they are all collected.
    """
    vals = sorted(r[0] for r in df.where(F.col(col).isNotNull()).select(col).distinct().limit(max_values + 1).collect())
    if len(vals) > max_values:
        raise ValueError(f"{col} has more than {max_values} distinct values")
    keep = [F.col(c) for c in df.columns if c != col]
    dummies = [F.coalesce(F.col(col) == F.lit(v), F.lit(False)).alias(f"{col}_{v}") for v in vals]
    return df.select(*keep, *dummies)


def to_binary(df: DataFrame, col: str, include_tf: bool = False) -> DataFrame:
    """yes/true/y/1 -> 1, no/false/n/0 -> 0, other -> NULL (t/f only with include_tf)."""
    return df.withColumn(col, to_binary_expr(col, include_tf))


# ---------------------------------------------------------------------------
# Output formats offered for dates (strftime name -> Spark pattern).
DATE_OUTPUT_FORMATS = {
    "%Y-%m-%d": "yyyy-MM-dd",
    "%d/%m/%Y": "dd/MM/yyyy",
    "%m-%d-%Y": "MM-dd-yyyy",
    "%Y/%m/%d": "yyyy/MM/dd",
    "%d-%m-%Y": "dd-MM-yyyy",
    "%Y%m%d": "yyyyMMdd",
}
# Input patterns; of those that read the most values of a column the first is taken, so month before day where both fit.
DATE_INPUT_PATTERNS = ["yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd HH:mm:ssXXX",
                       "yyyy-MM-dd", "yyyy/MM/dd", "yyyyMMdd", "yyyy.MM.dd", "MM/dd/yyyy", "dd/MM/yyyy", "MM-dd-yyyy",
                       "dd-MM-yyyy", "dd.MM.yyyy", "MM/dd/yyyy HH:mm:ss", "dd/MM/yyyy HH:mm:ss", "d MMM yyyy", "d MMMM yyyy",
                       "MMM d, yyyy", "MMMM d, yyyy"]
# ---------------------------------------------------------------------------


def choose_pattern(df: DataFrame, col: str) -> str | None:
    """The one pattern of a string column: the one that reads the most values (one aggregate)."""
    s = F.trim(F.col(col).cast("string"))
    r = df.agg(*[F.count(F.try_to_timestamp(s, F.lit(p))).alias(f"p{i}") for i, p in enumerate(DATE_INPUT_PATTERNS)]).collect()[0]
    best = max(range(len(DATE_INPUT_PATTERNS)), key=lambda i: (r[f"p{i}"], -i))
    return DATE_INPUT_PATTERNS[best] if r[f"p{best}"] else None


def parse_datetime_expr(c: Column, dt: T.DataType, fmt: str | None) -> Column:
    """``fmt``: an offered format or a pattern; None reads nothing from strings."""
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return c.cast("timestamp")
    if fmt is None:
        return F.lit(None).cast("timestamp")
    return F.try_to_timestamp(F.trim(c.cast("string")), F.lit(DATE_OUTPUT_FORMATS.get(fmt, fmt)))


def _pattern(df: DataFrame, col: str, fmt: str | None) -> str | None:
    is_time = isinstance(df.schema[col].dataType, (T.TimestampType, T.TimestampNTZType, T.DateType))
    return fmt if fmt or is_time else choose_pattern(df, col)


def parse_datetime(df: DataFrame, col: str, fmt: str | None = None) -> DataFrame:
    """To timestamp; unparseable -> NULL.  One pattern for the whole column; ``fmt`` pins it."""
    return df.withColumn(col, parse_datetime_expr(F.col(col), df.schema[col].dataType, _pattern(df, col, fmt)))


def format_datetime(df: DataFrame, col: str, fmt: str = "%Y-%m-%d", in_fmt: str | None = None) -> DataFrame:
    """Parse then format to a string in one of the offered formats."""
    if fmt not in DATE_OUTPUT_FORMATS:
        raise ValueError(f"format must be one of {list(DATE_OUTPUT_FORMATS)}")
    parsed = parse_datetime_expr(F.col(col), df.schema[col].dataType, _pattern(df, col, in_fmt))
    return df.withColumn(col, F.date_format(parsed, DATE_OUTPUT_FORMATS[fmt]))

"""Column-expression helpers shared by the operators (all JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference's behaviour)
# ---------------------------------------------------------------------------
# Folded value sets that make a two-valued string column "Boolean".
BOOL_LIKE_PAIRS = [("true", "false"), ("t", "f"), ("yes", "no"), ("y", "n"), ("1", "0")]
# Values mapped to 1 / 0 by the boolean conversion (t and f are not in them).
TRUE_VALUES = ["yes", "true", "y", "1"]
FALSE_VALUES = ["no", "false", "n", "0"]
# Distinct-count limits of the semantic typing.
CATEGORICAL_MAX_DISTINCT = 20
# ---------------------------------------------------------------------------

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
                 T.DoubleType, T.DecimalType)
INTEGRAL_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FRACTIONAL_TYPES = (T.FloatType, T.DoubleType, T.DecimalType)
TIME_TYPES = (T.TimestampType, T.TimestampNTZType, T.DateType)


def dtype_of(df: DataFrame, col: str) -> T.DataType:
    return df.schema[col].dataType


def is_numeric(df: DataFrame, col: str) -> bool:
    return isinstance(dtype_of(df, col), NUMERIC_TYPES)


def is_integral(df: DataFrame, col: str) -> bool:
    return isinstance(dtype_of(df, col), INTEGRAL_TYPES)


def is_string(df: DataFrame, col: str) -> bool:
    return isinstance(dtype_of(df, col), T.StringType)


def is_time(df: DataFrame, col: str) -> bool:
    return isinstance(dtype_of(df, col), TIME_TYPES)


def pandas_dtype_name(dt: T.DataType, has_null: bool = False) -> str:
    """The dtype name the column would carry in a pandas frame read from CSV."""
    if isinstance(dt, INTEGRAL_TYPES):
        if has_null:
            return "float64"
        return {T.ByteType: "int8", T.ShortType: "int16", T.IntegerType: "int32"}.get(type(dt), "int64")
    if isinstance(dt, T.FloatType):
        return "float32"
    if isinstance(dt, (T.DoubleType, T.DecimalType)):
        return "float64"
    if isinstance(dt, T.BooleanType):
        return "bool"
    if isinstance(dt, TIME_TYPES):
        return "datetime64[ns]"
    if isinstance(dt, T.StringType):
        return "object"
    return dt.simpleString()


def nan_to_null(c: Column | str) -> Column:
    """Double NaN and +-inf are treated as missing (SQL NULL)."""
    c = F.col(c) if isinstance(c, str) else c
    d = c.cast("double")
    return F.when(F.isnan(d) | (F.abs(d) == F.lit(float("inf"))), F.lit(None).cast("double")).otherwise(d)


def present(df: DataFrame, col: str) -> Column:
    """Non-missing test: NULL, and for floating columns NaN, count as missing."""
    c = F.col(col)
    if isinstance(dtype_of(df, col), (T.FloatType, T.DoubleType)):
        return c.isNotNull() & ~F.isnan(c)
    return c.isNotNull()


def fold(c: Column | str) -> Column:
    """lower(trim(str(value))) used by boolean detection and conversion."""
    c = F.col(c) if isinstance(c, str) else c
    return F.lower(F.trim(c.cast("string")))


def to_binary_expr(c: Column | str, include_tf: bool = False) -> Column:
    """yes/true/y/1 -> 1, no/false/n/0 -> 0, anything else -> NULL."""
    trues = TRUE_VALUES + (["t"] if include_tf else [])
    falses = FALSE_VALUES + (["f"] if include_tf else [])
    f = fold(c)
    return (F.when(f.isin(trues), F.lit(1))
            .when(f.isin(falses), F.lit(0))
            .otherwise(F.lit(None).cast("int")))


def hash_unit(cols: list[str], seed: int = 42) -> Column:
    """Deterministic value in [0, 1) from the key columns and a seed.

    md5 of ``seed|k1|k2..`` (first 32 bits; NULL keys are skipped, as SQL
    ``concat_ws`` does).  Stable under repartitioning and task retries
    (unlike ``rand``), and reproducible in any SQL engine with md5.
    """
    parts = [F.lit(str(seed))] + [F.col(c).cast("string") for c in cols]
    h = F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8)
    return F.conv(h, 16, 10).cast("long") / F.lit(4294967296.0)


def hash_key(cols: list[str], seed: int = 42) -> Column:
    """32-bit integer ordering key (same md5 rule as :func:`hash_unit`)."""
    parts = [F.lit(str(seed))] + [F.col(c).cast("string") for c in cols]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("long")


def stack_columns(df: DataFrame, cols: list[str], cast: str = "double",
                  name_col: str = "name", value_col: str = "v", drop_missing: bool = True) -> DataFrame:
    """Unpivot ``cols`` into (name, v) rows; missing values dropped by default.

    One Expand over the scan; the scan only reads ``cols``.
    """
    if cast == "double":
        vals = [nan_to_null(c) for c in cols]
    else:
        vals = [F.col(c).cast(cast) for c in cols]
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias(name_col), v.alias(value_col))
                                 for c, v in zip(cols, vals)]))
    out = df.select(pairs.alias("_p")).select(f"_p.{name_col}", f"_p.{value_col}")
    if drop_missing:
        out = out.where(F.col(value_col).isNotNull())
    return out

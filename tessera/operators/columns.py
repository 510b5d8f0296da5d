"""Projection and column operators (C1-C7): plain projections, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.exprs import hash_key

RESERVED = ("_id", "_fold", "_label")


def _lower_set(names):
    return {n.lower() for n in names}


def drop_columns(df: DataFrame, cols: list[str]) -> DataFrame:
    """Drop the named columns; unknown names are ignored."""
    have = set(df.columns)
    return df.drop(*[c for c in cols if c in have])


def rename_column(df: DataFrame, old: str, new: str) -> DataFrame:
    """Rename; error if ``new`` already names another column (Spark names are case-insensitive)."""
    if old not in df.columns:
        raise ValueError(f"unknown column {old!r}")
    if new != old and new.lower() in _lower_set(c for c in df.columns if c != old):
        raise ValueError(f"a column named {new!r} already exists")
    return df.withColumnRenamed(old, new)


def lowercase_columns(df: DataFrame, cols: list[str]) -> DataFrame:
    """Lower-case the given names; reject if the final names collide."""
    mapping = {c: c.lower() for c in cols if c in df.columns}
    final = [mapping.get(c, c) for c in df.columns]
    if len(set(final)) != len(final) or len(_lower_set(final)) != len(final):
        raise ValueError("lower-casing would create duplicate column names")
    return df.withColumnsRenamed(mapping)


def select_features(df: DataFrame, target: str, features: list[str]) -> DataFrame:
    """C4: target first, then the chosen features."""
    return df.select(target, *[f for f in features if f != target])


def numeric_feature_names(df: DataFrame, target: str) -> list[str]:
    num = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
    return [f.name for f in df.schema.fields if f.name != target and isinstance(f.dataType, num)]


def numeric_xy(df: DataFrame, target: str) -> DataFrame:
    """Drop rows with any missing value in any column, keep the target and numeric features.

    Boolean and string columns are left out (as in the reference's selection
    by float64/int64 dtype).
    """
    clean = df.na.drop("any")
    return clean.select(target, *numeric_feature_names(clean, target))


def derive_column(df: DataFrame, col: str, expr: str | Column, mode: str = "keep_both",
                  new_name: str | None = None) -> DataFrame:
    """Apply a user Spark SQL expression to ``col``.

    mode ``keep_both`` adds ``{col}_transformed`` (or ``new_name``; must be
    new), ``replace`` overwrites ``col``, ``reject`` returns ``df`` unchanged.
    Row count is preserved by construction (a projection).
    """
    e = F.expr(expr) if isinstance(expr, str) else expr
    if mode == "reject":
        return df
    if mode == "replace":
        return df.withColumn(col, e)
    if mode == "keep_both":
        name = new_name or f"{col}_transformed"
        if name.lower() in _lower_set(df.columns):
            raise ValueError(f"column {name!r} already exists")
        return df.withColumn(name, e)
    raise ValueError(f"unknown mode {mode!r}")


def preview_change(df: DataFrame, col: str, expr: str | Column, key: list[str], n: int = 10,
                   seed: int = 42) -> DataFrame:
    """``n`` rows (hash-sampled by ``key``) of original vs proposed value.

    A top-n by a hash of the key: each task keeps n rows, the driver merges
    n x tasks rows (TakeOrderedAndProject).
    """
    e = F.expr(expr) if isinstance(expr, str) else expr
    return (df.select(*key, F.col(col).alias("original"), e.alias("proposed"),
                      hash_key(key, seed).alias("_h"))
            .orderBy("_h", *key).limit(n).drop("_h"))

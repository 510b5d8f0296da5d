"""Query registry used by ``__spark_entry__`` (queries + oracle SQL)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name`` with its oracle SQL."""
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def round_half_away(c, digits: int = 6):
    """Round on the binary value, half away from zero (as C ``round(x * 10^d) / 10^d``).

    ``F.round`` rounds the shortest decimal string HALF_UP, which differs
    from most SQL engines exactly on ties; this form matches them.
    """
    p = float(10 ** digits)
    x = F.col(c) if isinstance(c, str) else c
    return F.signum(x) * F.floor(F.abs(x) * p + F.lit(0.5)) / p


def round_sig(c, sig: int = 10):
    """Round to ``sig`` significant digits, half away from zero, on the binary value.

    Float sums differ between engines in the last bits; comparing results
    at 10 significant digits removes that noise for any magnitude.  The SQL
    twin is :func:`sql_sig`.
    """
    x = F.col(c) if isinstance(c, str) else c
    scale = F.pow(F.lit(10.0), F.lit(float(sig - 1)) - F.floor(F.log10(F.abs(x))))
    return F.when(x.isNull() | (x == 0) | F.isnan(x), x).otherwise(
        F.signum(x) * F.floor(F.abs(x) * scale + F.lit(0.5)) / scale)


def sql_sig(expr: str, sig: int = 10) -> str:
    """DuckDB text of :func:`round_sig` for ``expr``."""
    e = f"({expr})"
    scale = f"pow(10.0, {sig - 1}.0 - floor(log10(abs({e}))))"
    return (f"(CASE WHEN {e} IS NULL OR {e} = 0 OR isnan({e}) THEN {e} "
            f"ELSE sign({e}) * floor(abs({e}) * {scale} + 0.5) / {scale} END)")


def rounded(df: DataFrame, sig: int = 10) -> DataFrame:
    """Round every double column to ``sig`` significant digits (see :func:`round_sig`)."""
    return df.select(*[round_sig(f.name, sig).alias(f.name)
                       if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name)
                       for f in df.schema.fields])

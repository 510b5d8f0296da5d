"""Sources, sinks and previews."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.exprs import hash_key, hash_unit

# Strings read as missing by default (pandas' default NA tokens).
DEFAULT_NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
                     "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]


# Numbers as pandas reads them (no Java suffixes such as 10D), and its spellings of booleans.
INTEGER = r"^\s*[+-]?[0-9]+\s*$"
NUMBER = r"^\s*[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?)\s*$"
TRUE_TOKENS, FALSE_TOKENS = ["True", "TRUE", "true"], ["False", "FALSE", "false"]
# Quotes are doubled inside quoted fields; line ends and padding inside fields are kept.
CSV_OPTIONS = {"quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def _infinity(x):
    return F.when(F.lower(x).rlike("inf"), F.when(x.startswith("-"), F.lit(float("-inf"))).otherwise(F.lit(float("inf"))))


def _goes_over_lines(spark: SparkSession, path: str) -> bool:
    """Whether some line has an odd number of quotation marks (doubled ones count as two)."""
    marks = F.length("value") - F.length(F.replace(F.col("value"), F.lit('"'), F.lit("")))
    return not spark.read.text(path).where(marks % 2 == 1).isEmpty()


def read_csv(spark: SparkSession, path: str, null_tokens: list[str] | None = None,
             header: bool = True, multi_line: bool | None = None) -> DataFrame:
    """CSV with header; NA tokens -> NULL; per-column type inferred like pandas.

    Read as strings, null the tokens, then ONE aggregate decides for every
    column whether all present values are integers, else numbers, else
    booleans, else it stays string; a final projection casts.

    ``multi_line`` allows line ends inside quoted fields; a file is then one
    task's input.  Unless it is given, one pass over the lines decides: a line with an
    odd number of quotation marks begins or ends a field that goes over lines.  Files
    without such a line are split, however large they are.
    """
    if multi_line is None:
        multi_line = _goes_over_lines(spark, path)
    tokens = DEFAULT_NA_TOKENS if null_tokens is None else null_tokens
    raw = spark.read.options(header=header, inferSchema=False, multiLine=multi_line, **CSV_OPTIONS).csv(path)
    cleaned = raw.select(*[F.when(F.col(c).isin(tokens), F.lit(None)).otherwise(F.col(c)).alias(c)
                           for c in raw.columns])
    aggs = []
    for i, c in enumerate(cleaned.columns):
        x = F.col(c)
        fits = x.rlike(INTEGER) & F.trim(x).try_cast("long").isNotNull()
        aggs += [F.sum(F.when(x.isNotNull() & ~fits, 1).otherwise(0)).alias(f"l{i}"),
                 F.sum(F.when(x.isNotNull() & ~x.rlike(NUMBER), 1).otherwise(0)).alias(f"d{i}"),
                 F.sum(F.when(x.isNotNull() & ~x.isin(*TRUE_TOKENS, *FALSE_TOKENS), 1).otherwise(0)).alias(f"b{i}"),
                 F.count(x).alias(f"n{i}")]
    r = cleaned.agg(*aggs).collect()[0]
    out = []
    for i, c in enumerate(cleaned.columns):
        x = F.trim(F.col(c))
        if r[f"n{i}"] == 0:
            out.append(F.col(c).cast("double").alias(c))   # all missing -> float64 NaN column
        elif r[f"l{i}"] == 0:
            out.append(x.try_cast("long").alias(c))
        elif r[f"d{i}"] == 0:
            out.append(F.coalesce(_infinity(x), x.try_cast("double")).alias(c))
        elif r[f"b{i}"] == 0:
            out.append(F.col(c).isin(TRUE_TOKENS).alias(c))
        else:
            out.append(F.col(c))
    return cleaned.select(*out)


def write_csv(df: DataFrame, path: str, null_token: str = "") -> None:
    """Write with a header, no index; one file per task (parallel writers)."""
    df.write.mode("overwrite").options(header=True, nullValue=null_token, **CSV_OPTIONS).csv(path)


def preview(df: DataFrame, order_by: list[str], n: int = 10) -> DataFrame:
    """S3: first n and last n rows by ``order_by`` (overlap kept), tagged head/tail.

    Two top-n (TakeOrderedAndProject) plans: each task keeps n rows.
    """
    head = df.orderBy(*[F.col(c).asc() for c in order_by]).limit(n).withColumn("_part", F.lit("head"))
    tail = df.orderBy(*[F.col(c).desc() for c in order_by]).limit(n).withColumn("_part", F.lit("tail"))
    return head.unionAll(tail)


def sample_values(df: DataFrame, col: str, n: int = 20, seed: int = 42) -> DataFrame:
    """Up to n distinct present values, chosen by a seeded hash (reproducible)."""
    vals = df.where(F.col(col).isNotNull()).select(F.col(col).alias("value")).distinct()
    return vals.withColumn("_h", hash_key(["value"], seed)).orderBy("_h", "value").limit(n).drop("_h")


def sample_fraction(df: DataFrame, frac: float, key: list[str] | None = None, seed: int = 42) -> DataFrame:
    """Row sample for a plot.  With ``key``: reproducible hash filter
    (same rows on any partitioning / retry); without: ``df.sample``."""
    if key:
        return df.where(hash_unit(key, seed) < F.lit(float(frac)))
    return df.sample(fraction=frac, seed=seed)

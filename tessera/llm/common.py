"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from tessera.session import scratch_path, ship_package

#: Words are runs of characters other than the six ASCII white-space characters.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a fresh table in the shared folder and read it back.

    This cuts the lineage and survives the loss of executors, because the files
    are in the folder that ``spark.checkpoint.dir`` names.
    """
    spark = df.sparkSession
    ship_package(spark)
    path = scratch_path(spark, name)
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def cut_points(df: DataFrame, column: str, parts: int) -> list[int]:
    """At most ``parts - 1`` ascending cuts of a long column (one aggregate; the list is bounded by ``parts``)."""
    if parts < 2:
        return []
    probs = [i / parts for i in range(1, parts)]
    row = df.agg(F.percentile_approx(column, probs, 100 * parts).alias("c")).first()
    return sorted(set(row["c"] or []))


def bucket_of(column: str, cuts: list[int]):
    """Number of cuts that are not above the value, by binary search (a long column, no nulls)."""
    import numpy as np

    edges = np.array(cuts, dtype=np.int64)

    @pandas_udf(T.IntegerType())
    def bucket(values):
        import pandas as pd

        return pd.Series(np.searchsorted(edges, values.to_numpy(dtype=np.int64), side="right").astype("int32"))

    return bucket(F.col(column))


def held_out(id_column):
    """True for the fold that is never learned from: crc32 of the id as text, modulo 4, is 2 (null id: the empty text)."""
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def hash_fraction(id_column, seed: str):
    """A number in [0, 1) from the id and a seed, equal on every engine that has md5."""
    digits = F.substring(F.md5(F.concat(F.lit(seed + ":"), id_column).cast("binary")), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(1 << 52))


def drop_scratch(df: DataFrame, prefix: str) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith(prefix)])

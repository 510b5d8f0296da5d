"""Row numbers of a whole DataFrame without a one-task window.

Rows are dealt to ranges of the order (Spark's range partitioning) and written
to the shared folder, so that the ranges stay as they are; each range numbers
its own rows, and the rows of the ranges before it are added.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import scratch_path

PART, OWN = "__rank_part", "__rank_own"


def with_rank(df: DataFrame, order_by: list[str], name: str) -> DataFrame:
    """Add ``name``: 0, 1, ... in the order of ``order_by`` (together unique)."""
    spark = df.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    path = scratch_path(spark, "rank")
    df.repartitionByRange(parts, *order_by).withColumn(PART, F.spark_partition_id()).write.parquet(path)
    ranged = spark.read.parquet(path)
    before, offsets = 0, []
    for r in ranged.groupBy(PART).agg(F.count("*").alias("n")).orderBy(PART).collect():   # a row a range
        offsets += [F.lit(r[PART]), F.lit(before)]
        before += r["n"]
    if not offsets:
        return ranged.withColumn(name, F.lit(0).cast("long")).drop(PART)
    own = F.row_number().over(Window.partitionBy(PART).orderBy(*order_by)) - 1
    return (ranged.withColumn(OWN, own)
            .withColumn(name, (F.col(OWN) + F.element_at(F.create_map(*offsets), F.col(PART))).cast("long")).drop(PART, OWN))

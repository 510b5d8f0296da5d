"""Mixing sources to target weights, with DataFrame functions only.

Tokens are summed per source, the targets follow from weights by water filling,
and every document is taken ``floor(rate)`` times plus one more time with the
probability of the fraction, decided by a hash of its id and a seed.

Defined cases: a null text has size 0; null is a source of its own and comes
last; a null id is replaced by the text in the hash; repeated rows are decided
alike (equal id) but each counts towards its source; an empty table gives an
empty result; a source of size 0 has target and rate 0.  Extra columns are kept,
also when they have the names of the result (the results replace them).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import WORD_PATTERN, hash_fraction, materialize, shuffle_partitions

WEIGHTS = (3.0, 1.0, 2.0)
P = "__mix_"


def word_count(text):
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD_PATTERN)).cast("long")


def _source_key(source):
    return F.when(source.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), source))


def source_ranks(sources: DataFrame, column: str) -> DataFrame:
    """Add ``rank`` (0 first) by code point, nulls last: ranges are numbered apart, then shifted by the rows before them."""
    spark = sources.sparkSession
    order = F.col(column).asc_nulls_last()
    ranged = materialize(
        sources.repartitionByRange(shuffle_partitions(spark), order).withColumn(P + "part", F.spark_partition_id()), "mix-sources")
    before = Window.orderBy(P + "part").rowsBetween(Window.unboundedPreceding, -1)
    # One row for each partition: the only rows that meet in one task.
    shift = ranged.groupBy(P + "part").agg(F.count("*").alias(P + "n")).select(
        P + "part", F.coalesce(F.sum(P + "n").over(before), F.lit(0)).alias(P + "shift"))
    own = F.row_number().over(Window.partitionBy(P + "part").orderBy(order)) - 1
    return ranged.withColumn(P + "own", own).join(shift, P + "part").withColumn(
        "rank", (F.col(P + "own") + F.col(P + "shift")).cast("long")).drop(P + "part", P + "own", P + "shift")


def source_targets(sizes: DataFrame, weights=WEIGHTS, budget: float = 1.5, most: float = 2.0) -> DataFrame:
    """``source, source_size, weight, target, rate`` for rows of ``source, size``.

    The targets share ``budget`` times all tokens by weight; none goes beyond
    ``most`` times its source.  With a level L the targets are
    ``min(most * size, L * weight)``; L rises until they add up, one aggregate
    over the sources a step.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    cycle = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    plan = materialize(source_ranks(totals, "source").withColumn("weight", cycle).drop("rank"), "mix-plan")
    cap = F.col("source_size") * F.lit(float(most))
    first = plan.agg(F.sum("source_size").alias("t"), F.sum("weight").alias("w")).first()
    goal = float(budget) * float(first["t"] or 0)
    level = goal / first["w"] if first["w"] else 0.0
    while True:
        reach = F.lit(level) * F.col("weight")
        row = plan.agg(F.sum(F.when(cap < reach, cap)).alias("full"), F.sum(F.when(cap >= reach, F.col("weight"))).alias("free")).first()
        if not row["free"]:
            break
        higher = (goal - (row["full"] or 0.0)) / row["free"]
        if higher <= level * (1 + 1e-12):
            break
        level = higher
    target = F.least(cap, F.lit(level) * F.col("weight"))
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(0.0)
    return plan.withColumn("target", target).withColumn("rate", rate)


def mix(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", weights=WEIGHTS,
        budget: float = 1.5, most: float = 2.0, seed: str = "mix") -> DataFrame:
    """``docs`` with ``size, source_size, target, rate, copies`` (how many times the mix takes the row)."""
    out = ["size", "source_size", "target", "rate", "copies"]
    base = docs.drop(*[c for c in out if c not in (text, source, doc_id)])
    sized = base.withColumn(P + "size", word_count(F.col(text))).withColumn(P + "key", _source_key(F.col(source)))
    slim = materialize(sized.select(F.col(source).alias("source"), F.col(P + "size").alias("size"))
                       .groupBy("source").agg(F.sum("size").alias("size")), "mix-sizes")
    plan = source_targets(slim, weights, budget, most)
    plan = plan.select(_source_key(F.col("source")).alias(P + "key"), F.col("source_size").alias(P + "source_size"),
                       F.col("target").alias(P + "target"), F.col("rate").alias(P + "rate"))
    ident = F.coalesce(F.col(doc_id).cast("string"), F.col(text), F.lit(""))
    whole = F.floor(P + "rate")
    extra = (hash_fraction(ident, seed) < F.col(P + "rate") - whole).cast("long")
    # The plan has one row a source; Spark broadcasts it if its measured size allows it and otherwise joins by key.
    mixed = sized.join(plan, P + "key").withColumn(P + "copies", whole + extra)
    keep = [F.col(c) for c in base.columns]
    return mixed.select(*keep, *[F.col(P + c).alias(c) for c in out])


def emit(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """Each row of :func:`mix` as many times as its ``copies`` say."""
    times = F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))
    return mixed.select(*columns, times.alias(P + "copy")).drop(P + "copy")


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, text, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (
  SELECT source, source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS w
  FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY 2.0 * source_size / w, source NULLS LAST) AS k FROM r),
p AS (
  SELECT *, coalesce(sum(2.0 * source_size) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below,
         sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
  FROM o),
l AS (
  SELECT (1.5 * t - below) / rest AS level
  FROM p, (SELECT sum(source_size) AS t FROM s) AS a
  WHERE 2.0 * source_size / w >= (1.5 * t - below) / rest ORDER BY k LIMIT 1),
g AS (SELECT source, source_size, least(2.0 * source_size, w * level)::DOUBLE AS target FROM r, l),
e AS (
  SELECT d.doc_id, d.size, g.source_size, g.target,
         CASE WHEN g.source_size > 0 THEN least(g.target / g.source_size, 2.0) ELSE 0.0 END AS rate,
         CAST(('0x' || substr(md5('mix:' || coalesce(CAST(d.doc_id AS VARCHAR), d.text, '')), 1, 13)) AS BIGINT) / 4503599627370496.0 AS u
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
       CAST(size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM e
"""


def op9_mix_sources(docs: DataFrame) -> DataFrame:
    m = mix(docs.select("doc_id", "text", "source"))
    return m.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))

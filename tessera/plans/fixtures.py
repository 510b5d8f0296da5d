"""Derived fixtures over the driver's tables, defined twice: as Spark
DataFrames and as SQL (DuckDB oracle).  Both definitions must stay equal;
they keep every row of the source table (nulls are injected, never rows
dropped)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _null_when(c: str, key: str, m: int):
    return F.when(F.col(key) % m == 0, F.lit(None)).otherwise(F.col(c)).alias(c)


def orders_missing(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", _null_when("o_totalprice", "o_orderkey", 11),
                    _null_when("o_orderpriority", "o_orderkey", 13))


def supplier_missing(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    return s.select("s_suppkey", "s_nationkey", _null_when("s_acctbal", "s_suppkey", 9))


def event_pairs(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")


def flags(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    m = F.col("event_id") % 5
    flag = (F.when(m == 0, "Yes").when(m == 1, "no").when(m == 2, " Y ").when(m == 3, "maybe")
            .otherwise(F.lit(None).cast("string")))
    return e.select("event_id", flag.alias("flag"))


def date_strings(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    s = F.when(F.col("o_orderkey") % 7 == 0, F.lit("n/a")).otherwise(F.date_format("o_orderdate", "dd/MM/yyyy"))
    return o.select("o_orderkey", s.alias("o_orderdate"))


LINE_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"]


def line_binary(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.select(*LINE_KEYS, "l_quantity", "l_discount",
                     (F.col("l_returnflag") == "R").cast("int").alias("y"),
                     (F.col("l_quantity") > 25).cast("int").alias("pred"),
                     (F.col("l_quantity") / 50.0).alias("score"))


def line_multi(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    pred = F.when(F.col("l_quantity") <= 17, "A").when(F.col("l_quantity") <= 34, "N").otherwise("R")
    return li.select(*LINE_KEYS, F.col("l_returnflag").alias("y"), pred.alias("pred"))


def line_regress(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.select(*LINE_KEYS, F.col("l_extendedprice").alias("y"),
                     (F.col("l_quantity") * 1500.0).alias("pred"))


# SQL twins (DuckDB; the driver pre-registers the base tables as views).
SQL = {
    "orders_missing": """SELECT o_orderkey,
        CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_totalprice END AS o_totalprice,
        CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority
        FROM orders""",
    "supplier_missing": """SELECT s_suppkey, s_nationkey,
        CASE WHEN s_suppkey % 9 = 0 THEN NULL ELSE s_acctbal END AS s_acctbal FROM supplier""",
    "event_pairs": "SELECT event_id, user_id, event_type FROM events",
    "flags": """SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'Yes' WHEN 1 THEN 'no' WHEN 2 THEN ' Y '
        WHEN 3 THEN 'maybe' ELSE NULL END AS flag FROM events""",
    "date_strings": """SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'n/a'
        ELSE strftime(o_orderdate, '%d/%m/%Y') END AS o_orderdate FROM orders""",
    "line_binary": """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice,
        l_quantity, l_discount, CAST(l_returnflag = 'R' AS INTEGER) AS y,
        CAST(l_quantity > 25 AS INTEGER) AS pred, l_quantity / 50.0 AS score FROM lineitem""",
    "line_multi": """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice,
        l_returnflag AS y, CASE WHEN l_quantity <= 17 THEN 'A' WHEN l_quantity <= 34 THEN 'N' ELSE 'R' END AS pred
        FROM lineitem""",
    "line_regress": """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice,
        l_extendedprice AS y, l_quantity * 1500.0 AS pred FROM lineitem""",
}

FIXTURES = {
    "orders_missing": orders_missing, "supplier_missing": supplier_missing, "event_pairs": event_pairs,
    "flags": flags, "date_strings": date_strings, "line_binary": line_binary, "line_multi": line_multi,
    "line_regress": line_regress,
}


def with_fixtures(sql: str, *names: str) -> str:
    """Prefix ``sql`` with CTEs for the named fixtures."""
    if not names:
        return sql
    ctes = ",\n".join(f"{n} AS ({SQL[n]})" for n in names)
    body = sql.lstrip()
    if body[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"

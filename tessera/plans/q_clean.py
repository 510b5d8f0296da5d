"""Registered queries for sources (S), columns (C), dedup (D) and cleaning (O, I, B, E, T)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import clean as CL
from tessera.operators import columns as C
from tessera.operators import dedup as D
from tessera.plans.fixtures import (LINE_KEYS, date_strings, event_pairs, flags, orders_missing, table,
                                    with_fixtures)
from tessera.plans.registry import query, rounded, sql_sig
from tessera.session import scratch_path
from tessera.sources import io as IO

LK = ", ".join(LINE_KEYS)
MD5_KEY = "('0x' || substr(md5({}), 1, 8))::BIGINT"


# ------------------------------------------------------------------ sources
@query("s1_read_csv", with_fixtures("SELECT * FROM orders_missing", "orders_missing"))
def s1(spark, sf):
    path = scratch_path(spark, "s1-orders-missing-csv")
    IO.write_csv(orders_missing(spark, sf), path, null_token="NA")
    return IO.read_csv(spark, path)


@query("s2_write_csv")
def s2(spark, sf):
    li = table(spark, sf, "lineitem")
    path = scratch_path(spark, "s2-lineitem-csv")
    IO.write_csv(li, path)
    return spark.read.option("header", True).csv(path)


@query("s2_write_csv_documents", "SELECT * FROM documents")
def s2_documents(spark, sf):
    """Whole texts with quotes and line ends, written and read again."""
    path = scratch_path(spark, "s2-documents-csv")
    IO.write_csv(table(spark, sf, "documents"), path)
    return IO.read_csv(spark, path)


@query("s3_preview", f"""(SELECT *, 'head' AS _part FROM lineitem ORDER BY {LK} LIMIT 10)
UNION ALL (SELECT *, 'tail' AS _part FROM lineitem ORDER BY {', '.join(k + ' DESC' for k in LINE_KEYS)} LIMIT 10)""")
def s3(spark, sf):
    return IO.preview(table(spark, sf, "lineitem"), LINE_KEYS, 10)


@query("s4_sample_values", f"""SELECT value FROM (SELECT DISTINCT o_custkey AS value FROM orders
  WHERE o_custkey IS NOT NULL) ORDER BY {MD5_KEY.format("'42|' || CAST(value AS VARCHAR)")}, value LIMIT 20""")
def s4(spark, sf):
    return IO.sample_values(table(spark, sf, "orders"), "o_custkey", 20, 42)


@query("s5_sample_fraction", f"""SELECT * FROM lineitem WHERE
  {MD5_KEY.format("concat_ws('|', '42', l_orderkey, l_linenumber, l_partkey, l_suppkey)")} / 4294967296.0 < 0.1""")
def s5(spark, sf):
    return IO.sample_fraction(table(spark, sf, "lineitem"), 0.1,
                              key=["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], seed=42)


# ------------------------------------------------------------------ columns
@query("c1_drop_columns", "SELECT * EXCLUDE (l_tax, l_linestatus) FROM lineitem")
def c1(spark, sf):
    return C.drop_columns(table(spark, sf, "lineitem"), ["l_tax", "l_linestatus", "no_such_column"])


@query("c2_rename_column", """SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice AS total_price,
  o_orderdate, o_orderpriority FROM orders""")
def c2(spark, sf):
    return C.rename_column(table(spark, sf, "orders"), "o_totalprice", "total_price")


@query("c3_lowercase_columns", "SELECT o_orderkey, o_custkey, o_orderstatus AS O_Status FROM orders")
def c3(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("O_ORDERKEY"),
                                          F.col("o_custkey").alias("O_CustKey"),
                                          F.col("o_orderstatus").alias("O_Status"))
    return C.lowercase_columns(o, ["O_ORDERKEY", "O_CustKey"])


@query("c4_select_features", "SELECT l_extendedprice, l_quantity, l_discount, l_tax FROM lineitem")
def c4(spark, sf):
    return C.select_features(table(spark, sf, "lineitem"), "l_extendedprice",
                             ["l_quantity", "l_discount", "l_tax", "l_extendedprice"])


@query("c5_numeric_xy", with_fixtures("""SELECT o_totalprice, o_orderkey FROM orders_missing
  WHERE o_orderkey IS NOT NULL AND o_totalprice IS NOT NULL AND o_orderpriority IS NOT NULL""", "orders_missing"))
def c5(spark, sf):
    return C.numeric_xy(orders_missing(spark, sf), "o_totalprice")


@query("c6_derive_column",
       "SELECT *, l_extendedprice * (1 - l_discount) AS l_extendedprice_transformed FROM lineitem")
def c6(spark, sf):
    return C.derive_column(table(spark, sf, "lineitem"), "l_extendedprice",
                           "l_extendedprice * (1 - l_discount)", mode="keep_both")


@query("c7_preview_change", f"""SELECT o_orderkey, o_totalprice AS original, o_totalprice / 1000 AS proposed
  FROM orders ORDER BY {MD5_KEY.format("'42|' || CAST(o_orderkey AS VARCHAR)")}, o_orderkey LIMIT 10""")
def c7(spark, sf):
    return C.preview_change(table(spark, sf, "orders"), "o_totalprice", "o_totalprice / 1000",
                            key=["o_orderkey"], n=10, seed=42)


# ------------------------------------------------------------------ dedup
@query("d1_drop_duplicates_first", with_fixtures("""SELECT event_id, user_id, event_type FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS rn FROM event_pairs)
  WHERE rn = 1""", "event_pairs"))
def d1(spark, sf):
    return D.drop_duplicates(event_pairs(spark, sf), ["user_id", "event_type"], "first", order_by=["event_id"])


@query("d1_drop_duplicates_whole_row", "SELECT DISTINCT user_id, event_type FROM events")
def d1b(spark, sf):
    return D.drop_duplicates(table(spark, sf, "events").select("user_id", "event_type"))


@query("d2_drop_duplicates_none", with_fixtures("""SELECT event_id, user_id, event_type FROM (
  SELECT *, count(*) OVER (PARTITION BY user_id, event_type) AS n FROM event_pairs) WHERE n = 1""", "event_pairs"))
def d2(spark, sf):
    return D.drop_duplicates(event_pairs(spark, sf), ["user_id", "event_type"], keep=False)


@query("d2_drop_duplicates_none_whole_row", """SELECT user_id, event_type FROM events
  GROUP BY user_id, event_type HAVING count(*) = 1""")
def d2b(spark, sf):
    return D.drop_duplicates(table(spark, sf, "events").select("user_id", "event_type"), keep=False)


@query("d2_drop_duplicates_none_orders", """SELECT o_orderkey, o_custkey, o_orderdate FROM (
  SELECT o_orderkey, o_custkey, o_orderdate, count(*) OVER (PARTITION BY o_custkey, o_orderdate) AS n FROM orders) WHERE n = 1""")
def d2_orders(spark, sf):
    return D.drop_duplicates(table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate"), ["o_custkey", "o_orderdate"], keep=False)


# ------------------------------------------------------------------ outliers / imputation
_KEYS4 = "l_orderkey, l_linenumber, l_partkey, l_suppkey"


def _k4(df):
    return ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


_SOME_MISSING = "(SELECT *, CASE WHEN l_partkey % 7 = 0 THEN NULL ELSE l_extendedprice END AS p FROM lineitem) AS m"


@query("o1_cap_iqr_missing", f"""SELECT {_KEYS4}, {sql_sig("CASE WHEN p IS NULL THEN NULL ELSE least(greatest(p, q1 - 1.5 * (q3 - q1)), q3 + 1.5 * (q3 - q1)) END")}
  AS p FROM {_SOME_MISSING}, (SELECT quantile_cont(p, 0.25) AS q1, quantile_cont(p, 0.75) AS q3 FROM {_SOME_MISSING}) AS q""")
def o1_missing(spark, sf):
    """NaN and NULL values are neither counted nor clipped."""
    li = table(spark, sf, "lineitem")
    p = (F.when(F.col("l_partkey") % 14 == 0, F.lit(float("nan"))).when(F.col("l_partkey") % 7 == 0, F.lit(None).cast("double"))
         .otherwise(F.col("l_extendedprice")))
    out = CL.cap_iqr(li.select(*_k4(li), p.alias("p")), "p")
    return rounded(out.withColumn("p", F.when(F.isnan("p"), F.lit(None).cast("double")).otherwise(F.col("p"))))


@query("o1_cap_iqr", f"""SELECT {_KEYS4}, {sql_sig("least(greatest(l_extendedprice, q1 - 1.5 * (q3 - q1)), q3 + 1.5 * (q3 - q1))")}
  AS l_extendedprice FROM lineitem, (SELECT quantile_cont(l_extendedprice, 0.25) q1,
  quantile_cont(l_extendedprice, 0.75) q3 FROM lineitem) q""")
def o1(spark, sf):
    li = table(spark, sf, "lineitem").select(*_k4(None), "l_extendedprice")
    return rounded(CL.cap_iqr(li, "l_extendedprice", 1.5))


@query("o2_cap_percentile", f"""SELECT {_KEYS4}, {sql_sig("least(greatest(l_extendedprice, a), b)")} AS l_extendedprice
  FROM lineitem, (SELECT quantile_cont(l_extendedprice, 0.05) a, quantile_cont(l_extendedprice, 0.95) b FROM lineitem) q""")
def o2(spark, sf):
    li = table(spark, sf, "lineitem").select(*_k4(None), "l_extendedprice")
    return rounded(CL.cap_percentile(li, "l_extendedprice", 5, 95))


@query("i1_impute_mean", with_fixtures(f"""SELECT o_orderkey, {sql_sig("coalesce(o_totalprice, m)")} AS o_totalprice,
  o_orderpriority FROM orders_missing, (SELECT avg(o_totalprice) m FROM orders_missing) s""", "orders_missing"))
def i1(spark, sf):
    return rounded(CL.impute_mean(orders_missing(spark, sf), "o_totalprice"))


@query("i2_impute_median", with_fixtures(f"""SELECT o_orderkey, {sql_sig("coalesce(o_totalprice, m)")} AS o_totalprice,
  o_orderpriority FROM orders_missing, (SELECT quantile_cont(o_totalprice, 0.5) m FROM orders_missing) s""",
                                         "orders_missing"))
def i2(spark, sf):
    return rounded(CL.impute_median(orders_missing(spark, sf), "o_totalprice"))


@query("i4_impute_mode", with_fixtures("""SELECT o_orderkey, o_totalprice, coalesce(o_orderpriority,
  (SELECT o_orderpriority FROM orders_missing WHERE o_orderpriority IS NOT NULL GROUP BY 1
   ORDER BY count(*) DESC, 1 LIMIT 1)) AS o_orderpriority FROM orders_missing""", "orders_missing"))
def i4(spark, sf):
    return CL.impute_mode(orders_missing(spark, sf), "o_orderpriority")


# ------------------------------------------------------------------ binning
def _qcut_sql(col: str, n: int) -> str:
    probs = ", ".join(str(i / n) for i in range(n + 1))
    return f"""SELECT {_KEYS4}, CASE WHEN len(e) < 2 OR {col} IS NULL THEN NULL
  ELSE len(list_filter(list_slice(e, 2, len(e) - 1), lambda x: x < {col})) END::BIGINT AS {col}
  FROM lineitem, (SELECT list_sort(list_distinct(quantile_cont({col}, [{probs}]))) AS e FROM lineitem) q"""


@query("b1_bucketize_quantile", _qcut_sql("l_extendedprice", 4))
def b1(spark, sf):
    li = table(spark, sf, "lineitem").select(*_k4(None), "l_extendedprice")
    return CL.bucketize_quantile(li, "l_extendedprice", 4)


@query("b1_bucketize_quantile_merged_edges", _qcut_sql("l_discount", 10))
def b1b(spark, sf):
    li = table(spark, sf, "lineitem").select(*_k4(None), "l_discount")
    return CL.bucketize_quantile(li, "l_discount", 10)


@query("b2_bucketize_width", f"""SELECT {_KEYS4}, ((l_extendedprice > 1 * ((mx - mn) / 4) + mn)::INT
  + (l_extendedprice > 2 * ((mx - mn) / 4) + mn)::INT + (l_extendedprice > 3 * ((mx - mn) / 4) + mn)::INT)::BIGINT
  AS l_extendedprice FROM lineitem, (SELECT min(l_extendedprice) mn, max(l_extendedprice) mx FROM lineitem) q""")
def b2(spark, sf):
    li = table(spark, sf, "lineitem").select(*_k4(None), "l_extendedprice")
    return CL.bucketize_width(li, "l_extendedprice", 4)


# ------------------------------------------------------------------ encoding
@query("e1_label_encode", """WITH codes AS (SELECT v, row_number() OVER (ORDER BY f, v) - 1 AS code
  FROM (SELECT o_orderpriority v, min(o_orderkey) f FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY 1))
SELECT o_orderkey, code AS o_orderpriority FROM orders LEFT JOIN codes ON o_orderpriority = v""")
def e1(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return CL.label_encode(o, "o_orderpriority", order_by=["o_orderkey"])


@query("e2_one_hot", """SELECT o_orderkey, coalesce(o_orderstatus = 'F', false) AS o_orderstatus_F,
  coalesce(o_orderstatus = 'O', false) AS o_orderstatus_O, coalesce(o_orderstatus = 'P', false) AS o_orderstatus_P
  FROM orders""")
def e2(spark, sf):
    return CL.one_hot(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus")


@query("e3_to_binary", with_fixtures("""SELECT event_id, CASE WHEN lower(trim(flag)) IN ('yes','true','y','1') THEN 1
  WHEN lower(trim(flag)) IN ('no','false','n','0') THEN 0 END AS flag FROM flags""", "flags"))
def e3(spark, sf):
    return CL.to_binary(flags(spark, sf), "flag")


# ------------------------------------------------------------------ dates
@query("t1_parse_datetime_month_first", "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) AS o_orderdate FROM orders")
def t1_month_first(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.date_format("o_orderdate", "MM/dd/yyyy").alias("o_orderdate"))
    return CL.parse_datetime(o, "o_orderdate")


@query("t1_parse_datetime", with_fixtures("""SELECT o_orderkey, try_strptime(o_orderdate, '%d/%m/%Y') AS o_orderdate
  FROM date_strings""", "date_strings"))
def t1(spark, sf):
    return CL.parse_datetime(date_strings(spark, sf), "o_orderdate")


@query("t2_format_datetime", "SELECT o_orderkey, strftime(o_orderdate, '%d-%m-%Y') AS o_orderdate FROM orders")
def t2(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    return CL.format_datetime(o, "o_orderdate", "%d-%m-%Y")

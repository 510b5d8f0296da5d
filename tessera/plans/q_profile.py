"""Registered profiling queries (P1-P10) with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import profile as P
from tessera.plans import sqlgen
from tessera.plans.fixtures import event_pairs, orders_missing, table, with_fixtures
from tessera.plans.registry import query, rounded


@query("p1_infer_autotype_lineitem", sqlgen.autotype_table_sql("lineitem"))
def p1_lineitem(spark, sf):
    return P.infer_autotype(table(spark, sf, "lineitem"))


@query("p1_infer_autotype_orders_missing",
       with_fixtures(sqlgen.autotype_table_sql("orders_missing"), "orders_missing"))
def p1_orders_missing(spark, sf):
    return P.infer_autotype(orders_missing(spark, sf))


_BOOL_SRC = """SELECT l_linestatus AS c1,
  CASE WHEN l_linestatus = 'O' THEN 'Yes' ELSE ' no ' END AS c2,
  CASE WHEN l_linestatus = 'O' THEN 'TRUE' ELSE 'true' END AS c3 FROM lineitem"""


def _bool_src(spark, sf):
    li = table(spark, sf, "lineitem")
    o = F.col("l_linestatus") == "O"
    return li.select(F.col("l_linestatus").alias("c1"),
                     F.when(o, "Yes").otherwise(" no ").alias("c2"),
                     F.when(o, "TRUE").otherwise("true").alias("c3"))


_BOOL_SQL = "\nUNION ALL\n".join(
    f"""SELECT '{c}' AS variable, (count(DISTINCT lower(trim({c}))) = 2 AND (
      (min(lower(trim({c}))) = 'false' AND max(lower(trim({c}))) = 'true') OR
      (min(lower(trim({c}))) = 'f' AND max(lower(trim({c}))) = 't') OR
      (min(lower(trim({c}))) = 'no' AND max(lower(trim({c}))) = 'yes') OR
      (min(lower(trim({c}))) = 'n' AND max(lower(trim({c}))) = 'y') OR
      (min(lower(trim({c}))) = '0' AND max(lower(trim({c}))) = '1'))) AS is_bool_like FROM src"""
    for c in ("c1", "c2", "c3"))


@query("p2_is_bool_like", f"WITH src AS ({_BOOL_SRC})\n{_BOOL_SQL}")
def p2(spark, sf):
    src = _bool_src(spark, sf)
    out = None
    for c in ("c1", "c2", "c3"):
        one = P.is_bool_like_expr_df(src, c)
        out = one if out is None else out.unionByName(one)
    return out


@query("p3_numeric_summary_lineitem", sqlgen.numeric_summary_sql("lineitem"))
def p3_lineitem(spark, sf):
    return rounded(P.numeric_summary(table(spark, sf, "lineitem")))


@query("p3_numeric_summary_orders_missing",
       with_fixtures(sqlgen.numeric_summary_sql("orders_missing"), "orders_missing"))
def p3_orders_missing(spark, sf):
    return rounded(P.numeric_summary(orders_missing(spark, sf)))


@query("p4_string_summary_customer", sqlgen.string_summary_sql("customer"))
def p4_customer(spark, sf):
    return P.string_summary(table(spark, sf, "customer"))


@query("p4_string_summary_orders_missing",
       with_fixtures(sqlgen.string_summary_sql("orders_missing"), "orders_missing"))
def p4_orders_missing(spark, sf):
    return P.string_summary(orders_missing(spark, sf))


_DT_SQL = """SELECT 'o_orderdate' AS variable, 'datetime64[ns]' AS dtype, 'Datetime' AS autotype,
  strftime(arg_min(o_orderdate, o_orderkey), '%Y-%m-%d %H:%M:%S') AS format_guess,
  min(o_orderdate) AS min_time, max(o_orderdate) AS max_time,
  round(100.0::DOUBLE * count(*) FILTER (WHERE o_orderdate IS NULL) / count(*), 2) AS pct_missing,
  count(DISTINCT o_orderdate) AS n_unique FROM orders"""


@query("p5_datetime_summary_orders", _DT_SQL)
def p5(spark, sf):
    return P.datetime_summary(table(spark, sf, "orders"), order_by=["o_orderkey"])


_PROFILE_EVENTS_SQL = f"""SELECT variable, dtype, autotype, min, max, mean, median, pct_missing, n_unique,
  pct_outliers, NULL::VARCHAR AS most_frequent, NULL::VARCHAR AS format_guess,
  NULL::TIMESTAMP AS min_time, NULL::TIMESTAMP AS max_time FROM ({sqlgen.numeric_summary_sql("events")})
UNION ALL
SELECT variable, dtype, autotype, NULL, NULL, NULL, NULL, pct_missing, n_unique, NULL, most_frequent, NULL, NULL, NULL
FROM ({sqlgen.string_summary_sql("events")})
UNION ALL
SELECT 'ts', 'datetime64[ns]', 'Datetime', NULL, NULL, NULL, NULL,
  round(100.0::DOUBLE * count(*) FILTER (WHERE ts IS NULL) / count(*), 2), count(DISTINCT ts), NULL, NULL,
  strftime(arg_min(ts, event_id), '%Y-%m-%d %H:%M:%S'), min(ts), max(ts) FROM events"""


@query("p6_profile_events", _PROFILE_EVENTS_SQL)
def p6(spark, sf):
    return rounded(P.profile(table(spark, sf, "events"), order_by=["event_id"]))


_MISSING_SQL = with_fixtures("\nUNION ALL\n".join(
    f"SELECT '{c}' AS variable, round(100.0::DOUBLE * count(*) FILTER (WHERE {c} IS NULL) / count(*), 2) "
    f"AS pct_missing FROM orders_missing" for c in ("o_orderkey", "o_totalprice", "o_orderpriority")),
    "orders_missing")


@query("p7_missing_percent", _MISSING_SQL)
def p7(spark, sf):
    return P.missing_percent(orders_missing(spark, sf))


_OUTLIER_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_OUTLIER_SQL = "\nUNION ALL\n".join(
    f"""SELECT '{c}' AS variable, round(100.0::DOUBLE * count(*) FILTER (WHERE {c} < q.q1 - 1.5 * (q.q3 - q.q1)
      OR {c} > q.q3 + 1.5 * (q.q3 - q.q1)) / count({c}), 2) AS pct_outliers
    FROM lineitem, (SELECT quantile_cont({c}, 0.25) q1, quantile_cont({c}, 0.75) q3 FROM lineitem) q"""
    for c in _OUTLIER_COLS)


@query("p8_iqr_outlier_percent", _OUTLIER_SQL)
def p8(spark, sf):
    li = table(spark, sf, "lineitem")
    res = P.outlier_percents(li, _OUTLIER_COLS)
    return spark.createDataFrame([(c, res[c]) for c in _OUTLIER_COLS], "variable string, pct_outliers double")


_FMT_SQL = with_fixtures("""SELECT 'o_orderdate' AS variable,
  CASE WHEN s IS NULL THEN ''
       WHEN regexp_matches(s, '^\\d{4}-\\d{2}-\\d{2}$') THEN 'YYYY-MM-DD'
       WHEN regexp_matches(s, '^\\d{8}$') THEN 'YYYYMMDD'
       WHEN regexp_matches(s, '^\\d{2}/\\d{2}/\\d{4}$') THEN 'DD/MM/YYYY'
       WHEN regexp_matches(s, '^\\d{4}/\\d{2}/\\d{2}$') THEN 'YYYY/MM/DD'
       WHEN regexp_matches(s, '^\\d{2}-\\d{2}-\\d{4}$') THEN 'DD-MM-YYYY'
       WHEN regexp_matches(s, '^\\d{4}\\.\\d{2}\\.\\d{2}$') THEN 'YYYY.MM.DD'
       WHEN regexp_matches(s, '^\\d{2}\\.\\d{2}\\.\\d{4}$') THEN 'DD.MM.YYYY'
       ELSE 'Unknown' END AS format_guess
FROM (SELECT arg_min(o_orderdate, o_orderkey) AS s FROM date_strings WHERE o_orderdate IS NOT NULL)""",
                         "date_strings")


@query("p9_infer_datetime_format", _FMT_SQL)
def p9(spark, sf):
    from tessera.plans.fixtures import date_strings
    return P.infer_datetime_format(date_strings(spark, sf), "o_orderdate", order_by=["o_orderkey"])


_DUP_SQL = """SELECT 'user_id,event_type' AS subset, (SELECT count(*) FROM events)
   - (SELECT count(*) FROM (SELECT DISTINCT user_id, event_type FROM events)) AS n_duplicates
UNION ALL
SELECT 'all', (SELECT count(*) FROM events) - (SELECT count(*) FROM (SELECT DISTINCT * FROM events))"""


@query("p10_count_duplicates", _DUP_SQL)
def p10(spark, sf):
    ev = event_pairs(spark, sf)
    full = table(spark, sf, "events")
    a = P.count_duplicates_df(ev, ["user_id", "event_type"]).select(F.lit("user_id,event_type").alias("subset"),
                                                                     "n_duplicates")
    b = P.count_duplicates_df(full).select(F.lit("all").alias("subset"), "n_duplicates")
    return a.unionByName(b)

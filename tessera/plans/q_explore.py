"""Registered EDA (G, A1-A8) and evaluation (V1-V9) queries with oracle SQL."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import functions as F

from tessera.operators import evaluate as V
from tessera.operators import explore as X
from tessera.operators.profile import column_facts
from tessera.plans import sqlgen
from tessera.plans.fixtures import (line_binary, line_multi, line_regress, orders_missing, table,
                                    with_fixtures)
from tessera.plans.registry import query, rounded, sql_sig

K4 = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
K4S = ", ".join(K4)


def s8(e):
    return sql_sig(e, 8)


# ------------------------------------------------------------------ G
@query("g1_eligible_targets", f"""SELECT variable, autotype FROM ({sqlgen.autotype_table_sql("lineitem")})
  WHERE autotype IN ('Continuous', 'Binary', 'Categorical', 'Boolean')""")
def g1(spark, sf):
    return X.eligible_targets(table(spark, sf, "lineitem"))


_G2_TARGETS = ["l_extendedprice", "l_linestatus", "l_returnflag", "l_linenumber", "l_shipdate"]


@query("g2_detect_problem_type", f"""SELECT variable, CASE autotype WHEN 'Continuous' THEN 'regression'
  WHEN 'Binary' THEN 'classification_binary' WHEN 'Categorical' THEN 'classification_multi'
  WHEN 'Boolean' THEN 'classification_binary' END AS problem_type
  FROM ({sqlgen.autotype_table_sql("lineitem")}) WHERE variable IN ({", ".join(repr(t) for t in _G2_TARGETS)})""")
def g2(spark, sf):
    li = table(spark, sf, "lineitem")
    facts = column_facts(li, _G2_TARGETS)
    rows = [(t, X.detect_problem_type(li, t, facts)) for t in _G2_TARGETS]
    return spark.createDataFrame(rows, "variable string, problem_type string")


# ------------------------------------------------------------------ A
@query("a1_value_counts", with_fixtures("""SELECT o_orderpriority AS value, count(*) AS count
  FROM orders_missing GROUP BY 1""", "orders_missing"))
def a1(spark, sf):
    return X.value_counts(orders_missing(spark, sf), "o_orderpriority")


@query("a2_moments", f"""SELECT 'l_extendedprice' AS variable, count(l_extendedprice) AS n,
  {s8("avg(l_extendedprice)")} AS mean, {s8("quantile_cont(l_extendedprice, 0.5)")} AS median,
  {s8("skewness(l_extendedprice)")} AS skewness, {s8("kurtosis(l_extendedprice)")} AS kurtosis FROM lineitem""")
def a2(spark, sf):
    return rounded(X.moments(table(spark, sf, "lineitem"), "l_extendedprice"), 8)


@query("a3_histogram", """WITH mm AS (SELECT min(l_quantity) mn, max(l_quantity) mx, (max(l_quantity) - min(l_quantity)) / 30 w
  FROM lineitem),
c AS (SELECT least(floor((l_quantity - mn) / w), 29)::INTEGER AS bin, count(*) AS cnt FROM lineitem, mm GROUP BY 1)
SELECT g.range::INTEGER AS bin, mn + g.range * w AS lo, mn + (g.range + 1) * w AS hi, coalesce(cnt, 0)::BIGINT AS count
FROM range(30) g CROSS JOIN mm LEFT JOIN c ON c.bin = g.range""")
def a3(spark, sf):
    return X.histogram(table(spark, sf, "lineitem"), "l_quantity", 30)


@query("a4_kde", f"""WITH s AS (SELECT count(l_quantity) n, stddev_samp(l_quantity) sd, min(l_quantity) a,
  max(l_quantity) b FROM lineitem),
g AS (SELECT range::INTEGER AS point, CASE WHEN range = 499 THEN b ELSE range * ((b - a) / 499) + a END AS x,
  sd * pow(n, -0.2) AS h, n FROM range(500), s),
v AS (SELECT l_quantity AS v, count(*) AS c FROM lineitem GROUP BY 1)
SELECT point, x, {s8("sum(c * exp(-0.5 * pow((x - v) / h, 2))) * (1.0 / (any_value(n) * any_value(h) * sqrt(2 * pi())))")}
  AS density FROM g, v GROUP BY point, x""")
def a4(spark, sf):
    return rounded(X.kde(table(spark, sf, "lineitem"), "l_quantity", 500), 8)


@query("a4_kde_continuous", f"""WITH s AS (SELECT count(o_totalprice) n, stddev_samp(o_totalprice) sd, min(o_totalprice) a,
  max(o_totalprice) b FROM orders),
g AS (SELECT range::INTEGER AS point, CASE WHEN range = 499 THEN b ELSE range * ((b - a) / 499) + a END AS x,
  sd * pow(n, -0.2) AS h, n FROM range(500), s)
SELECT point, {s8("any_value(x)")} AS x, {s8("sum(exp(-0.5 * pow((g.x - o_totalprice) / h, 2))) * (1.0 / (any_value(n) * any_value(h) * sqrt(2 * pi())))")}
  AS density FROM g, orders GROUP BY point""")
def a4_continuous(spark, sf):
    return rounded(X.kde(table(spark, sf, "orders"), "o_totalprice", 500), 8)


@query("a4_kde_binned", f"""WITH s AS (SELECT count(o_totalprice) n, min(o_totalprice) a, max(o_totalprice) b,
  stddev_samp(o_totalprice) * pow(count(o_totalprice), -0.2) AS h FROM orders),
v AS (SELECT (o_totalprice - a) / (h / 32) AS u FROM orders, s WHERE o_totalprice IS NOT NULL),
j AS (SELECT floor(u) AS j, 1 - (u - floor(u)) AS w FROM v UNION ALL SELECT floor(u) + 1, u - floor(u) FROM v),
bins AS (SELECT j, sum(w) AS w FROM j GROUP BY j),
g AS (SELECT range::INTEGER AS point, range * ((b - a) / 499) AS m, s.* FROM range(500), s)
SELECT point, {s8("any_value(CASE WHEN point = 499 THEN b ELSE m + a END)")} AS x,
  {s8("coalesce(sum(w * exp(-0.5 * pow((m - j * (h / 32)) / h, 2))) FILTER (WHERE abs(m - j * (h / 32)) <= (5 + 0.5 / 32) * h), 0) / (any_value(n) * any_value(h) * sqrt(2 * pi()))")}
  AS density, {s8("any_value((1.0 / (8 * 32 * 32) + exp(-12.5)) / (h * sqrt(2 * pi())))")} AS bound
FROM g, bins GROUP BY point""")
def a4_binned(spark, sf):
    return rounded(X.kde_binned(table(spark, sf, "orders"), "o_totalprice", 500), 8)


_BOX_Q = """(SELECT quantile_cont(l_extendedprice, 0.25) q1, quantile_cont(l_extendedprice, 0.5) med,
  quantile_cont(l_extendedprice, 0.75) q3 FROM lineitem) q"""


@query("a5_box_stats", f"""SELECT 'l_extendedprice' AS variable, {s8("any_value(q1)")} AS q1, {s8("any_value(med)")} AS median,
  {s8("any_value(q3)")} AS q3,
  min(l_extendedprice) FILTER (WHERE l_extendedprice >= q1 - 1.5 * (q3 - q1)) AS lower_whisker,
  max(l_extendedprice) FILTER (WHERE l_extendedprice <= q3 + 1.5 * (q3 - q1)) AS upper_whisker,
  count(*) FILTER (WHERE l_extendedprice < q1 - 1.5 * (q3 - q1) OR l_extendedprice > q3 + 1.5 * (q3 - q1)) AS n_outliers,
  min(l_extendedprice) AS min, max(l_extendedprice) AS max FROM lineitem, {_BOX_Q}""")
def a5(spark, sf):
    return _round_cols(X.box_stats(table(spark, sf, "lineitem"), "l_extendedprice"), ["q1", "median", "q3"])


def _round_cols(d, cols):
    from tessera.plans.registry import round_sig
    return d.withColumns({c: round_sig(c, 8) for c in cols})


@query("a5_box_outliers", f"""SELECT {K4S}, l_extendedprice FROM lineitem, {_BOX_Q}
  WHERE l_extendedprice < q1 - 1.5 * (q3 - q1) OR l_extendedprice > q3 + 1.5 * (q3 - q1)""")
def a5b(spark, sf):
    return X.box_outliers(table(spark, sf, "lineitem").select(*K4, "l_extendedprice"), "l_extendedprice")


_BOX_QE = """(SELECT quantile_cont(value, 0.25) q1, quantile_cont(value, 0.5) med,
  quantile_cont(value, 0.75) q3 FROM events) q"""


@query("a5_box_stats_events", f"""SELECT 'value' AS variable, {s8("any_value(q1)")} AS q1, {s8("any_value(med)")} AS median,
  {s8("any_value(q3)")} AS q3,
  min(value) FILTER (WHERE value >= q1 - 1.5 * (q3 - q1)) AS lower_whisker,
  max(value) FILTER (WHERE value <= q3 + 1.5 * (q3 - q1)) AS upper_whisker,
  count(*) FILTER (WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) AS n_outliers,
  min(value) AS min, max(value) AS max FROM events, {_BOX_QE}""")
def a5c(spark, sf):
    return _round_cols(X.box_stats(table(spark, sf, "events"), "value"), ["q1", "median", "q3"])


@query("a5_box_outliers_events", f"""SELECT event_id, value FROM events, {_BOX_QE}
  WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)""")
def a5d(spark, sf):
    return X.box_outliers(table(spark, sf, "events").select("event_id", "value"), "value")


_QQ_M = 100
_QQ_P = [(i - 0.5) / _QQ_M for i in range(1, _QQ_M + 1)]
_QQ_T = [NormalDist().inv_cdf(p) for p in _QQ_P]


@query("a6_qq_points", f"""WITH q AS (SELECT quantile_cont(l_extendedprice, [{", ".join(f"{p!r}::DOUBLE" for p in _QQ_P)}]) AS qs
  FROM lineitem), t AS (SELECT * FROM (VALUES {", ".join(f"({i + 1}, {p!r}::DOUBLE, {th!r}::DOUBLE)"
                                                          for i, (p, th) in enumerate(zip(_QQ_P, _QQ_T)))})
  AS v(i, prob, theoretical))
SELECT i::INTEGER AS i, {s8("prob")} AS prob, {s8("theoretical")} AS theoretical, {s8("qs[i]")} AS sample FROM t, q""")
def a6(spark, sf):
    return rounded(X.qq_points(table(spark, sf, "lineitem"), "l_extendedprice", _QQ_M), 8)


_PAIR_COLS = ["l_quantity", "l_extendedprice", "l_discount"]


def _pair_sql(bins=10):
    mm = ", ".join(f"min({c}) mn_{c}, max({c}) mx_{c}" for c in _PAIR_COLS)
    b = {c: f"least(floor(({c} - mn_{c}) / ((mx_{c} - mn_{c}) / {bins})), {bins - 1})::INTEGER" for c in _PAIR_COLS}
    parts = []
    for i, xc in enumerate(_PAIR_COLS):
        for yc in _PAIR_COLS[i:]:
            parts.append(f"SELECT '{xc}' AS x_var, '{yc}' AS y_var, {b[xc]} AS bin_x, {b[yc]} AS bin_y, "
                         f"l_returnflag AS hue FROM lineitem, mm")
    return (f"WITH mm AS (SELECT {mm} FROM lineitem) SELECT x_var, y_var, bin_x, bin_y, hue, count(*) AS count FROM ("
            + " UNION ALL ".join(parts) + ") GROUP BY ALL")


@query("a7_pair_grid", _pair_sql())
def a7(spark, sf):
    return X.pair_grid(table(spark, sf, "lineitem"), _PAIR_COLS, hue="l_returnflag", bins=10)


@query("a8_standardize", f"""SELECT {K4S},
  {s8("(l_quantity - avg(l_quantity) OVER ()) / CASE WHEN stddev_pop(l_quantity) OVER () = 0 THEN 1 ELSE stddev_pop(l_quantity) OVER () END")} AS l_quantity,
  {s8("(l_extendedprice - avg(l_extendedprice) OVER ()) / CASE WHEN stddev_pop(l_extendedprice) OVER () = 0 THEN 1 ELSE stddev_pop(l_extendedprice) OVER () END")} AS l_extendedprice
  FROM lineitem""")
def a8(spark, sf):
    li = table(spark, sf, "lineitem").select(*K4, "l_quantity", "l_extendedprice")
    return rounded(X.standardize(li, ["l_quantity", "l_extendedprice"]), 8)


# ------------------------------------------------------------------ V
_BIN_SQL = """SELECT count(*) FILTER (WHERE y = pred) / count(*) AS accuracy,
  CASE WHEN count(*) FILTER (WHERE pred = 1) = 0 THEN 0 ELSE count(*) FILTER (WHERE y = 1 AND pred = 1) / count(*) FILTER (WHERE pred = 1) END AS precision,
  CASE WHEN count(*) FILTER (WHERE y = 1) = 0 THEN 0 ELSE count(*) FILTER (WHERE y = 1 AND pred = 1) / count(*) FILTER (WHERE y = 1) END AS recall
  FROM line_binary"""


@query("v1_binary_metrics", with_fixtures(f"""SELECT accuracy, precision, recall,
  CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END AS f1
  FROM ({_BIN_SQL})""", "line_binary"))
def v1(spark, sf):
    return V.binary_metrics(line_binary(spark, sf), "y", "pred")


_PER_CLASS_SQL = """cm AS (SELECT a.l AS actual, p.l AS predicted, count(m.y) AS cnt
  FROM (SELECT DISTINCT y AS l FROM line_multi UNION SELECT DISTINCT pred FROM line_multi) a
  CROSS JOIN (SELECT DISTINCT y AS l FROM line_multi UNION SELECT DISTINCT pred FROM line_multi) p
  LEFT JOIN line_multi m ON m.y = a.l AND m.pred = p.l GROUP BY 1, 2),
pc AS (SELECT l.label, coalesce(tp, 0) tp, support, npred,
  CASE WHEN npred = 0 THEN 0 ELSE tp / npred END AS precision, CASE WHEN support = 0 THEN 0 ELSE tp / support END AS recall
  FROM (SELECT actual AS label, sum(cnt) support FROM cm GROUP BY 1) l
  JOIN (SELECT predicted AS label, sum(cnt) npred FROM cm GROUP BY 1) p ON l.label = p.label
  JOIN (SELECT actual AS label, cnt tp FROM cm WHERE actual = predicted) t ON t.label = l.label),
pf AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM pc)"""


@query("v2_multiclass_metrics", with_fixtures(f"""WITH {_PER_CLASS_SQL}
SELECT sum(tp) / sum(support) AS accuracy, avg(f1) AS f1_macro, sum(f1 * support) / sum(support) AS f1_weighted FROM pf""",
                                               "line_multi"))
def v2(spark, sf):
    return V.multiclass_metrics(line_multi(spark, sf), "y", "pred")


@query("v3_confusion_matrix", with_fixtures(f"""WITH {_PER_CLASS_SQL} SELECT actual, predicted, cnt AS count FROM cm""",
                                             "line_multi"))
def v3(spark, sf):
    return V.confusion_matrix(line_multi(spark, sf), "y", "pred")


@query("v4_classification_report", with_fixtures(f"""WITH {_PER_CLASS_SQL}
SELECT label, precision, recall, f1, support FROM pf
UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM pf
UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
  sum(f1 * support) / sum(support), sum(support) FROM pf""", "line_multi"))
def v4(spark, sf):
    return V.classification_report(line_multi(spark, sf), "y", "pred")


_CURVE = """t AS (SELECT score AS threshold, sum(y)::DOUBLE tp, sum(1 - y)::DOUBLE fp FROM line_binary GROUP BY 1),
c AS (SELECT *, sum(tp) OVER (ORDER BY threshold DESC) cum_tp, sum(fp) OVER (ORDER BY threshold DESC) cum_fp FROM t),
tot AS (SELECT sum(y)::DOUBLE P, (count(*) - sum(y))::DOUBLE N FROM line_binary)"""


@query("v5_roc_curve", with_fixtures(f"""WITH {_CURVE}
SELECT 'inf'::DOUBLE AS threshold, 0.0::DOUBLE AS fpr, 0.0::DOUBLE AS tpr
UNION ALL SELECT threshold, cum_fp / N, cum_tp / P FROM c, tot""", "line_binary"))
def v5(spark, sf):
    return V.roc_curve(line_binary(spark, sf), "y", "score")


@query("v5_roc_auc", with_fixtures(f"""WITH {_CURVE}
SELECT {sql_sig("sum(fp / N * (2 * cum_tp - tp) / (2 * P))")} AS roc_auc FROM c, tot""", "line_binary"))
def v5b(spark, sf):
    return rounded(V.roc_auc(line_binary(spark, sf), "y", "score"))


@query("v5_roc_curve_drop_intermediate", with_fixtures(f"""WITH {_CURVE},
l AS (SELECT *, lead(tp) OVER (ORDER BY threshold DESC) AS ntp, lead(fp) OVER (ORDER BY threshold DESC) AS nfp,
  row_number() OVER (ORDER BY threshold DESC) AS pos FROM c)
SELECT 'inf'::DOUBLE AS threshold, 0.0::DOUBLE AS fpr, 0.0::DOUBLE AS tpr
UNION ALL SELECT threshold, cum_fp / N, cum_tp / P FROM l, tot
  WHERE pos = 1 OR ntp IS NULL OR ntp <> tp OR nfp <> fp""", "line_binary"))
def v5c(spark, sf):
    return V.roc_curve(line_binary(spark, sf), "y", "score", drop_intermediate=True)


@query("v6_pr_curve", with_fixtures(f"""WITH {_CURVE}
SELECT threshold, cum_tp / (cum_tp + cum_fp) AS precision, cum_tp / P AS recall FROM c, tot WHERE cum_tp - tp < P
UNION ALL SELECT NULL, 1.0, 0.0""", "line_binary"))
def v6(spark, sf):
    return V.pr_curve(line_binary(spark, sf), "y", "score")


@query("v6_pr_auc", with_fixtures(f"""WITH {_CURVE}
SELECT {sql_sig("sum(tp / P * (cum_tp / (cum_tp + cum_fp) + CASE WHEN cum_tp - tp + cum_fp - fp = 0 THEN 1.0 ELSE (cum_tp - tp) / (cum_tp - tp + cum_fp - fp) END) / 2)")}
  AS pr_auc FROM c, tot WHERE cum_tp - tp < P""", "line_binary"))
def v6b(spark, sf):
    return rounded(V.pr_auc(line_binary(spark, sf), "y", "score"))


@query("v7_regression_metrics", with_fixtures(f"""SELECT {s8("avg((y - pred) * (y - pred))")} AS mse,
  {s8("sqrt(avg((y - pred) * (y - pred)))")} AS rmse, {s8("avg(abs(y - pred))")} AS mae,
  {s8("1 - sum((y - pred) * (y - pred)) / (count(*) * var_pop(y))")} AS r2 FROM line_regress""", "line_regress"))
def v7(spark, sf):
    return rounded(V.regression_metrics(line_regress(spark, sf), "y", "pred"), 8)


@query("v8_actual_vs_predicted", with_fixtures(f"SELECT {K4S}, y AS actual, pred AS predicted FROM line_regress",
                                                "line_regress"))
def v8(spark, sf):
    return V.actual_vs_predicted(line_regress(spark, sf), "y", "pred", keys=K4)


@query("v8_identity_line", with_fixtures("""SELECT least(min(y), min(pred)) AS line_min,
  greatest(max(y), max(pred)) AS line_max FROM line_regress""", "line_regress"))
def v8b(spark, sf):
    return V.identity_line(line_regress(spark, sf), "y", "pred")


@query("v9_residuals", with_fixtures(f"SELECT {K4S}, pred AS predicted, y - pred AS residual FROM line_regress",
                                      "line_regress"))
def v9(spark, sf):
    return V.residuals(line_regress(spark, sf), "y", "pred", keys=K4)

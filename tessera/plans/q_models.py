"""Registered ML queries: preparation (M1-M7), models (L1-L15), search (M5, A11, A12),
PCA (A9, A10) and KNN imputation (I3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import pca as PC
from tessera.operators import search as S
from tessera.operators import select as M
from tessera.operators.models import bayes, estimators, knn, svm
from tessera.plans.fixtures import LINE_KEYS, line_binary, supplier_missing, table, with_fixtures
from tessera.plans.registry import query, round_half_away, round_sig, rounded, sql_sig
from tessera.plans.sqlgen import tree_ctes

MD5_UNIT = "('0x' || substr(md5({}), 1, 8))::BIGINT / 4294967296.0"
CUST_SPLIT = MD5_UNIT.format("'42|' || CAST(c_custkey AS VARCHAR)")
LK = ", ".join(LINE_KEYS)
LINE4 = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def s8(e):
    return sql_sig(e, 8)


def _cust_split(spark, sf):
    c = table(spark, sf, "customer")
    return c.withColumn("_split", M.split_column(["c_custkey"], 0.2, 42))


def _line_split(df):
    return df.withColumn("_split", M.split_column(LINE4, 0.2, 42))


# ------------------------------------------------------------------ M1-M4
@query("m1_train_test_split", f"""SELECT c_custkey, CASE WHEN {CUST_SPLIT} < 0.2 THEN 'test' ELSE 'train' END AS _split
  FROM customer""")
def m1(spark, sf):
    return _cust_split(spark, sf).select("c_custkey", "_split")


@query("m2_fit_apply_scaler", f"""WITH d AS (SELECT *, CASE WHEN {CUST_SPLIT} < 0.2 THEN 'test' ELSE 'train' END AS s
  FROM customer), st AS (SELECT avg(c_acctbal) m1, stddev_pop(c_acctbal) s1, avg(c_nationkey) m2,
  stddev_pop(c_nationkey) s2 FROM d WHERE s = 'train')
SELECT c_custkey, {s8("(c_acctbal - m1) / CASE WHEN s1 = 0 THEN 1 ELSE s1 END")} AS c_acctbal,
  {s8("(c_nationkey - m2) / CASE WHEN s2 = 0 THEN 1 ELSE s2 END")} AS c_nationkey FROM d, st WHERE s = 'test'""")
def m2(spark, sf):
    d = _cust_split(spark, sf)
    stats = M.fit_scaler(d.where("_split = 'train'"), ["c_acctbal", "c_nationkey"])
    return rounded(M.apply_scaler(stats, d.where("_split = 'test'")).select("c_custkey", "c_acctbal", "c_nationkey"), 8)


@query("m3_index_target", f"""SELECT {", ".join(LINE4)}, l_returnflag,
  (dense_rank() OVER (ORDER BY l_returnflag) - 1)::DOUBLE AS _label FROM lineitem""")
def m3(spark, sf):
    li = table(spark, sf, "lineitem").select(*LINE4, "l_returnflag")
    return M.index_target(li, "l_returnflag")[0]


@query("m4_assign_folds", """SELECT c_custkey, ((row_number() OVER (
  ORDER BY ('0x' || substr(md5('42|' || CAST(c_custkey AS VARCHAR)), 1, 8))::BIGINT, c_custkey) - 1) % 5)::INTEGER AS _fold FROM customer""")
def m4(spark, sf):
    return M.assign_folds(table(spark, sf, "customer").select("c_custkey"), ["c_custkey"], 5, seed=42)


@query("m4_assign_folds_stratified", f"""SELECT c_custkey, c_mktsegment, ((row_number() OVER (PARTITION BY c_mktsegment
  ORDER BY ('0x' || substr(md5('42|' || CAST(c_custkey AS VARCHAR)), 1, 8))::BIGINT, c_custkey) - 1) % 5)::INTEGER AS _fold
  FROM customer""")
def m4b(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    return M.assign_folds(c, ["c_custkey"], 5, stratify="c_mktsegment", seed=42)


# ------------------------------------------------------------------ M6, M7 on fold scores from lineitem
_THRESH = [15, 25, 35]
_LINE_KEY_HASH = "('0x' || substr(md5(concat_ws('|', '42', l_orderkey, l_linenumber, l_partkey, l_suppkey)), 1, 8))::BIGINT"
_LINE_ORDER = f"{_LINE_KEY_HASH}, l_orderkey, l_linenumber, l_partkey, l_suppkey"
_LINE_TEST = f"({_LINE_KEY_HASH} / 4294967296.0 < 0.2)"
_FOLD_SQL = f"lf AS (SELECT *, ((row_number() OVER (ORDER BY {_LINE_ORDER}) - 1) % 5)::INTEGER AS fold FROM lineitem), fs AS (" + " UNION ALL ".join(
    f"SELECT 'threshold={t}' AS params, fold, 'accuracy' AS metric, "
    f"avg(((l_quantity > {t}) = (l_returnflag = 'R'))::INTEGER) AS score FROM lf GROUP BY 2"
    for t in _THRESH) + ")"


def _fold_scores(spark, sf):
    li = table(spark, sf, "lineitem")
    f = M.assign_folds(li, LINE4, 5, seed=42)
    out = None
    for t in _THRESH:
        s = f.groupBy("_fold").agg(F.avg(((F.col("l_quantity") > t) == (F.col("l_returnflag") == "R"))
                                         .cast("double")).alias("score"))
        s = s.select(F.lit(f"threshold={t}").alias("params"), F.col("_fold").alias("fold"),
                     F.lit("accuracy").alias("metric"), "score")
        out = s if out is None else out.unionByName(s)
    return out


@query("m6_cv_summary", f"""WITH {_FOLD_SQL}, st AS (SELECT params, metric, avg(score) AS mean, stddev_pop(score) AS std
  FROM fs GROUP BY 1, 2), best AS (SELECT params FROM st WHERE metric = 'accuracy' ORDER BY mean DESC, params LIMIT 1)
SELECT st.params, metric, {sql_sig("mean")} AS mean, {s8("std")} AS std FROM st JOIN best ON st.params = best.params""")
def m6(spark, sf):
    r = M.cv_summary(_fold_scores(spark, sf), "accuracy")
    return r.withColumns({"mean": round_sig("mean"), "std": round_sig("std", 8)})


@query("m7_cv_results_table", f"""WITH {_FOLD_SQL}, st AS (SELECT params, avg(score) AS mean, stddev_pop(score) AS std
  FROM fs WHERE metric = 'accuracy' GROUP BY 1)
SELECT rank() OVER (ORDER BY mean DESC) AS rank, {sql_sig("mean")} AS mean, {s8("std")} AS std, params FROM st""")
def m7(spark, sf):
    r = M.cv_results_table(_fold_scores(spark, sf), "accuracy")
    return r.withColumns({"mean": round_sig("mean"), "std": round_sig("std", 8)})


# ------------------------------------------------------------------ L8 naive Bayes (aggregates -> SQL)
@query("l8_gaussian_nb", with_fixtures(f"""WITH g AS (SELECT 1e-9 * greatest(var_pop(l_quantity), var_pop(l_discount)) eps,
  count(*)::DOUBLE nt FROM line_binary),
c AS (SELECT y AS cls, count(*)::DOUBLE n, avg(l_quantity) m1, var_pop(l_quantity) v1, avg(l_discount) m2,
  var_pop(l_discount) v2 FROM line_binary GROUP BY y),
j AS (SELECT {LK}, cls, ln(n / nt) - 0.5 * (ln(2 * pi() * (v1 + eps)) + ln(2 * pi() * (v2 + eps)))
  - 0.5 * (pow(l_quantity - m1, 2) / (v1 + eps) + pow(l_discount - m2, 2) / (v2 + eps)) AS jll FROM line_binary, c, g)
SELECT {LK}, cls AS prediction FROM (SELECT *, row_number() OVER (PARTITION BY {LK} ORDER BY jll DESC, cls) rn FROM j)
WHERE rn = 1""", "line_binary"))
def l8(spark, sf):
    d = line_binary(spark, sf)
    fm = bayes.gaussian_nb(d, "y", ["l_quantity", "l_discount"], "classification_binary", scale=False)
    return fm.transform(d).select(*LINE_KEYS, "prediction")


# ------------------------------------------------------------------ L1, L2 KNN on customer
def _knn_sql(target, feats, k, classify):
    sel = ", ".join(feats)
    stats = ", ".join(f"avg({f}) m_{f}, stddev_pop({f}) s_{f}" for f in feats)
    z = ", ".join(f"({f} - m_{f}) / CASE WHEN s_{f} = 0 THEN 1 ELSE s_{f} END AS z_{f}" for f in feats)
    dist = " + ".join(f"pow(t.z_{f} - r.z_{f}, 2)" for f in feats)
    head = f"""WITH d AS (SELECT c_custkey, {target} AS y, {sel}, CASE WHEN {CUST_SPLIT} < 0.2 THEN 'test' ELSE 'train' END AS s
  FROM customer), st AS (SELECT {stats} FROM d WHERE s = 'train'),
z AS (SELECT c_custkey, y, s, {z} FROM d, st),
p AS (SELECT t.c_custkey AS id, r.c_custkey AS rid, r.y, sqrt({dist}) AS dist FROM z t JOIN z r ON t.s = 'test' AND r.s = 'train'),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, rid) rn FROM p) WHERE rn <= {k})"""
    if classify:
        return head + """, v AS (SELECT id, y, count(*) c FROM top GROUP BY 1, 2)
SELECT id AS c_custkey, y AS prediction FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY c DESC, y) rn FROM v)
WHERE rn = 1"""
    return head + f"\nSELECT id AS c_custkey, {s8('avg(y)')} AS prediction FROM top GROUP BY id"


@query("l1_knn_classify", _knn_sql("c_mktsegment", ["c_acctbal", "c_nationkey"], 5, True))
def l1(spark, sf):
    d = _cust_split(spark, sf)
    fm = knn.knn_fit(d.where("_split = 'train'"), "c_mktsegment", ["c_acctbal", "c_nationkey"],
                     "classification_multi", "c_custkey", n_neighbors=5)
    return fm.transform(d.where("_split = 'test'")).select("c_custkey", "prediction")


@query("l2_knn_regress", _knn_sql("c_acctbal", ["c_nationkey", "c_custkey"], 5, False))
def l2(spark, sf):
    d = _cust_split(spark, sf)
    fm = knn.knn_fit(d.where("_split = 'train'"), "c_acctbal", ["c_nationkey", "c_custkey"], "regression",
                     "c_custkey", n_neighbors=5)
    return rounded(fm.transform(d.where("_split = 'test'")).select("c_custkey", "prediction"), 8)


# ------------------------------------------------------------------ I3 KNN imputation on supplier_missing
@query("i3_impute_knn", with_fixtures(f"""WITH r AS (SELECT * FROM supplier_missing WHERE s_acctbal IS NULL),
dn AS (SELECT * FROM supplier_missing WHERE s_acctbal IS NOT NULL),
p AS (SELECT r.s_suppkey AS id, dn.s_suppkey AS rid, dn.s_acctbal AS v,
  sqrt(1.5 * (pow(r.s_suppkey - dn.s_suppkey, 2) + pow(r.s_nationkey - dn.s_nationkey, 2))) AS dist FROM r, dn),
f AS (SELECT id, avg(v) AS fill FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, rid) rn FROM p)
  WHERE rn <= (SELECT least(8, greatest(1, count(*) - 1)) FROM supplier_missing) GROUP BY id)
SELECT s_suppkey, s_nationkey, {sql_sig("coalesce(s_acctbal, fill)")} AS s_acctbal
FROM supplier_missing LEFT JOIN f ON f.id = s_suppkey""", "supplier_missing"))
def i3(spark, sf):
    return rounded(knn.impute_knn(supplier_missing(spark, sf), "s_suppkey", "s_acctbal",
                                  ["s_suppkey", "s_nationkey"], k=8))


# ------------------------------------------------------------------ L9 OLS (one feature -> regr_*)
@query("l9_linear_regression", f"""SELECT {", ".join(LINE4)}, {s8("regr_intercept(l_extendedprice, l_quantity) OVER () + regr_slope(l_extendedprice, l_quantity) OVER () * l_quantity")}
  AS prediction FROM lineitem""")
def l9(spark, sf):
    li = table(spark, sf, "lineitem")
    fm = estimators.linear_regression(li, "l_extendedprice", ["l_quantity"])
    return rounded(fm.transform(li.select(*LINE4, "l_quantity")).select(*LINE4, "prediction"), 8)


# ------------------------------------------------------------------ MLlib fits (rows-only checks)
_BIN_FEATS = ["l_quantity", "l_discount", "l_extendedprice"]
_MULTI_FEATS = ["l_quantity", "l_discount", "l_tax", "l_extendedprice"]
_REG_FEATS = ["l_quantity", "l_discount", "l_tax"]


def _bin_split(spark, sf):
    return _line_split(line_binary(spark, sf))


@query("l3_random_forest_classify")
def l3(spark, sf):
    d = _bin_split(spark, sf)
    fm = estimators.random_forest(d.where("_split = 'train'"), "y", _BIN_FEATS, "classification_binary",
                                  key=LINE4, n_estimators=100, max_depth=10, min_samples_split=2)
    return fm.transform(d.where("_split = 'test'")).select(*LINE4, "y", "prediction", "score")


@query("l4_random_forest_regress")
def l4(spark, sf):
    d = _line_split(table(spark, sf, "lineitem"))
    fm = estimators.random_forest(d.where("_split = 'train'"), "l_extendedprice", _REG_FEATS, "regression",
                                  key=LINE4, n_estimators=100, max_depth=10)
    return fm.transform(d.where("_split = 'test'")).select(*LINE4, "l_extendedprice", "prediction")


@query("l5_svm_classify")
def l5(spark, sf):
    d = _bin_split(spark, sf)
    fm = svm.svm_classify(d.where("_split = 'train'"), "y", _BIN_FEATS, "classification_binary", C=1.0,
                          kernel="rbf")
    return fm.transform(d.where("_split = 'test'")).select(*LINE4, "y", "prediction", "score")


@query("l6_svm_regress")
def l6(spark, sf):
    d = _line_split(table(spark, sf, "lineitem"))
    fm = svm.svm_regress(d.where("_split = 'train'"), "l_extendedprice", _REG_FEATS, C=1.0, kernel="linear")
    return fm.transform(d.where("_split = 'test'")).select(*LINE4, "l_extendedprice", "prediction")


def _logistic_sql(c: float, steps: int = 8) -> str:
    """Newton's method written out: each step sums gradient and Hessian of C * loss + |w|^2 / 2 and solves the 4 x 4 system by elimination."""
    k = range(4)
    z = ["1.0::DOUBLE"] + [f"((d.{f} - m{i}) / v{i})" for i, f in enumerate(_BIN_FEATS, 1)]
    stats = ", ".join(f"avg({f}) AS m{i}, stddev_pop({f}) AS v{i}" for i, f in enumerate(_BIN_FEATS, 1))
    ctes = [f"st AS (SELECT {stats} FROM line_binary WHERE NOT {_LINE_TEST})",
            f"x AS (SELECT {', '.join(f'{e} AS x{i}' for i, e in enumerate(z))}, y FROM line_binary d, st WHERE NOT {_LINE_TEST})",
            "w0 AS (SELECT 0.0::DOUBLE AS w0, 0.0::DOUBLE AS w1, 0.0::DOUBLE AS w2, 0.0::DOUBLE AS w3)"]
    for s in range(steps):
        p = "1 / (1 + exp(-(" + " + ".join(f"w{i} * x{i}" for i in k) + ")))"
        sums = [f"{c} * sum((p - y) * x{i}) + {'0' if i == 0 else f'any_value(w{i})'} AS g{i}" for i in k]
        sums += [f"{c} * sum(p * (1 - p) * x{i} * x{j}) + {int(i == j and i > 0)} AS h{i}{j}" for i in k for j in k if j >= i]
        ctes.append(f"n{s} AS (SELECT {', '.join(sums)}, {', '.join(f'any_value(w{i}) AS w{i}' for i in k)} FROM (SELECT *, {p} AS p FROM x, w{s}))")
        # H = L D L': then forward, diagonal and backward substitution
        e = []
        for j in k:
            e.append(f"h{j}{j}" + "".join(f" - l{j}{m} * l{j}{m} * d{m}" for m in range(j)) + f" AS d{j}")
            e += [f"(h{j}{i}" + "".join(f" - l{i}{m} * l{j}{m} * d{m}" for m in range(j)) + f") / d{j} AS l{i}{j}" for i in range(j + 1, 4)]
        e += [f"g{i}" + "".join(f" - l{i}{m} * f{m}" for m in range(i)) + f" AS f{i}" for i in k]
        e += [f"f{i} / d{i}" + "".join(f" - l{m}{i} * b{m}" for m in range(i + 1, 4)) + f" AS b{i}" for i in reversed(k)]
        nested = f"n{s}"
        for at, column in enumerate(e):
            nested = f"(SELECT *, {column} FROM {nested}) AS q{at}"
        ctes.append(f"w{s + 1} AS (SELECT {', '.join(f'w{i} - b{i} AS w{i}' for i in k)} FROM {nested})")
    score = "1 / (1 + exp(-(" + " + ".join(f"w{i} * {e}" for i, e in enumerate(z)) + ")))"
    return f"""WITH {", ".join(ctes)}, t AS (SELECT {", ".join(LINE4)}, y, {score} AS score FROM line_binary d, st, w{steps} WHERE {_LINE_TEST})
SELECT {", ".join(LINE4)}, y, {sql_sig("score", 7)} AS score FROM t"""


@query("l7_logistic_newton", with_fixtures(_logistic_sql(1.0), "line_binary"))
def l7_newton(spark, sf):
    d = _bin_split(spark, sf)
    fm = estimators.logistic_regression(d.where("_split = 'train'"), "y", _BIN_FEATS, "classification_binary", C=1.0, penalty="l2")
    return fm.transform(d.where("_split = 'test'")).select(*LINE4, "y", round_sig("score", 7).alias("score"))


@query("l7_logistic_multi_balance", f"""SELECT l_returnflag, count(*)::DOUBLE AS n, {", ".join(s8(f"sum({f})") + f" AS sum_{f}" for f in _MULTI_FEATS)}
  FROM lineitem GROUP BY l_returnflag""")
def l7_balance(spark, sf):
    """At the maximum without a penalty, each class's probabilities add up to its rows and its weighted feature sums to its rows' sums."""
    li = table(spark, sf, "lineitem").select(*LINE4, "l_returnflag", *_MULTI_FEATS)
    fm = estimators.logistic_regression(li, "l_returnflag", _MULTI_FEATS, "classification_multi", penalty=None)
    each = fm.transform(li).select(*_MULTI_FEATS, F.posexplode("probability").alias("at", "p"))
    sums = each.groupBy("at").agg(F.round(F.sum("p"), 3).alias("n"), *[F.sum(F.col("p") * F.col(f)).alias(f"sum_{f}") for f in _MULTI_FEATS])
    label = F.array(*[F.lit(v) for v in fm.labels])
    return sums.select(F.get(label, F.col("at")).alias("l_returnflag"), "n", *[round_sig(f"sum_{f}", 8).alias(f"sum_{f}") for f in _MULTI_FEATS])


@query("l7_logistic_regression")
def l7(spark, sf):
    d = _bin_split(spark, sf)
    fm = estimators.logistic_regression(d.where("_split = 'train'"), "y", _BIN_FEATS, "classification_binary",
                                        C=1.0, penalty="l2")
    return fm.transform(d.where("_split = 'test'")).select(*LINE4, "y", "prediction", "score")


@query("l7_logistic_regression_multi")
def l7b(spark, sf):
    d = _line_split(table(spark, sf, "lineitem"))
    fm = estimators.logistic_regression(d.where("_split = 'train'"), "l_returnflag", _MULTI_FEATS,
                                        "classification_multi", C=1.0)
    return fm.transform(d.where("_split = 'test'")).select(*LINE4, "l_returnflag", "prediction")


def _normal_equations(alpha: float, where: str = "true") -> str:
    """CTEs: ``st`` (means, deviations), ``b`` (standardised coefficients b1..b3 of price on the three features).

    (R + alpha / n I) b = r sd(y), solved by Cramer's rule.
    """
    x = dict(zip("123", _REG_FEATS))
    y = "l_extendedprice"
    stats = ", ".join([f"avg({y}) my, stddev_pop({y}) sy, count(*)::DOUBLE n"]
                      + [f"avg({c}) m{i}, stddev_pop({c}) s{i}, corr({c}, {y}) r{i}" for i, c in x.items()]
                      + [f"corr({x[i]}, {x[j]}) c{i}{j}" for i, j in ("12", "13", "23")])

    def det(m):
        (a, b, c), (d, e, f), (g, h, i) = m
        return f"({a} * ({e} * {i} - {f} * {h}) - {b} * ({d} * {i} - {f} * {g}) + {c} * ({d} * {h} - {e} * {g}))"

    rows = [["g", "c12", "c13"], ["c12", "g", "c23"], ["c13", "c23", "g"]]
    solved = [det([[f"r{i + 1}" if j == k else v for j, v in enumerate(row)] for i, row in enumerate(rows)]) for k in range(3)]
    return f"""st0 AS (SELECT {stats} FROM lineitem WHERE {where}), st AS (SELECT *, 1 + {alpha} / n AS g FROM st0),
b AS (SELECT {", ".join(f"sy * {s} / {det(rows)} AS b{k + 1}" for k, s in enumerate(solved))} FROM st)"""


_RIDGE_PREDICTION = "my + " + " + ".join(f"b{i} * ({c} - m{i}) / s{i}" for i, c in enumerate(_REG_FEATS, 1))


@query("l11_ridge", f"""WITH {_normal_equations(1.0, f"NOT {_LINE_TEST}")}
SELECT {", ".join(LINE4)}, l_extendedprice, {sql_sig(_RIDGE_PREDICTION, 6)} AS prediction FROM lineitem, st, b WHERE {_LINE_TEST}""")
def l11(spark, sf):
    d = _line_split(table(spark, sf, "lineitem"))
    fm = estimators.ridge(d.where("_split = 'train'"), "l_extendedprice", _REG_FEATS, alpha=1.0)
    return fm.transform(d.where("_split = 'test'")).select(*LINE4, "l_extendedprice", round_sig("prediction", 6).alias("prediction"))


def _lasso_sql(alpha: float) -> str:
    """The minimum, found among the 27 sign patterns of three coefficients by its optimality conditions."""
    signs = ", ".join(f"({a}, {b}, {c})" for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1))
    m = [[f"(CASE WHEN z{i} = 0 THEN {int(i == j)} ELSE c{min(i, j)}{max(i, j)} END)" for j in (1, 2, 3)] for i in (1, 2, 3)]
    rhs = [f"(CASE WHEN z{i} = 0 THEN 0 ELSE r{i} * sy - {alpha} * z{i} END)" for i in (1, 2, 3)]

    def det(x):
        (a, b, c), (d, e, f), (g, h, i) = x
        return f"({a} * ({e} * {i} - {f} * {h}) - {b} * ({d} * {i} - {f} * {g}) + {c} * ({d} * {h} - {e} * {g}))"

    solved = [det([[rhs[i] if j == k else v for j, v in enumerate(row)] for i, row in enumerate(m)]) for k in range(3)]
    optimal = " AND ".join(f"CASE WHEN z{i} = 0 THEN abs(r{i} * sy - c{min(i, 1)}{max(i, 1)} * b1 - c{min(i, 2)}{max(i, 2)} * b2 - c{min(i, 3)}{max(i, 3)} * b3)"
                           f" <= {alpha} ELSE sign(b{i}) = z{i} END" for i in (1, 2, 3))
    moments = _normal_equations(0.0, f"NOT {_LINE_TEST}").split(",\nb AS")[0]
    return f"""WITH {moments}, sg(z1, z2, z3) AS (VALUES {signs}),
e AS (SELECT *, 1 AS c11, 1 AS c22, 1 AS c33 FROM st, sg), f AS (SELECT *, {det(m)} AS whole FROM e),
g AS (SELECT *, {", ".join(f"{x} / whole AS b{k + 1}" for k, x in enumerate(solved))} FROM f),
b AS (SELECT b1, b2, b3 FROM g WHERE {optimal} LIMIT 1)
SELECT {", ".join(LINE4)}, l_extendedprice, {sql_sig(_RIDGE_PREDICTION, 8)} AS prediction FROM lineitem, st, b WHERE {_LINE_TEST}"""


@query("l10_lasso", _lasso_sql(1.0))
def l10(spark, sf):
    d = _line_split(table(spark, sf, "lineitem"))
    fm = estimators.lasso(d.where("_split = 'train'"), "l_extendedprice", _REG_FEATS, alpha=1.0)
    return fm.transform(d.where("_split = 'test'")).select(*LINE4, "l_extendedprice", round_sig("prediction", 8).alias("prediction"))


@query("l10_lasso_sparse", _lasso_sql(300.0))
def l10_sparse(spark, sf):
    """A penalty that sets coefficients to zero."""
    d = _line_split(table(spark, sf, "lineitem"))
    fm = estimators.lasso(d.where("_split = 'train'"), "l_extendedprice", _REG_FEATS, alpha=300.0)
    return fm.transform(d.where("_split = 'test'")).select(*LINE4, "l_extendedprice", round_sig("prediction", 8).alias("prediction"))


def _stump_sql(y: str, value: str) -> str:
    """Best single split of ``y`` on l_discount (least squares), as the rows' side means (``value``: SQL over ``m``)."""
    return f"""WITH v AS (SELECT l_discount AS d, count(*)::DOUBLE c, sum({y})::DOUBLE s FROM lineitem GROUP BY 1),
cut AS (SELECT d, sum(c) OVER w AS nl, sum(s) OVER w AS sl, sum(c) OVER () AS n, sum(s) OVER () AS s
  FROM v WINDOW w AS (ORDER BY d ROWS UNBOUNDED PRECEDING)),
best AS (SELECT d, sl / nl AS lm, (s - sl) / (n - nl) AS rm FROM cut WHERE nl < n
  ORDER BY sl * sl / nl + (s - sl) * (s - sl) / (n - nl) DESC, d LIMIT 1),
p AS (SELECT {", ".join(LINE4)}, CASE WHEN l_discount <= d THEN lm ELSE rm END AS m FROM lineitem, best)
SELECT {", ".join(LINE4)}, {sql_sig(value, 8)} AS value FROM p"""


@query("l13_boosted_trees_stump", _stump_sql("l_extendedprice", "m"))
def l13_stump(spark, sf):
    """One boosting step of depth 1 is the best least-squares split."""
    li = table(spark, sf, "lineitem").select(*LINE4, "l_discount", "l_extendedprice")
    fm = estimators.boosted_trees_mllib(li, "l_extendedprice", ["l_discount"], "regression", n_estimators=1, max_depth=1)
    return rounded(fm.transform(li).select(*LINE4, F.col("prediction").alias("value")), 8)


@query("l12_boosted_trees_stump", _stump_sql("2 * (l_returnflag = 'R')::INTEGER - 1", "1 / (1 + exp(-2 * m))"))
def l12_stump(spark, sf):
    """The first boosting step fits labels -1 and 1; the log-odds are twice its value."""
    li = table(spark, sf, "lineitem").select(*LINE4, "l_discount", (F.col("l_returnflag") == "R").cast("int").alias("y"))
    fm = estimators.boosted_trees_mllib(li, "y", ["l_discount"], "classification_binary", n_estimators=1, max_depth=1)
    return rounded(fm.transform(li).select(*LINE4, F.col("score").alias("value")), 8)


_SMALL_FEATS = ["l_quantity", "l_discount", "l_tax"]   # at most 256 values each, so bins lose no cut


def _forest_tree_sql(src: str, keys: str, stats: dict[str, str], score, impure: str, value: str) -> str:
    """One tree of depth 3 over all rows, without resampling."""
    ctes = tree_ctes("a", src, _SMALL_FEATS, stats, score, 3, node_ok=impure)
    sums = ", ".join(f"sum({e}) AS {k}" for k, e in stats.items())
    return f"""WITH {ctes}, leaf AS (SELECT node, {sums} FROM a3 GROUP BY node)
SELECT {keys}, {value} FROM a3 JOIN leaf USING (node)"""


@query("l3_random_forest_tree", _forest_tree_sql(
    "(SELECT *, (l_returnflag = 'R')::INTEGER AS y FROM lineitem)", ", ".join(LINE4), {"c0": "(1 - y)::DOUBLE", "c1": "y::DOUBLE"},
    lambda p: f"({p}c0 * {p}c0 + {p}c1 * {p}c1) / ({p}c0 + {p}c1)", "t_c0 > 0 AND t_c1 > 0 AND t_c0 + t_c1 >= 2", sql_sig("c1 / (c0 + c1)", 8) + " AS value"))
def l3_tree(spark, sf):
    li = table(spark, sf, "lineitem").select(*LINE4, "l_quantity", "l_discount", "l_tax", (F.col("l_returnflag") == "R").cast("int").alias("y"))
    fm = estimators.random_forest(li, "y", _SMALL_FEATS, "classification_binary", key=LINE4, n_estimators=1, max_depth=3, bootstrap=False, max_features=None)
    return rounded(fm.transform(li).select(*LINE4, F.col("score").alias("value")), 8)


@query("l4_random_forest_tree", _forest_tree_sql(
    "(SELECT *, l_extendedprice::DOUBLE AS y FROM lineitem)", ", ".join(LINE4), {"n": "1::DOUBLE", "s": "y"},
    lambda p: f"{p}s * {p}s / {p}n", "t_n >= 2", sql_sig("s / n", 8) + " AS value"))
def l4_tree(spark, sf):
    li = table(spark, sf, "lineitem").select(*LINE4, "l_quantity", "l_discount", "l_tax", "l_extendedprice")
    fm = estimators.random_forest(li, "l_extendedprice", _SMALL_FEATS, "regression", key=LINE4, n_estimators=1, max_depth=3, bootstrap=False)
    return rounded(fm.transform(li).select(*LINE4, F.col("prediction").alias("value")), 8)


def _boosting_sql(src: str, start: str, grads: list[tuple[str, str]], value: str, rounds: int = 2, depth: int = 2, eta: float = 0.1) -> str:
    """``rounds`` rounds of second-order boosting; ``grads`` has (gradient, hessian) of each output over margins m0, m1, ..."""
    m = [f"m{k}" for k in range(len(grads))]
    ctes = [f"r0 AS (SELECT *, row_number() OVER () AS rid, {', '.join(f'({start})::DOUBLE AS {c}' for c in m)} FROM {src})"]
    for r in range(rounds):
        ctes.append(f"g{r} AS (SELECT *, {', '.join(f'{g} AS g_{k}, {h} AS h_{k}' for k, (g, h) in enumerate(grads))} FROM r{r})")
        for k in range(len(grads)):
            p = f"t{r}_{k}_"
            ctes.append(tree_ctes(p, f"g{r}", _SMALL_FEATS, {"g": f"g_{k}", "h": f"h_{k}"}, lambda s: f"{s}g * {s}g / ({s}h + 1)", depth,
                                  valid="l_h >= 1 AND r_h >= 1", node_ok="gain > 1e-6"))
            ctes.append(f"{p}leaf AS (SELECT node, -{eta} * sum(g_{k}) / (sum(h_{k}) + 1) AS w FROM {p}{depth} GROUP BY node)")
        join = " ".join(f"JOIN (SELECT rid, w AS w{k} FROM t{r}_{k}_{depth} JOIN t{r}_{k}_leaf USING (node)) USING (rid)" for k in range(len(grads)))
        ctes.append(f"r{r + 1} AS (SELECT * REPLACE ({', '.join(f'{c} + w{k} AS {c}' for k, c in enumerate(m))}) FROM r{r} {join})")
        if r + 1 < rounds:
            ctes[-1] = ctes[-1].replace("SELECT * REPLACE", f"SELECT * EXCLUDE ({', '.join(f'w{k}' for k in range(len(grads)))}) REPLACE")
    return f"WITH {', '.join(ctes)} SELECT {', '.join(LINE4)}, {value} FROM r{rounds}"


_TWO_ROUNDS = dict(key=LINE4, n_estimators=2, max_depth=2, learning_rate=0.1)


@query("l13_boosted_trees_two_rounds", _boosting_sql(
    "(SELECT *, l_extendedprice::DOUBLE AS y FROM lineitem)", "avg(l_extendedprice) OVER ()", [("(m0 - y)", "1.0::DOUBLE")], sql_sig("m0", 8) + " AS value"))
def l13_two(spark, sf):
    li = table(spark, sf, "lineitem").select(*LINE4, *_SMALL_FEATS, "l_extendedprice")
    fm = estimators.boosted_trees(li, "l_extendedprice", _SMALL_FEATS, "regression", **_TWO_ROUNDS)
    return rounded(fm.transform(li).select(*LINE4, F.col("prediction").alias("value")), 8)


_SIGMOID = "(1 / (1 + exp(-m0)))"


@query("l12_boosted_trees_two_rounds", _boosting_sql(
    "(SELECT *, (l_returnflag = 'R')::DOUBLE AS y FROM lineitem)", "ln(avg((l_returnflag = 'R')::INTEGER) OVER () / (1 - avg((l_returnflag = 'R')::INTEGER) OVER ()))",
    [(f"({_SIGMOID} - y)", f"({_SIGMOID} * (1 - {_SIGMOID}))")], sql_sig(_SIGMOID, 8) + " AS value"))
def l12_two(spark, sf):
    li = table(spark, sf, "lineitem").select(*LINE4, *_SMALL_FEATS, (F.col("l_returnflag") == "R").cast("int").alias("y"))
    fm = estimators.boosted_trees(li, "y", _SMALL_FEATS, "classification_binary", **_TWO_ROUNDS)
    return rounded(fm.transform(li).select(*LINE4, F.col("score").alias("value")), 8)


_SOFTMAX = [f"(exp(m{k}) / (exp(m0) + exp(m1) + exp(m2)))" for k in range(3)]


@query("l12_boosted_trees_multi_two_rounds", _boosting_sql(
    "lineitem", "0", [(f"({p} - (l_returnflag = '{c}')::INTEGER)", f"(2 * {p} * (1 - {p}))") for p, c in zip(_SOFTMAX, "ANR")],
    ", ".join(f"{sql_sig(p, 8)} AS p_{c}" for p, c in zip(_SOFTMAX, "ANR"))))
def l12_multi_two(spark, sf):
    li = table(spark, sf, "lineitem").select(*LINE4, *_SMALL_FEATS, "l_returnflag")
    fm = estimators.boosted_trees(li, "l_returnflag", _SMALL_FEATS, "classification_multi", **_TWO_ROUNDS)
    return rounded(fm.transform(li).select(*LINE4, *[F.col("probability")[k].alias(f"p_{c}") for k, c in enumerate("ANR")]), 8)


@query("l12_boosted_trees_multi")
def l12b(spark, sf):
    d = _line_split(table(spark, sf, "lineitem"))
    fm = estimators.boosted_trees(d.where("_split = 'train'"), "l_returnflag", _MULTI_FEATS, "classification_multi",
                                  key=LINE4, n_estimators=100, max_depth=3, learning_rate=0.1)
    return fm.transform(d.where("_split = 'test'")).select(*LINE4, "l_returnflag", "prediction", "probability")


@query("l5_svm_classify_multi")
def l5b(spark, sf):
    d = _line_split(table(spark, sf, "lineitem"))
    fm = svm.svm_classify(d.where("_split = 'train'"), "l_returnflag", _MULTI_FEATS, "classification_multi", C=1.0,
                          kernel="poly", degree=2, coef0=1.0)
    return fm.transform(d.where("_split = 'test'")).select(*LINE4, "l_returnflag", "prediction", "probability")


@query("l12_boosted_trees_classify")
def l12(spark, sf):
    d = _bin_split(spark, sf)
    fm = estimators.boosted_trees(d.where("_split = 'train'"), "y", _BIN_FEATS, "classification_binary",
                                  key=LINE4, n_estimators=100, max_depth=3, learning_rate=0.1)
    return fm.transform(d.where("_split = 'test'")).select(*LINE4, "y", "prediction", "score")


@query("l13_boosted_trees_regress")
def l13(spark, sf):
    d = _line_split(table(spark, sf, "lineitem"))
    fm = estimators.boosted_trees(d.where("_split = 'train'"), "l_extendedprice", _REG_FEATS, "regression",
                                  key=LINE4, n_estimators=100, max_depth=3, learning_rate=0.1)
    return fm.transform(d.where("_split = 'test'")).select(*LINE4, "l_extendedprice", "prediction")


@query("l14_coefficient_table", f"""WITH {_normal_equations(0.0)}
SELECT 'intercept' AS term, {s8("my")} AS coefficient FROM st
""" + "\n".join(f"UNION ALL SELECT '{c}', {s8(f'b{i}')} FROM b" for i, c in enumerate(_REG_FEATS, 1)))
def l14(spark, sf):
    li = table(spark, sf, "lineitem")
    fm = estimators.linear_regression(li, "l_extendedprice", _REG_FEATS)
    return rounded(estimators.coefficient_table(fm), 8)


def _nb_ctes(feats: list[str], groups: str) -> str:
    """CTEs ``c`` (a row a ``grp`` and class: prior, means, smoothed variances) from ``tr`` (grp, y, features), with
    ``vs`` from ``groups``; features standardised, so the smoothing of a feature is vs times its variance."""
    g = ", ".join(f"var_pop({f}) g{i}" for i, f in enumerate(feats))
    c = ", ".join(f"avg({f}) m{i}, var_pop({f}) v{i}" for i, f in enumerate(feats))
    jll = " - 0.5 * ".join(["ln(n / nt)"] + [f"(ln(2 * pi() * (v{i} / g{i} + vs)) + pow({f} - m{i}, 2) / g{i} / (v{i} / g{i} + vs))"
                                             for i, f in enumerate(feats)])
    return f"""gs AS (SELECT grp, count(*)::DOUBLE nt, {g} FROM tr GROUP BY grp),
cs AS (SELECT grp, y AS cls, count(*)::DOUBLE n, {c} FROM tr GROUP BY grp, y),
c AS (SELECT * FROM gs JOIN cs USING (grp), (VALUES {groups}) AS s(params, vs)),
j AS (SELECT te.*, params, max({jll}) FILTER (cls = 0) AS j0, max({jll}) FILTER (cls = 1) AS j1
  FROM te JOIN c USING (grp) GROUP BY ALL)"""


@query("l15_predict", with_fixtures(f"""WITH tr AS (SELECT 0 AS grp, * FROM line_binary WHERE NOT {_LINE_TEST}),
te AS (SELECT 0 AS grp, {", ".join(LINE4)}, y, {", ".join(_BIN_FEATS)} FROM line_binary WHERE {_LINE_TEST}),
{_nb_ctes(_BIN_FEATS, "('', 1e-9)")}
SELECT {", ".join(LINE4)}, y, (j1 > j0)::INTEGER AS prediction, {sql_sig("1 / (1 + exp(j0 - j1))", 6)} AS score FROM j""", "line_binary"))
def l15(spark, sf):
    d = _bin_split(spark, sf)
    fm = bayes.gaussian_nb(d.where("_split = 'train'"), "y", _BIN_FEATS, "classification_binary")
    return estimators.predict(fm, d.where("_split = 'test'")).select(*LINE4, "y", "prediction", round_sig("score", 6).alias("score"))


# ------------------------------------------------------------------ M5, A11, A12, A9, A10
_NB_FEATS = ["l_quantity", "l_discount"]
_NB_GRID = """('{"var_smoothing": 1e-09}', 1e-9), ('{"var_smoothing": 1e-05}', 1e-5)"""
_NB_SEARCH = f"""lf AS (SELECT *, ((row_number() OVER (PARTITION BY y ORDER BY {_LINE_ORDER}) - 1) % 5)::INTEGER AS fold FROM line_binary),
tr AS (SELECT g.range::INTEGER AS grp, lf.* FROM lf, range(5) g WHERE fold <> g.range),
te AS (SELECT fold AS grp, {", ".join(LINE4)}, y, {", ".join(_NB_FEATS)} FROM lf)"""


_PLANNED = ("knn", "random_forest", "boosted_trees", "svm", "logistic", "naive_bayes", "lasso", "ridge", "linear")
_GRID_SQL = {
    "knn": [f'{{"metric": "euclidean", "n_neighbors": {k}, "weights": "uniform"}}' for k in (3, 5)],
    "random_forest": [f'{{"max_depth": {d}, "min_samples_split": {s}, "n_estimators": {n}}}' for n in (100, 200) for d in (10, 20) for s in (2, 5)],
    "boosted_trees": [f'{{"colsample_bytree": 1.0, "learning_rate": 0.1, "max_depth": {d}, "n_estimators": {n}, "subsample": 1.0}}' for n in (100, 200) for d in (3, 5)],
    "svm": [f'{{"C": {c}, "gamma": "scale", "kernel": "rbf"}}' for c in ("1.0", "10.0")],
    "logistic": ['{"C": 1.0, "penalty": "l2", "solver": "lbfgs"}'], "naive_bayes": ['{"var_smoothing": 1e-09}'],
    "lasso": [f'{{"alpha": {a}}}' for a in (0.1, 1.0)], "ridge": [f'{{"alpha": {a}}}' for a in (0.1, 1.0)], "linear": ["{}"]}
_GRID_VALUES = ", ".join(f"('{m}', '{p}')" for m, ps in _GRID_SQL.items() for p in ps)


@query("m8_param_grid", f"""WITH f AS (SELECT ((row_number() OVER (
  ORDER BY ('0x' || substr(md5('42|' || CAST(c_custkey AS VARCHAR)), 1, 8))::BIGINT, c_custkey) - 1) % 5)::INTEGER AS fold FROM customer),
n AS (SELECT g.range::INTEGER AS fold, count(*) FILTER (f.fold <> g.range) AS train_rows, count(*) FILTER (f.fold = g.range) AS test_rows
  FROM f, range(5) g GROUP BY g.range)
SELECT model, params, fold, train_rows, test_rows FROM (VALUES {_GRID_VALUES}) AS v(model, params), n""")
def m8(spark, sf):
    """The fits that a default search of each family plans: candidate, fold, and the rows of both sides."""
    folds = M.assign_folds(table(spark, sf, "customer").select("c_custkey"), ["c_custkey"], 5, seed=42)
    total = folds.groupBy("_fold").agg(F.count("*").alias("test_rows"))
    grid = [(m, S.json.dumps(p, sort_keys=True)) for m in _PLANNED for p in M.build_param_grid(m)]
    cands = F.array(*[F.struct(F.lit(m).alias("model"), F.lit(p).alias("params")) for m, p in grid])
    sizes = total.join(total.groupBy().agg(F.sum("test_rows").alias("n")))  # a row a fold, one total
    return sizes.select(F.explode(cands).alias("c"), F.col("_fold").alias("fold"), "n", "test_rows").select(
        "c.model", "c.params", "fold", (F.col("n") - F.col("test_rows")).alias("train_rows"), "test_rows")


@query("m5_grid_search", with_fixtures(f"""WITH {_NB_SEARCH},
{_nb_ctes(_NB_FEATS, _NB_GRID)}
SELECT params, grp AS fold, 'accuracy' AS metric, avg(((j1 > j0)::INTEGER = y)::INTEGER) AS score FROM j GROUP BY 1, 2""", "line_binary"))
def m5(spark, sf):
    d = line_binary(spark, sf)
    res, _, _ = S.grid_search(d, "y", ["l_quantity", "l_discount"], "classification_binary", "naive_bayes",
                              M.build_param_grid("naive_bayes", {"var_smoothing": [1e-9, 1e-5]}), LINE4, k=5,
                              refit=False)
    return res


@query("m5_grid_search_logistic")
def m5b(spark, sf):
    d = line_binary(spark, sf)
    grid = M.build_param_grid("logistic", {"C": [0.1, 1.0], "penalty": ["l2"], "solver": ["lbfgs"]})
    res, _, _ = S.grid_search(d, "y", ["l_quantity", "l_discount"], "classification_binary", "logistic", grid,
                              LINE4, k=5, refit=False, parallelism=4)
    return res


_RIDGE_ALPHAS = [0.01, 1.0, 100.0, 10000.0]


def _ridge_search_sql() -> str:
    """Fold scores of every alpha, each fold's coefficients from its own normal equations."""
    x = dict(zip("123", _REG_FEATS))
    y = "l_extendedprice"
    stats = ", ".join(["grp", f"avg({y}) my, stddev_pop({y}) sy, count(*)::DOUBLE n"] + [f"avg({c}) m{i}, stddev_pop({c}) s{i}, corr({c}, {y}) r{i}" for i, c in x.items()]
                      + [f"corr({x[i]}, {x[j]}) c{i}{j}" for i, j in ("12", "13", "23")])

    def det(m):
        (a, b, c), (d, e, f), (g, h, i) = m
        return f"({a} * ({e} * {i} - {f} * {h}) - {b} * ({d} * {i} - {f} * {g}) + {c} * ({d} * {h} - {e} * {g}))"

    rows = [["g", "c12", "c13"], ["c12", "g", "c23"], ["c13", "c23", "g"]]
    solved = [det([[f"r{i + 1}" if j == k else v for j, v in enumerate(row)] for i, row in enumerate(rows)]) for k in range(3)]
    grid = ", ".join(f"""('{{"alpha": {a}}}', {a})""" for a in _RIDGE_ALPHAS)
    return f"""WITH lf AS (SELECT *, ((row_number() OVER (ORDER BY {_LINE_ORDER}) - 1) % 5)::INTEGER AS fold FROM lineitem),
st0 AS (SELECT {stats} FROM (SELECT g.range::INTEGER AS grp, lf.* FROM lf, range(5) g WHERE fold <> g.range) GROUP BY grp),
st AS (SELECT *, 1 + alpha / n AS g FROM st0, (VALUES {grid}) AS v(params, alpha)),
b AS (SELECT *, {", ".join(f"sy * {e} / {det(rows)} AS b{k + 1}" for k, e in enumerate(solved))} FROM st),
p AS (SELECT params, fold, {y} AS y, {_RIDGE_PREDICTION} AS p FROM lf JOIN b ON fold = grp),
e AS (SELECT params, fold, avg(abs(y - p)) AS mae, sqrt(avg((y - p) ** 2)) AS rmse, 1 - sum((y - p) ** 2) / (var_pop(y) * count(*)) AS r2 FROM p GROUP BY 1, 2)
""" + " UNION ALL ".join(f"SELECT params, fold, '{m}' AS metric, {s8(m)} AS score FROM e" for m in ("mae", "rmse", "r2"))


@query("m5_grid_search_ridge", _ridge_search_sql())
def m5c(spark, sf):
    li = table(spark, sf, "lineitem").select(*LINE4, *_REG_FEATS, "l_extendedprice")
    res, _, _ = S.grid_search(li, "l_extendedprice", _REG_FEATS, "regression", "ridge", [{"alpha": a} for a in _RIDGE_ALPHAS], LINE4, k=5, refit=False)
    return rounded(res, 8)


_A11_GRID = ", ".join(f"""('{{"var_smoothing": {t}}}', {v})""" for t, v in (("0.1", 0.1), ("1.0", 1.0), ("30.0", 30.0)))
_A11_HASH = "('0x' || substr(md5(concat_ws('|', '43', l_orderkey, l_linenumber, l_partkey, l_suppkey)), 1, 8))::BIGINT / 4294967296.0"


def _a11_sql() -> str:
    """Two rounds: a third of the rows and three candidates, then all rows and the best one.  Folds are dealt once."""
    def one(r: int, inside: str, grid: str) -> str:
        return f"""r{r} AS (WITH tr AS (SELECT g.range::INTEGER AS grp, lf.* FROM lf, range(5) g WHERE fold <> g.range AND {inside}),
te AS (SELECT fold AS grp, {", ".join(LINE4)}, y, {", ".join(_NB_FEATS)} FROM lf WHERE {inside}),
{_nb_ctes(_NB_FEATS, grid)}
SELECT params, grp AS fold, 'accuracy' AS metric, avg(((j1 > j0)::INTEGER = y)::INTEGER) AS score, {r} AS round FROM j GROUP BY 1, 2)"""

    return f"""WITH lf AS (SELECT *, {_A11_HASH} AS u, (SELECT count(*) FROM line_binary) AS total,
  ((row_number() OVER (PARTITION BY y ORDER BY {_LINE_ORDER}) - 1) % 5)::INTEGER AS fold FROM line_binary),
{one(0, "u < (total // 3) / total", _A11_GRID)},
best AS (SELECT params FROM r0 GROUP BY params ORDER BY round(avg(score), 12) DESC, params LIMIT 1),
{one(1, "true", _A11_GRID)}
SELECT * FROM r0 UNION ALL SELECT r1.* FROM r1 JOIN best USING (params)"""


@query("a11_halving_naive_bayes", with_fixtures(_a11_sql(), "line_binary"))
def a11_nb(spark, sf):
    res, _ = S.halving_search(line_binary(spark, sf), "y", _NB_FEATS, "classification_binary", "naive_bayes",
                              M.build_param_grid("naive_bayes", {"var_smoothing": [0.1, 1.0, 30.0]}), LINE4, k=5)
    return res


@query("a11_halving_search")
def a11(spark, sf):
    d = line_binary(spark, sf)
    res, _ = S.halving_search(d, "y", ["l_quantity", "l_discount"], "classification_binary", "naive_bayes",
                              M.build_param_grid("naive_bayes", {"var_smoothing": [1e-9, 1e-7, 1e-5]}), LINE4, k=5)
    return res


@query("a12_feature_importance")
def a12(spark, sf):
    """The whole grid: 60 forest candidates, 5 folds, successive halving, importances of the winner."""
    c = table(spark, sf, "customer")
    return S.feature_importance(c, "c_acctbal", ["c_nationkey", "c_custkey"], "regression", ["c_custkey"])


@query("a12_feature_importance_classes")
def a12b(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice", F.dayofyear("o_orderdate").alias("o_day"), "o_orderstatus")
    return S.feature_importance(o, "o_orderstatus", ["o_custkey", "o_totalprice", "o_day"], "classification_multi", ["o_orderkey"])


@query("a9_pca")
def a9(spark, sf):
    c = table(spark, sf, "customer")
    return PC.pca(c, "c_custkey", ["c_acctbal", "c_nationkey", "c_custkey"], k=3)


_PCA = ["c_acctbal", "c_nationkey", "c_custkey"]


def _pca_sql() -> str:
    """Scores from the roots of the 3 x 3 correlation matrix's characteristic polynomial, improved by Newton steps; vectors by cross products."""
    pairs = {"a": (0, 1), "b": (0, 2), "c": (1, 2)}
    stats = ", ".join([f"avg({f}) AS m{i}, stddev_pop({f}) AS s{i}" for i, f in enumerate(_PCA)] + [f"corr({_PCA[i]}, {_PCA[j]}) AS {k}" for k, (i, j) in pairs.items()])
    start = ("sqrt((a*a + b*b + c*c) / 3)", "acos(greatest(-1, least(1, a * b * c / pow((a*a + b*b + c*c) / 3, 1.5)))) / 3")
    value = "(t * t * t - (a*a + b*b + c*c) * t - 2 * a * b * c)"   # det(A - (1 + t) I), sign changed
    step = f"t - {value} / (3 * t * t - (a*a + b*b + c*c))"
    roots = "r AS (SELECT st.*, k, 2 * p * cos(phi + k * 2 * pi() / 3) AS t FROM (SELECT *, " + f"{start[0]} AS p, {start[1]} AS phi FROM st) st, (VALUES (0), (1), (2)) AS v(k))"
    polish = "".join(f", r{i + 1} AS (SELECT * REPLACE ({step} AS t) FROM {'r' if i == 0 else f'r{i}'})" for i in range(3))
    # rows of A - (1 + t) I: (-t, a, b), (a, -t, c), (b, c, -t); the longest of the three cross products
    # (-t,a,b)x(a,-t,c); (-t,a,b)x(b,c,-t); (a,-t,c)x(b,c,-t)
    cross = [("a * c + b * t", "a * b + c * t", "t * t - a * a"), ("-a * t - b * c", "b * b - t * t", "-c * t - a * b"), ("t * t - c * c", "b * c + a * t", "a * c + b * t")]
    norm = [f"(({x}) * ({x}) + ({y}) * ({y}) + ({z}) * ({z}))" for x, y, z in cross]
    pick = lambda i: f"CASE WHEN q0 >= q1 AND q0 >= q2 THEN {cross[0][i]} WHEN q1 >= q2 THEN {cross[1][i]} ELSE {cross[2][i]} END"
    big = "CASE WHEN abs(x0) >= abs(x1) AND abs(x0) >= abs(x2) THEN x0 WHEN abs(x1) >= abs(x2) THEN x1 ELSE x2 END"
    score = " + ".join(f"({f} - m{i}) / s{i} * x{i}" for i, f in enumerate(_PCA))
    return f"""WITH st AS (SELECT {stats} FROM customer), {roots}{polish},
q AS (SELECT *, {", ".join(f"{n} AS q{i}" for i, n in enumerate(norm))} FROM r3),
v AS (SELECT *, {", ".join(f"{pick(i)} AS x{i}" for i in range(3))} FROM q),
u AS (SELECT *, sign({big}) / sqrt(x0 * x0 + x1 * x1 + x2 * x2) AS w, row_number() OVER (ORDER BY t DESC) AS comp FROM v),
s AS (SELECT c_custkey, comp, w * ({score}) AS s FROM customer, u)
SELECT c_custkey, {", ".join(f"max(sign(s) * floor(abs(s) * 10000 + 0.5) / 10000) FILTER (comp = {j}) AS pc{j}" for j in (1, 2, 3))} FROM s GROUP BY c_custkey"""


@query("a9_pca_scores", _pca_sql())
def a9_scores(spark, sf):
    c = table(spark, sf, "customer")
    p = PC.pca(c, "c_custkey", _PCA, k=3)
    return p.select("c_custkey", *[round_half_away(f"pc{j}", 4).alias(f"pc{j}") for j in (1, 2, 3)])


@query("a10_pca_reconstruction", "\nUNION ALL ".join(
    f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, {s8(f'corr({a}, {b}) * count(*) / (count(*) - 1)')} AS covariance FROM customer"
    for a in _PCA for b in _PCA))
def a10_reconstruction(spark, sf):
    """With every component kept, the scaled loadings give back the covariance of the standardised features."""
    c = table(spark, sf, "customer")
    l = PC.pca_loadings(c, PC.pca_fit(c, _PCA, k=3))
    a = l.select(F.col("feature").alias("feature_a"), "component", F.col("loading_scaled").alias("a"))
    b = l.select(F.col("feature").alias("feature_b"), "component", F.col("loading_scaled").alias("b"))
    return rounded(a.join(b, "component").groupBy("feature_a", "feature_b").agg(F.sum(F.col("a") * F.col("b")).alias("covariance")), 8)


@query("a10_pca_loadings")
def a10(spark, sf):
    c = table(spark, sf, "customer")
    fit = PC.pca_fit(c, ["c_acctbal", "c_nationkey", "c_custkey"], k=3)
    return PC.pca_loadings(c, fit)

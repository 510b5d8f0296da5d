"""Builders for the DuckDB oracle SQL of the profiling queries.

They compute the same statistics independently (count DISTINCT,
quantile_cont, FILTER aggregates); the column types of the driver's tables
are stated here so the SQL can be written out column by column.
"""

from __future__ import annotations

from tessera.plans.registry import sql_sig

# Column kinds of the driver's tables (int = 32-bit, bigint = 64-bit).
SCHEMAS = {
    "lineitem": [("l_orderkey", "bigint"), ("l_partkey", "bigint"), ("l_suppkey", "bigint"),
                 ("l_linenumber", "int"), ("l_quantity", "double"), ("l_extendedprice", "double"),
                 ("l_discount", "double"), ("l_tax", "double"), ("l_returnflag", "string"),
                 ("l_linestatus", "string"), ("l_shipdate", "timestamp")],
    "orders": [("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"),
               ("o_totalprice", "double"), ("o_orderdate", "timestamp"), ("o_orderpriority", "string")],
    "customer": [("c_custkey", "bigint"), ("c_name", "string"), ("c_nationkey", "int"),
                 ("c_acctbal", "double"), ("c_mktsegment", "string")],
    "supplier": [("s_suppkey", "bigint"), ("s_name", "string"), ("s_nationkey", "int"), ("s_acctbal", "double")],
    "part": [("p_partkey", "bigint"), ("p_name", "string"), ("p_brand", "string"), ("p_type", "string"),
             ("p_size", "int"), ("p_retailprice", "double")],
    "events": [("event_id", "bigint"), ("ts", "timestamp"), ("user_id", "bigint"), ("event_type", "string"),
               ("value", "double"), ("props", "string")],
    "orders_missing": [("o_orderkey", "bigint"), ("o_totalprice", "double"), ("o_orderpriority", "string")],
    "supplier_missing": [("s_suppkey", "bigint"), ("s_nationkey", "int"), ("s_acctbal", "double")],
    "nation": [("n_nationkey", "int"), ("n_name", "string"), ("n_regionkey", "int")],
    "labels": [("doc_id", "bigint"), ("quality", "int"), ("toxic", "int")],
}



def _nulls(c):
    return f"count(*) FILTER (WHERE {c} IS NULL)"


def autotype_sql(c: str, kind: str) -> str:
    nd = f"count(DISTINCT {c})"
    if kind == "double":
        return "'Continuous'"
    if kind in ("int", "bigint"):
        return (f"CASE WHEN {_nulls(c)} > 0 THEN 'Continuous' WHEN {nd} = 2 THEN 'Binary' "
                f"WHEN {nd} BETWEEN 3 AND 20 THEN 'Categorical' ELSE 'Continuous' END")
    if kind == "string":
        f = f"lower(trim({c}))"
        pair = " OR ".join(f"(min({f}) = '{a}' AND max({f}) = '{b}')"
                           for a, b in [("false", "true"), ("f", "t"), ("no", "yes"), ("n", "y"), ("0", "1")])
        return (f"CASE WHEN {nd} = 0 THEN 'Empty' WHEN {nd} = 2 THEN "
                f"(CASE WHEN count(DISTINCT {f}) = 2 AND ({pair}) THEN 'Boolean' ELSE 'Binary' END) "
                f"WHEN {nd} > 20 THEN 'Descriptive' ELSE 'Categorical' END")
    return "'Datetime'"


def dtype_sql(c: str, kind: str) -> str:
    if kind == "double":
        return "'float64'"
    if kind in ("int", "bigint"):
        base = "int32" if kind == "int" else "int64"
        return f"CASE WHEN {_nulls(c)} > 0 THEN 'float64' ELSE '{base}' END"
    if kind == "string":
        return "'object'"
    return "'datetime64[ns]'"


def pct_missing_sql(c: str) -> str:
    return f"round(100.0::DOUBLE * {_nulls(c)} / count(*), 2)"


def numeric_summary_sql(table: str, source: str | None = None) -> str:
    src = source or table
    parts = []
    for c, kind in SCHEMAS[table]:
        if kind not in ("int", "bigint", "double"):
            continue
        at = autotype_sql(c, kind)
        out = (f"round(100.0::DOUBLE * count(*) FILTER (WHERE {c} < q.q1 - 1.5 * (q.q3 - q.q1) "
               f"OR {c} > q.q3 + 1.5 * (q.q3 - q.q1)) / count({c}), 2)")
        parts.append(
            f"SELECT '{c}' AS variable, {dtype_sql(c, kind)} AS dtype, {at} AS autotype, "
            f"{sql_sig(f"CAST(min({c}) AS DOUBLE)")} AS min, {sql_sig(f"CAST(max({c}) AS DOUBLE)")} AS max, {sql_sig(f"avg({c})")} AS mean, "
            f"{sql_sig(f"quantile_cont({c}, 0.5)")} AS median, {pct_missing_sql(c)} AS pct_missing, "
            f"count(DISTINCT {c}) AS n_unique, CASE WHEN {at} = 'Continuous' THEN {out} END AS pct_outliers "
            f"FROM {src}, (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM {src}) q")
    return "\nUNION ALL\n".join(parts)


def string_summary_sql(table: str, source: str | None = None) -> str:
    src = source or table
    parts = []
    for c, kind in SCHEMAS[table]:
        if kind != "string":
            continue
        mode = (f"(SELECT {c} FROM {src} WHERE {c} IS NOT NULL GROUP BY {c} "
                f"ORDER BY count(*) DESC, {c} LIMIT 1)")
        parts.append(
            f"SELECT '{c}' AS variable, 'object' AS dtype, {autotype_sql(c, kind)} AS autotype, "
            f"count(DISTINCT {c}) AS n_unique, coalesce({mode}, '') AS most_frequent, "
            f"{pct_missing_sql(c)} AS pct_missing FROM {src}")
    return "\nUNION ALL\n".join(parts)


def autotype_table_sql(table: str, source: str | None = None) -> str:
    src = source or table
    return "\nUNION ALL\n".join(
        f"SELECT '{c}' AS variable, {dtype_sql(c, k)} AS dtype, {autotype_sql(c, k)} AS autotype, "
        f"count(DISTINCT {c}) AS n_unique FROM {src}" for c, k in SCHEMAS[table])


def tree_ctes(p: str, src: str, feats: list[str], stats: dict[str, str], score, depth: int, valid: str = "true", node_ok: str = "true") -> str:
    """CTEs ``{p}0`` .. ``{p}{depth}``: the rows of ``src`` with their tree node after each level (negative once the node is a leaf).

    A level takes the cut with the largest ``score(left) + score(right) - score(node)`` (ties: first feature, smallest value) of each node;
    ``score`` maps a prefix (l_, r_, t_) to SQL over the sums ``stats``; ``valid`` limits cuts and ``node_ok`` nodes or gains.
    """
    out = [f"{p}0 AS (SELECT *, 1::BIGINT AS node FROM {src})"]
    numbers, values = ", ".join(str(i) for i in range(len(feats))), ", ".join(f"{f}::DOUBLE" for f in feats)
    each = lambda form: ", ".join(form.format(s=s) for s in stats)
    for k in range(depth):
        out += [
            f"{p}c{k} AS (SELECT node, f, v, {', '.join(f'sum({e}) AS {s}' for s, e in stats.items())} FROM (SELECT *, unnest([{numbers}]) AS f,"
            f" unnest([{values}]) AS v FROM {p}{k} WHERE node > 0) GROUP BY node, f, v)",
            f"{p}w{k} AS (SELECT node, f, v, lead(v) OVER w IS NULL AS last, {each('sum({s}) OVER w AS l_{s}')},"
            f" {each('sum({s}) OVER (PARTITION BY node, f) AS t_{s}')} FROM {p}c{k} WINDOW w AS (PARTITION BY node, f ORDER BY v))",
            f"{p}g{k} AS (SELECT *, {score('l_')} + {score('r_')} - {score('t_')} AS gain FROM (SELECT *, {each('t_{s} - l_{s} AS r_{s}')} FROM {p}w{k}"
            f" WHERE NOT last) WHERE {valid})",
            f"{p}b{k} AS (SELECT node, f AS bf, v AS bv FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY gain DESC, f, v) AS rn FROM {p}g{k}"
            f" WHERE {node_ok}) WHERE rn = 1)",
            f"{p}{k + 1} AS (SELECT d.* EXCLUDE (node), CASE WHEN bf IS NULL THEN -abs(d.node) ELSE 2 * d.node + (CASE bf"
            f" {' '.join(f'WHEN {i} THEN {f}::DOUBLE' for i, f in enumerate(feats))} END > bv)::INTEGER END AS node"
            f" FROM {p}{k} d LEFT JOIN {p}b{k} USING (node))",
        ]
    return ", ".join(out)

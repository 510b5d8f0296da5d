"""Run registered Spark queries next to their DuckDB oracle and compare.

Usage: python tests/oracle_harness.py [sf_dir] [name-substring ...]
Compares column names (sorted), row counts and values (order-insensitive;
floats to a relative tolerance of 1e-6).
"""

from __future__ import annotations

import datetime
import math
import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    import pandas as pd
    if v is None or v is pd.NaT:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return v
    if hasattr(v, "item") and not isinstance(v, (list, tuple)):
        try:
            return _norm(v.item())
        except Exception:
            pass
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if hasattr(v, "tolist"):
        return tuple(_norm(x) for x in v.tolist())
    import decimal
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, bool):
        return int(v)
    return v


def _key(row):
    return tuple((0, "") if x is None else (1, str(type(x).__name__ in ("int", "float")), x if isinstance(x, (int, float)) else str(x)) for x in row)


def _close(a, b):
    if a is None or b is None:
        return a is None and b is None
    if isinstance(a, bool) or isinstance(b, bool):
        return int(a) == int(b)
    if isinstance(a, (int, float)) and isinstance(b, (int, float)):
        return math.isclose(a, b, rel_tol=1e-6, abs_tol=1e-6)
    if isinstance(a, tuple) and isinstance(b, tuple):
        return len(a) == len(b) and all(_close(x, y) for x, y in zip(a, b))
    return a == b


def compare(sdf, ddf):
    scols, dcols = sorted(sdf.columns), sorted(ddf.columns)
    if scols != dcols:
        return f"columns differ: spark={scols} oracle={dcols}"
    srows = [tuple(_norm(r[c]) for c in scols) for r in sdf.to_dict("records")]
    drows = [tuple(_norm(r[c]) for c in scols) for r in ddf.to_dict("records")]
    if len(srows) != len(drows):
        return f"row count differs: spark={len(srows)} oracle={len(drows)}"
    srows.sort(key=_key)
    drows.sort(key=_key)
    bad = [(a, b) for a, b in zip(srows, drows) if not all(_close(x, y) for x, y in zip(a, b))]
    if bad:
        return f"{len(bad)} rows differ, first: spark={bad[0][0]} oracle={bad[0][1]}"
    return None


def run(sf_dir: str, names: list[str] | None = None, spark=None) -> dict:
    import __spark_entry__ as E
    from tessera import get_spark
    spark = spark or get_spark("local[8]")
    qs, sqls = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    out = {}
    for name, fn in qs.items():
        if names and not any(n in name for n in names):
            continue
        t = time.time()
        try:
            sdf = fn(spark, sf_dir).toPandas()
        except Exception as e:  # noqa: BLE001
            out[name] = f"SPARK ERROR {type(e).__name__}: {str(e)[:400]}"
            continue
        st = time.time() - t
        if name not in sqls:
            out[name] = f"rows-only ({len(sdf)} rows) {st:.1f}s"
            continue
        try:
            ddf = con.execute(sqls[name]).df()
        except Exception as e:  # noqa: BLE001
            out[name] = f"ORACLE ERROR {str(e)[:400]}"
            continue
        err = compare(sdf, ddf)
        out[name] = f"OK ({len(sdf)} rows) {st:.1f}s" if err is None else "MISMATCH " + err
    return out


if __name__ == "__main__":
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    res = run(sf, sys.argv[2:] or None)
    for k, v in res.items():
        print(f"{k:45s} {v}")
    print("SUMMARY", sum(v.startswith("OK") for v in res.values()), "ok of", len(res))

"""Run registered queries on Spark and their oracle SQL on DuckDB; compare like the driver does:
row count, column names, and an order-insensitive hash of values (columns sorted by name).

usage: python tools/oracle_check.py [sf_dir] [key ...]
"""

from __future__ import annotations

import hashlib
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402
import pandas as pd  # noqa: E402

from tabwright.plans.contracts import TABLES  # noqa: E402
from tabwright.plans.registry import ORACLE, QUERIES, load_all  # noqa: E402
from tabwright.session import build_session  # noqa: E402


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v, digits):
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, digits) if digits is not None else v
    if hasattr(v, "item"):
        return _norm(v.item(), digits)
    return v


def fingerprint(df: pd.DataFrame, digits=None):
    cols = sorted(df.columns)
    rows = sorted((tuple(_norm(v, digits) for v in rec) for rec in df[cols].itertuples(index=False)), key=repr)
    return cols, len(rows), hashlib.sha256(repr(rows).encode()).hexdigest()[:16]


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    keys = sys.argv[2:]
    load_all()
    spark = build_session()
    con = duck(sf_dir)
    bad = 0
    for k in (keys or sorted(QUERIES)):
        t0 = time.time()
        try:
            sp = QUERIES[k](spark, sf_dir).toPandas()
        except Exception as e:  # noqa: BLE001
            print(f"{k:32s} SPARK-ERROR {type(e).__name__}: {str(e)[:300]}")
            bad += 1
            continue
        ts = time.time() - t0
        if k not in ORACLE:
            print(f"{k:32s} ROWS-ONLY rows={len(sp)} {ts:.1f}s")
            continue
        try:
            dk = con.execute(ORACLE[k]).df()
        except Exception as e:  # noqa: BLE001
            print(f"{k:32s} SQL-ERROR {str(e)[:300]}")
            bad += 1
            continue
        a, b = fingerprint(sp), fingerprint(dk)
        if a == b:
            status = "OK"
        elif fingerprint(sp, 6) == fingerprint(dk, 6):
            status = "APPROX"
        else:
            status = "FAIL"
            bad += 1
        dt = "" if [str(x) for x in sp.dtypes] == [str(x) for x in dk[sp.columns].dtypes] or status == "FAIL" and set(sp.columns) != set(dk.columns) else \
            f" dtypes spark={dict(sp.dtypes.astype(str))} duck={dict(dk.dtypes.astype(str))}"
        print(f"{k:32s} {status:6s} rows={a[1]}/{b[1]} cols_equal={a[0] == b[0]} {ts:.1f}s{dt if status != 'OK' or dt else ''}")
        if status == "FAIL" and a[0] == b[0] and os.environ.get("SHOW_DIFF"):
            m = sp.merge(dk, how="outer", indicator=True)
            print(m[m["_merge"] != "both"].head(10).to_string())
        elif status == "FAIL" and a[0] != b[0]:
            print("   spark cols", a[0], "\n   duck  cols", b[0])
    print("failures:", bad)


if __name__ == "__main__":
    main()

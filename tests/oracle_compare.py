"""Spark-vs-DuckDB comparison of the registered queries (local twin of the
driver's correctness gate): row count, column names and an order-insensitive
hash of the values.

Usage: python tests/oracle_compare.py [sf_dir] [query ...]
"""

from __future__ import annotations

import datetime as dt
import hashlib
import math
import os
import sys
import time

import duckdb
import pandas as pd

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from matchflow.sources.tables import TABLES  # noqa: E402


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _canon(v) -> str:
    if v is None:
        return "∅"
    if isinstance(v, float):
        if math.isnan(v):
            return "∅"
        if v.is_integer() and abs(v) < 2 ** 53:
            return str(int(v))  # nullable ints arrive as float64 from toPandas
        return f"{round(v, 6):.6f}"
    if isinstance(v, bool):
        return "T" if v else "F"
    if isinstance(v, (pd.Timestamp, dt.datetime)):
        return pd.Timestamp(v).tz_localize(None).isoformat() if getattr(v, "tzinfo", None) else pd.Timestamp(v).isoformat()
    if hasattr(v, "item"):
        return _canon(v.item())
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_canon(x) for x in v) + "]"
    try:
        import numpy as np
        if isinstance(v, np.ndarray):
            return "[" + ",".join(_canon(x) for x in v.tolist()) + "]"
    except Exception:
        pass
    return str(v)


def digest(df: pd.DataFrame) -> tuple[int, list[str], str]:
    cols = sorted(df.columns)
    df = df[cols].astype(object).where(pd.notna(df[cols]), None)
    rows = sorted("|".join(_canon(v) for v in r) for r in df.itertuples(index=False, name=None))
    h = hashlib.sha256("\n".join(rows).encode()).hexdigest()
    return len(rows), cols, h


def compare(spark, sf_dir: str, names=None, verbose=True) -> dict[str, dict]:
    import __spark_entry__ as E
    qs, sql = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    out = {}
    for name in names or qs:
        rec = {"oracle": name in sql}
        t = time.time()
        try:
            sdf = qs[name](spark, sf_dir).toPandas()
            rec["spark_sec"] = round(time.time() - t, 2)
            sn, scols, sh = digest(sdf)
            rec.update(rows=sn)
            if name in sql:
                ddf = con.execute(sql[name]).df()
                dn, dcols, dh = digest(ddf)
                rec.update(oracle_rows=dn, cols_match=scols == dcols, hash_match=sh == dh)
                if scols != dcols:
                    rec["cols"] = (scols, dcols)
                rec["ok"] = sn == dn and scols == dcols and sh == dh
            else:
                rec["ok"] = None
        except Exception as e:  # report and continue
            rec.update(ok=False, error=f"{type(e).__name__}: {str(e)[:400]}")
        out[name] = rec
        if verbose:
            print(name, rec, flush=True)
    return out


if __name__ == "__main__":
    from matchflow.session import get_session
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or None
    spark = get_session("local[8]", shuffle_partitions=8)
    res = compare(spark, sf, names)
    bad = [k for k, v in res.items() if v.get("ok") is False]
    print("FAILED:", bad)
    print(f"{sum(1 for v in res.values() if v.get('ok'))}/{len(res)} match")

"""Run registered queries in Spark and their DuckDB oracles; compare results.

Usage: python tests/oracle_check.py [sf_dir] [name ...]
Compares row count, column names and the multiset of rows (floats to 9
significant digits, order-insensitive).
"""

from __future__ import annotations

import datetime as dt
import math
import sys
import time
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402

from seclog.plans.oracles import oracle_sql  # noqa: E402
from seclog.plans.queries import queries  # noqa: E402
from seclog.sources.tables import TABLES  # noqa: E402


def canon(v):
    if v is None:
        return "NULL"
    if isinstance(v, float):
        if math.isnan(v):
            return "NULL"
        return f"{v:.9g}"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat(sep=" ") if isinstance(v, dt.datetime) else v.isoformat()
    if hasattr(v, "item"):
        return canon(v.item())
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(canon(x) for x in v) + "]"
    return str(v)


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def compare(spark, con, name, sf_dir, verbose=True):
    t0 = time.time()
    sdf = queries()[name](spark, sf_dir)
    srows = [tuple(r) for r in sdf.collect()]
    scols = list(sdf.columns)
    t1 = time.time()
    sql = oracle_sql().get(name)
    if sql is None:
        return {"name": name, "rows": len(srows), "oracle": False, "ok": None, "spark_s": t1 - t0}
    rel = con.execute(sql)
    dcols = [d[0] for d in rel.description]
    drows = rel.fetchall()
    t2 = time.time()
    res = {"name": name, "rows": len(srows), "oracle_rows": len(drows), "spark_s": round(t1 - t0, 2), "duck_s": round(t2 - t1, 2)}
    if sorted(scols) != sorted(dcols):
        res.update(ok=False, why=f"columns {scols} vs {dcols}")
        return res
    order = [dcols.index(c) for c in scols]
    sc = Counter(tuple(canon(v) for v in r) for r in srows)
    dc = Counter(tuple(canon(r[i]) for i in order) for r in drows)
    if sc != dc:
        only_s = list((sc - dc).elements())[:3]
        only_d = list((dc - sc).elements())[:3]
        res.update(ok=False, why=f"values differ: spark-only {only_s} duck-only {only_d}")
        return res
    res["ok"] = True
    return res


def main():
    from seclog.session import local_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(queries())
    spark = local_session(cores=3)
    con = duck(sf_dir)
    bad = 0
    for n in names:
        try:
            r = compare(spark, con, n, sf_dir)
        except Exception as e:  # report and continue
            r = {"name": n, "ok": False, "why": f"{type(e).__name__}: {str(e)[:400]}"}
        if r.get("ok") is False:
            bad += 1
        print(r, flush=True)
    print("FAILED" if bad else "ALL OK", bad)


if __name__ == "__main__":
    main()

"""Run queries against their SQL in DuckDB: python tests/compare.py [--sf DIR] [NAME...]"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def norm(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return norm(v.asDict())
    if hasattr(v, "isoformat"):
        return v.isoformat()[:26]
    return v


def rows(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in data), key=repr)


def duck(sf):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for p in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    return con


def compare(spark, con, sf, name, query, sql):
    began = time.time()
    df = query(spark, sf)
    got = [tuple(r) for r in df.collect()]
    took = time.time() - began
    if sql is None:
        return True, f"{len(got)} rows, no SQL, {took:.1f} s"
    cur = con.execute(sql)
    cols = [c[0] for c in cur.description]
    want = cur.fetchall()
    if sorted(cols) != sorted(df.columns):
        return False, f"columns {df.columns} / {cols}"
    a, b = rows(df.columns, got), rows(cols, want)
    if a == b:
        return True, f"{len(a)} rows, {took:.1f} s"
    only = [x for x in a if x not in b][:2], [x for x in b if x not in a][:2]
    return False, f"{len(a)} / {len(b)} rows; only Spark {only[0]}; only SQL {only[1]}"


if __name__ == "__main__":
    import __spark_entry__ as E
    from strataloom.session import local_session

    args = sys.argv[1:]
    sf = args.pop(args.index("--sf") + 1) if "--sf" in args else "/root/testdata/sf0.01"
    args = [a for a in args if a != "--sf"]
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con, q, o = duck(sf), E.queries(), E.oracle_sql()
    bad = 0
    for name in q:
        if args and not any(name == a or name.startswith(a) for a in args):
            continue
        try:
            ok, said = compare(spark, con, sf, name, q[name], o.get(name))
        except Exception as e:
            ok, said = False, f"{type(e).__name__}: {str(e)[:900]}"
        bad += not ok
        print("ok  " if ok else "BAD ", name, said, flush=True)
    sys.exit(bad > 0)

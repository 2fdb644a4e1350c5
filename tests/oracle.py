"""Run table queries next to their SQL twin in DuckDB and compare the results.

``python tests/oracle.py [sf_dir] [name ...]``
"""
from __future__ import annotations

import glob
import math
import os
import sys
import time
from decimal import Decimal

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("set TimeZone='UTC'")
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def norm(v):
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, bool) or v is None:
        return (0, str(v))
    if isinstance(v, (int, float)):
        return (1, "nan") if isinstance(v, float) and math.isnan(v) else (1, f"{float(v):.6f}".replace("-0.000000", "0.000000"))
    return (2, str(v))


def table(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], sorted(tuple(norm(r[i]) for i in order) for r in rows)


def compare(spark, con, sf_dir, name, run, sql):
    t = time.time()
    df = run(spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    took = time.time() - t
    got = table(df.columns, rows)
    if sql is None:
        return len(rows) >= 0, f"{name}: rows only, {len(rows)} rows, {took:.1f}s"
    t = time.time()
    rel = con.execute(sql)
    want = table([d[0] for d in rel.description], rel.fetchall())
    if got == want:
        types = {d[0]: str(d[1]) for d in rel.description}
        odd = [f"{f.name}:{f.dataType.simpleString()}/{types[f.name]}" for f in df.schema
               if (f.dataType.simpleString(), types[f.name]) not in {
                   ("bigint", "BIGINT"), ("int", "INTEGER"), ("string", "VARCHAR"), ("double", "DOUBLE"), ("boolean", "BOOLEAN")}]
        return True, f"{name}: ok, {len(rows)} rows, {took:.1f}s (sql {time.time()-t:.1f}s) {' '.join(odd)}"
    msg = f"{name}: MISMATCH spark {len(got[1])} sql {len(want[1])} rows; columns {got[0]} / {want[0]}"
    a, b = [x for x in got[1] if x not in set(want[1])][:3], [x for x in want[1] if x not in set(got[1])][:3]
    return False, msg + f"\n   only spark: {a}\n   only sql:   {b}"


def main():
    import __spark_entry__ as entry
    from lexweave.session import build_session

    args = sys.argv[1:]
    sf = args.pop(0) if args and os.path.isdir(args[0]) else "/root/testdata/sf0.01"
    spark = build_session("oracle", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls, bad = connect(sf), entry.oracle_sql(), []
    for name, run in entry.queries().items():
        if args and name not in args:
            continue
        try:
            ok, msg = compare(spark, con, sf, name, run, sqls.get(name))
        except Exception as e:  # report and go on with the next query
            ok, msg = False, f"{name}: ERROR {type(e).__name__}: {str(e)[:1500]}"
        print(msg, flush=True)
        if not ok:
            bad.append(name)
    print("failed:", bad)


if __name__ == "__main__":
    main()

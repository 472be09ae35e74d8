"""Compare queries with their SQL in DuckDB: python tests/verify_sql.py [sf_dir] [name ...]."""

from __future__ import annotations

import datetime
import glob
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def rows_of(rows, cols):
    def norm(x):
        if isinstance(x, float):
            return None if math.isnan(x) else round(x, 9)
        if isinstance(x, datetime.datetime):
            return x.isoformat()
        return list(x) if isinstance(x, (list, tuple)) else x

    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(p)[:-8]
        src = f"{p}/*.parquet" if os.path.isdir(p) else p
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{src}'")
    return con


def compare(spark, con, sf_dir, name, query, sql):
    df = query(spark, sf_dir)
    got = rows_of([tuple(r) for r in df.collect()], df.columns)
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    want = rows_of(cur.fetchall(), cols)
    return sorted(df.columns) == sorted(cols), got, want


if __name__ == "__main__":
    import __spark_entry__ as entry
    from linkprism.runtime import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(entry.queries())
    spark, con, sql, bad = local_session(8), duck(sf), entry.oracle_sql(), 0
    spark.sparkContext.setLogLevel("ERROR")
    for name in names:
        t = time.time()
        if name not in sql:
            df = entry.queries()[name](spark, sf)
            print(f"rows {name} {df.count()} {time.time() - t:.1f}s {df.dtypes}", flush=True)
            continue
        cols, got, want = compare(spark, con, sf, name, entry.queries()[name], sql[name])
        ok = cols and got == want
        bad += not ok
        print(f"{'ok  ' if ok else 'BAD '} {name} {len(got)} {time.time() - t:.1f}s", flush=True)
        if not ok:
            print("   columns", cols, "missing", [x for x in want if x not in got][:3], "extra", [x for x in got if x not in want][:3], len(want))
    sys.exit(bad > 0)

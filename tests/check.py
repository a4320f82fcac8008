"""Runs registered queries against DuckDB: python tests/check.py [sf_dir] [name ...]"""

from __future__ import annotations

import math
import sys
import threading
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    import datetime
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(plain(x) for x in v) + "]"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return "NULL" if v is None else str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted("\x1f".join(plain(r[i]) for i in order) for r in rows)


def compare(df, con, sql):
    t0 = time.time()
    spark_rows = [tuple(r) for r in df.collect()]
    t1 = time.time()
    cur = con.execute(sql)
    if time.time() - t0 > 8:
        print(f"   spark {t1 - t0:.1f}s sql {time.time() - t1:.1f}s", flush=True)
    names = [d[0] for d in cur.description]
    types = [str(d[1]) for d in cur.description]
    a = rows_of(df.columns, spark_rows)
    b = rows_of(names, cur.fetchall())
    diff = []
    if a[0] != b[0]:
        diff.append(f"columns {a[0]} != {b[0]}")
    if len(a[1]) != len(b[1]):
        diff.append(f"rows {len(a[1])} != {len(b[1])}")
    if not diff and a[1] != b[1]:
        bad = [(x, y) for x, y in zip(a[1], b[1]) if x != y]
        diff.append(f"{len(bad)} rows differ, e.g.\n   spark {bad[0][0][:600]!r}\n   sql   {bad[0][1][:600]!r}")
    elif diff and a[0] == b[0]:
        sa, sb = set(a[1]), set(b[1])
        diff.append(f"only spark {[x[:400] for x in list(sa - sb)[:2]]}\n   only sql {[x[:400] for x in list(sb - sa)[:2]]}")
    widths = {"INTEGER": "int", "BIGINT": "bigint", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean"}
    dt = dict(df.dtypes)
    odd = [f"{n}:{dt[n]}!={t}" for n, t in zip(names, types)
           if n in dt and t in widths and widths[t] != dt[n] or t == "HUGEINT" or t.startswith("DECIMAL")]
    return len(a[1]), diff, odd


def main(argv):
    from folioscope.session import build_session
    import __spark_entry__ as entry
    sf = argv[0] if argv else "/root/testdata/sf0.01"
    queries, oracles = entry.queries(), entry.oracle_sql()
    wanted = [q for q in queries if not argv[1:] or any(q == a or (a.endswith("*") and q.startswith(a[:-1])) for a in argv[1:])]
    spark = build_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    failed, limit = [], 60
    for name in wanted:
        t0 = time.time()
        timer = threading.Timer(limit, lambda: (con.interrupt(), spark.sparkContext.cancelAllJobs()))
        timer.start()
        try:
            df = queries[name](spark, sf)
            if name in oracles:
                n, diff, odd = compare(df, con, oracles[name])
            else:
                n, diff, odd = df.count(), [], ["rows only"]
        except Exception as e:
            n, diff, odd = -1, [f"{type(e).__name__}: {str(e)[:1500]}"], []
        timer.cancel()
        if diff:
            failed.append(name)
        print(f"{'FAIL' if diff else 'ok  '} {name:28s} rows={n:7d} {time.time() - t0:6.1f}s {' '.join(odd)}", flush=True)
        for d in diff:
            print("   " + d)
    print(f"{len(wanted) - len(failed)}/{len(wanted)} ok; failed: {failed}")
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)

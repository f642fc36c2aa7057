"""Run registered queries in Spark and their SQL in DuckDB and compare rows."""

from __future__ import annotations

import datetime as dt
import math
import sys
import time
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, bool):
        return ("b", v)
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return ("", "")
    if isinstance(v, (int, float)):
        x = round(float(v), 9)
        return ("n", 0.0 if x == 0 else x)
    if isinstance(v, dt.datetime):
        return ("s", v.isoformat())
    if isinstance(v, dt.date):
        return ("s", v.isoformat())
    return ("s", str(v))


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted([tuple(plain(r[i]) for i in order) for r in rows], key=str)


def connect(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def compare(spark, folder, name, run, sql, con=None):
    t0 = time.time()
    df = run(spark, folder)
    got = table(df.columns, df.collect())
    t1 = time.time()
    if sql is None:
        return name, "rows-only", len(got[1]), t1 - t0, 0.0, ""
    con = con or connect(folder)
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    want = table(cols, cur.fetchall())
    t2 = time.time()
    note = ""
    if got[0] != want[0]:
        note = f"columns {got[0]} vs {want[0]}"
    elif len(got[1]) != len(want[1]):
        note = f"rows {len(got[1])} vs {len(want[1])}"
    else:
        bad = [(g, w) for g, w in zip(got[1], want[1]) if g != w]
        if bad:
            g, w = bad[0]
            diff = {c: (a[1], b[1]) for c, a, b in zip(got[0], g, w) if a != b}
            note = f"{len(bad)} rows differ, first: {diff} in {[x[1] for x in g][:12]}"
    return name, "ok" if not note else "DIFF", len(got[1]), t1 - t0, t2 - t1, note


def main(argv):
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    import __spark_entry__ as entry
    from duelframe.session import local_session

    folder = f"/root/testdata/{argv[0]}"
    spark = local_session("oracle", cores="8")
    spark.sparkContext.setLogLevel("ERROR")
    queries, sqls = entry.queries(), entry.oracle_sql()
    names = [n for n in queries if not argv[1:] or any(n.startswith(a) for a in argv[1:])]
    con = connect(folder)
    bad = 0
    for n in names:
        try:
            r = compare(spark, folder, n, queries[n], sqls.get(n), con)
        except Exception as e:  # noqa: BLE001
            r = (n, "FAIL", 0, 0, 0, str(e)[:900])
        bad += r[1] in ("DIFF", "FAIL")
        print(f"{r[1]:9} {r[0]:32} rows={r[2]:<8} spark={r[3]:.2f}s duck={r[4]:.2f}s {r[5]}", flush=True)
    print("bad:", bad, "of", len(names))


if __name__ == "__main__":
    main(sys.argv[1:])

"""Order-insensitive comparison of a Spark result with SQL over the same parquet files."""

from __future__ import annotations

import datetime as dt
import math
import sys
import time

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return ("b", v)
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        f = float(v)
        return ("n", round(f, 6) + 0.0)
    if isinstance(v, (dt.date, dt.datetime)):
        return ("t", str(v))
    if isinstance(v, (list, tuple)):
        return ("l", tuple(cell(x) for x in v))
    return ("s", str(v))


def rows_of(columns, tuples):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(cell(r[i]) for i in order) for r in tuples), key=repr)


def compare(df, con, sql):
    """(ok, message)"""
    t = time.time()
    got = [tuple(r) for r in df.collect()]
    spark_s = time.time() - t
    cur = con.execute(sql)
    want = cur.fetchall()
    gc, g = rows_of(df.columns, got)
    wc, w = rows_of([c[0] for c in cur.description], want)
    if gc != wc:
        return False, f"columns {gc} vs {wc}"
    if g != w:
        only_g, only_w = [x for x in g if x not in set(w)][:2], [x for x in w if x not in set(g)][:2]
        return False, f"rows {len(g)} vs {len(w)}; spark only {only_g}; sql only {only_w}"
    return True, f"{len(g)} rows {spark_s:.1f}s"


def main(names):
    sys.path.insert(0, ".")
    from docloom.bindings import load_catalog
    from docloom.session import build_session
    spark = build_session(master="local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false", spark__driver__memory="8g",
                          spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    sf = "/root/testdata/sf0.01"
    con = connect(sf)
    queries, oracles = load_catalog()
    bad = 0
    for name, fn in queries.items():
        if names and not any(n in (name, fn.__module__.rsplit(".", 1)[1]) for n in names):
            continue
        try:
            if name in oracles:
                ok, msg = compare(fn(spark, sf), con, oracles[name])
            else:
                t = time.time()
                n = len(fn(spark, sf).collect())
                ok, msg = True, f"{n} rows {time.time() - t:.1f}s (no sql)"
        except Exception as e:
            ok, msg = False, f"{type(e).__name__} {str(e)[:900]}"
        bad += not ok
        print("ok  " if ok else "BAD ", name, msg if ok else msg[:1500], flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main(sys.argv[1:])

"""Run every registered analysis on Spark and its oracle SQL on DuckDB and
compare: same column names, same row count, same multiset of rows (exact
values; columns sorted by name, rows sorted).  Usage:

    python tests/oracle_check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

RAW_TABLES = ("region nation customer supplier part orders lineitem events documents "
              "embeddings pages benchmark labels conversations").split()


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return ("nan",) if math.isnan(v) else v
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, dt.datetime):
        return v
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return tuple(sorted((k, norm(x)) for k, x in v.asDict().items()))
    return v


def sort_key(row):
    return tuple((x is None, repr(type(x)), repr(x)) for x in row)


def canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    names = [cols[i] for i in order]
    out = sorted((tuple(norm(r[i]) for i in order) for r in rows), key=sort_key)
    return names, out


def duck_conn(sf_dir):
    import duckdb
    con = duckdb.connect()
    for t in RAW_TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def check(spark, sf_dir, names=None, verbose=True):
    import __spark_entry__ as entry
    qs, sqls = entry.queries(), entry.oracle_sql()
    con = duck_conn(sf_dir)
    results = {}
    for name in names or list(qs):
        t0 = time.time()
        try:
            df = qs[name](spark, sf_dir)
            rows = df.collect()
            s_cols, s_rows = canon(df.columns, rows)
        except Exception as exc:  # report and continue
            results[name] = ("SPARK-ERROR", str(exc).splitlines()[0][:300])
            if verbose:
                print(f"{name:28s} SPARK-ERROR {results[name][1]}", flush=True)
            continue
        if name not in sqls:
            results[name] = ("ROWS-ONLY", len(s_rows))
            if verbose:
                print(f"{name:28s} rows-only {len(s_rows)} ({time.time()-t0:.1f}s)", flush=True)
            continue
        try:
            cur = con.execute(sqls[name])
            d_cols = [c[0] for c in cur.description]
            d_cols, d_rows = canon(d_cols, cur.fetchall())
        except Exception as exc:
            results[name] = ("DUCK-ERROR", str(exc).splitlines()[0][:300])
            if verbose:
                print(f"{name:28s} DUCK-ERROR {results[name][1]}", flush=True)
            continue
        if s_cols != d_cols:
            status = ("COLS", f"spark={s_cols} duck={d_cols}")
        elif len(s_rows) != len(d_rows):
            status = ("COUNT", f"spark={len(s_rows)} duck={len(d_rows)}")
        elif s_rows != d_rows:
            diff = [(a, b) for a, b in zip(s_rows, d_rows) if a != b][:2]
            status = ("VALUES", f"{diff}")
        else:
            status = ("OK", len(s_rows))
        results[name] = status
        if verbose:
            print(f"{name:28s} {status[0]} {str(status[1])[:400]} ({time.time()-t0:.1f}s)", flush=True)
    return results


if __name__ == "__main__":
    from salesdeck.session import get_session
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = get_session()
    res = check(spark, sf, sys.argv[2:] or None)
    bad = {k: v for k, v in res.items() if v[0] not in ("OK", "ROWS-ONLY")}
    print(f"\n{len(res) - len(bad)}/{len(res)} pass; failing: {sorted(bad)}")

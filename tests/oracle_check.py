"""Run queries() against oracle_sql() the way the driver does.

Usage: python tests/oracle_check.py [sf_dir] [name ...]
Prints one line per query: name, match flag, row counts, seconds.
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        r = round(v, 6)
        return 0.0 if r == 0 else r
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return norm(v.asDict())
    if type(v).__name__ == "Decimal":
        return norm(float(v))
    return v


def canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(norm(r[i]) for i in order) for r in rows]
    return [cols[i] for i in order], sorted(out, key=repr)


def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def compare(spark, sf_dir, names=None, verbose=True):
    import __spark_entry__ as E
    qs, sqls = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    results = {}
    for name in (names or list(qs)):
        t0 = time.time()
        try:
            df = qs[name](spark, sf_dir)
            srows = [tuple(r) for r in df.collect()]
            scols = df.columns
        except Exception as e:  # noqa: BLE001
            results[name] = ("SPARK-ERR", str(e)[:300])
            print(name, "SPARK-ERR", str(e)[:500], flush=True)
            continue
        ts = time.time() - t0
        if name not in sqls:
            results[name] = ("rows-only", len(srows))
            print(f"{name:32s} rows-only n={len(srows)} {ts:.1f}s", flush=True)
            continue
        try:
            cur = con.execute(sqls[name])
            dcols = [d[0] for d in cur.description]
            drows = cur.fetchall()
        except Exception as e:  # noqa: BLE001
            results[name] = ("SQL-ERR", str(e)[:300])
            print(name, "SQL-ERR", str(e)[:500], flush=True)
            continue
        c1, r1 = canon(scols, srows)
        c2, r2 = canon(dcols, drows)
        ok = c1 == c2 and r1 == r2
        results[name] = ("OK" if ok else "MISMATCH", len(r1), len(r2))
        print(f"{name:32s} {'OK' if ok else 'MISMATCH'} spark={len(r1)} duck={len(r2)} {ts:.1f}s",
              flush=True)
        if not ok and verbose:
            if c1 != c2:
                print("   cols", c1, c2)
            else:
                s1, s2 = set(r1), set(r2)
                print("   spark-only", list(s1 - s2)[:3])
                print("   duck-only ", list(s2 - s1)[:3])
    return results


if __name__ == "__main__":
    from tracefold.session import get_spark
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or None
    spark = get_spark()
    res = compare(spark, sf, names)
    bad = [n for n, r in res.items() if r[0] not in ("OK", "rows-only")]
    print("TOTAL", len(res), "BAD", len(bad), bad)

"""Run registered queries in Spark and their DuckDB oracles side by side and compare
row count, column names and an order-insensitive hash of the values (doubles rounded to 4).

usage: python scripts/check_oracle.py [--sf DIR] [name ...]
"""

from __future__ import annotations

import argparse
import hashlib
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(round(v, 4) + 0.0)
    if hasattr(v, "item"):
        return norm(v.item())
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(norm(x) for x in v) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{norm(x)}" for k, x in sorted(v.items())) + "}"
    if v is None:
        return "NULL"
    return str(v)


def digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted("\x1f".join(norm(r[i]) for i in order) for r in rows)
    return hashlib.sha1("\n".join(lines).encode()).hexdigest(), lines


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("--partitions", type=int, default=None, help="spark.sql.shuffle.partitions")
    ap.add_argument("names", nargs="*")
    a = ap.parse_args()
    from corpusprep.session import get_spark
    from corpusprep.plans.registry import oracles, queries
    spark = get_spark(shuffle_partitions=a.partitions)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{a.sf}/{t}.parquet')")
    qs, os_ = queries(), oracles()
    names = a.names or sorted(qs)
    bad = 0
    for n in names:
        t0 = time.time()
        try:
            sdf = qs[n](spark, a.sf)
            srows = [tuple(r) for r in sdf.collect()]
            scols = sdf.columns
        except Exception as e:  # noqa: BLE001
            print(f"{n:28s} SPARK-ERROR {type(e).__name__}: {str(e)[:300]}")
            bad += 1
            continue
        ts = time.time() - t0
        if n not in os_:
            print(f"{n:28s} rows-only   rows={len(srows)} spark={ts:.1f}s")
            continue
        t1 = time.time()
        try:
            res = con.execute(os_[n])
            dcols = [d[0] for d in res.description]
            drows = res.fetchall()
        except Exception as e:  # noqa: BLE001
            print(f"{n:28s} DUCK-ERROR {type(e).__name__}: {str(e)[:300]}")
            bad += 1
            continue
        td = time.time() - t1
        hs, ls = digest(scols, srows)
        hd, ld = digest(dcols, drows)
        ok = len(srows) == len(drows) and sorted(scols) == sorted(dcols) and hs == hd
        print(f"{n:28s} {'OK  ' if ok else 'FAIL'} rows={len(srows)}/{len(drows)} spark={ts:.1f}s duck={td:.1f}s"
              + ("" if sorted(scols) == sorted(dcols) else f" cols {sorted(scols)} vs {sorted(dcols)}"))
        if not ok:
            bad += 1
            ss, dd = set(ls), set(ld)
            for x in list(ss - dd)[:3]:
                print("   spark-only:", x[:300])
            for x in list(dd - ss)[:3]:
                print("   duck-only: ", x[:300])
    print(f"{len(names) - bad}/{len(names)} ok")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())

"""Compare registered queries with their SQL twins: python check_queries.py [sf] [names...]."""
import math
import sys
import time

import duckdb
from pyspark.sql import SparkSession

from agentmetrics.catalog import QUERIES, SQL

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(round(v, 9) + 0.0)
    if hasattr(v, "as_tuple"):
        return repr(round(float(v), 9) + 0.0) if v != int(v) else repr(int(v))
    return repr(v)


def main():
    sf, names = sys.argv[1], sys.argv[2:] or list(QUERIES)
    folder = f"/root/testdata/sf{sf}"
    # deliberately plain settings: queries must not depend on build_session
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.driver.memory", "4g").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    bad = 0
    for name in names:
        t0 = time.time()
        try:
            df = QUERIES[name](spark, folder)
            cols = sorted(df.columns)
            got = [tuple(norm(r[c]) for c in cols) for r in df.collect()]
            took = time.time() - t0
            if name not in SQL:
                print(f"{name:24s} rows-only {len(got):7d} {took:6.2f}s", flush=True)
                continue
            cur = con.execute(SQL[name])
            scols = [c[0] for c in cur.description]
            data = cur.fetchall()
            if sorted(scols) != cols:
                print(f"{name:24s} COLUMNS {cols} vs {sorted(scols)}", flush=True)
                bad += 1
                continue
            at = [scols.index(c) for c in cols]
            want = [tuple(norm(r[i]) for i in at) for r in data]
            got.sort()
            want.sort()
            ok = got == want
            bad += not ok
            print(f"{name:24s} {'ok ' if ok else 'DIFF'} {len(got):7d} {len(want):7d} {took:6.2f}s",
                  flush=True)
            if not ok:
                gs, ws = set(got), set(want)
                print("   cols ", cols)
                for r in list(gs - ws)[:3]:
                    print("   spark", r)
                for r in list(ws - gs)[:3]:
                    print("   sql  ", r)
        except Exception as exc:  # noqa: BLE001
            bad += 1
            print(f"{name:24s} ERROR {str(exc)[:700]}", flush=True)
    print("bad", bad)


main()

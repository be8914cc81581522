"""Run queries next to their SQL: python tests/oracle_check.py [-d sf_dir] [name prefix ...]."""

from __future__ import annotations

import argparse
import logging
import math
import os
import sys
import time
import traceback
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def session():
    from pyspark.sql import SparkSession
    spark = (SparkSession.builder.master("local[8]").appName("check")
             .config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC")
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "12g").getOrCreate())
    spark.sparkContext.setLogLevel("OFF")
    logging.disable(logging.CRITICAL)
    return spark


def duck(root):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{root}/{t}.parquet'")
    return con


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return f"b{v}"
    if isinstance(v, int):
        return f"i{v}"
    if isinstance(v, float):
        return f"f{round(v, 5) + 0.0:.5f}"
    if type(v).__name__ == "Decimal":
        return f"dec{v}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(str(norm(x)) for x in v) + "]"
    return f"{type(v).__name__}:{v}"


def compare(spark, con, name, fn, sql, root):
    """(problem text or '', rows, spark seconds, sql seconds)."""
    t0 = time.time()
    df = fn(spark, root)
    rows = df.collect()
    t1 = time.time()
    cols = sorted(df.columns)
    if sql is None:
        return "", len(rows), t1 - t0, 0.0
    res = con.execute(sql)
    dcols = [d[0] for d in res.description]
    got = res.fetchall()
    t2 = time.time()
    if sorted(dcols) != cols:
        return f"columns {cols} vs {sorted(dcols)}", len(rows), t1 - t0, t2 - t1
    pos = [dcols.index(c) for c in cols]
    a = Counter(tuple(norm(r[c]) for c in cols) for r in rows)
    b = Counter(tuple(norm(r[p]) for p in pos) for r in got)
    if a == b:
        return "", len(rows), t1 - t0, t2 - t1
    return (f"rows {len(rows)} vs {len(got)} {cols}\n   spark-only {list((a - b).items())[:3]}\n   "
            f"sql-only   {list((b - a).items())[:3]}"), len(rows), t1 - t0, t2 - t1


def main():
    p = argparse.ArgumentParser()
    p.add_argument("-d", default="/root/testdata/sf0.001")
    p.add_argument("names", nargs="*")
    a = p.parse_args()
    from tendon.plans import ORACLES, QUERIES
    spark, con, bad = session(), duck(a.d), []
    picked = [n for n in QUERIES if not a.names or any(n.startswith(x) for x in a.names)]
    for n in picked:
        try:
            problem, rows, ts, td = compare(spark, con, n, QUERIES[n], ORACLES.get(n), a.d)
        except Exception as e:  # noqa: BLE001
            text = str(e)
            problem, rows, ts, td = f"{type(e).__name__}: {text[:700]}", -1, 0, 0
            if "-v" in os.environ.get("CHECK", ""):
                traceback.print_exc()
        mark = "ok  " if not problem else "BAD "
        kind = "sql " if n in ORACLES else "rows"
        print(f"{mark}{kind} {n:38s} rows={rows:<7d} spark={ts:6.2f}s sql={td:5.2f}s {problem}", flush=True)
        if problem or rows == 0:
            bad.append(n)
    print(f"{len(picked) - len(bad)}/{len(picked)} fine; look at: {bad}")


if __name__ == "__main__":
    main()

"""Run registered queries against their SQL twins on one data folder."""

from __future__ import annotations

import datetime
import glob
import math
import os
import sys
import time
from collections import Counter

import duckdb


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(value):
    if value is None:
        return None
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return round(value, 6) + 0.0
    if isinstance(value, bool):
        return value
    if isinstance(value, dict):
        return tuple((k, plain(v)) for k, v in value.items())
    if hasattr(value, "asDict"):
        return tuple((k, plain(v)) for k, v in value.asDict().items())
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if type(value).__name__ == "Decimal":
        return round(float(value), 6)
    return value


def compare(spark, con, folder, function, twin):
    """None when equal, otherwise a short description; also the seconds taken by Spark."""
    start = time.time()
    df = function(spark, folder)
    rows = df.collect()
    took = time.time() - start
    names = df.columns
    if twin is None:
        return (None if rows is not None else "no rows"), took, len(rows)
    cursor = con.execute(twin)
    other = [d[0] for d in cursor.description]
    if sorted(names) != sorted(other):
        return f"columns {sorted(names)} != {sorted(other)}", took, len(rows)
    order = sorted(names)
    mine = Counter(tuple(plain(r[c]) for c in order) for r in rows)
    index = [other.index(c) for c in order]
    theirs = Counter(tuple(plain(r[i]) for i in index) for r in cursor.fetchall())
    if mine == theirs:
        return None, took, len(rows)
    only, missing = list((mine - theirs).items()), list((theirs - mine).items())
    return (
        f"{len(only)} rows only in Spark, {len(missing)} only in SQL\n  columns {order}\n"
        f"  spark {sorted(map(str, only))[:3]}\n  sql   {sorted(map(str, missing))[:3]}",
        took,
        len(rows),
    )


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from wagerframe.plans import catalogue
    from wagerframe.session import local_session

    folder = f"/root/testdata/sf{sys.argv[1]}"
    wanted = sys.argv[2:]
    spark = local_session(8, 8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    failed = []
    for name, function in catalogue.queries().items():
        if wanted and not any(w in name for w in wanted):
            continue
        try:
            problem, took, n = compare(spark, con, folder, function, catalogue.twins().get(name))
        except Exception as error:  # report and go on
            problem, took, n = f"{type(error).__name__}: {str(error)[:1500]}", 0.0, -1
        mark = "ok " if problem is None else "BAD"
        print(f"{mark} {name} rows={n} {took:.2f}s{'' if name in catalogue.twins() else ' (no twin)'}", flush=True)
        if problem:
            failed.append(name)
            print("   ", problem, flush=True)
    print("failed:", failed)

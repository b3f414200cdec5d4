"""Run queries beside their SQL and compare rows: python tests/compare.py [--sf DIR] NAME..."""

from __future__ import annotations

import hashlib
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def session():
    """A local session like the one of the tests."""
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def norm(x):
    """A value in a form both engines share."""
    if isinstance(x, float):
        return None if math.isnan(x) else f"{x:.9g}"
    if isinstance(x, (list, tuple)) or hasattr(x, "tolist"):
        return str([norm(v) for v in x])
    if x is None or isinstance(x, (int, bool)):
        return None if x is None else str(int(x))
    if type(x).__name__ in ("Decimal",):
        return f"{float(x):.9g}"
    return str(x)


def rows_of(cols, rows):
    """Rows with columns by name, sorted."""
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(str(norm(r[i])) for i in order) for r in rows)


def duck(d):
    """A connection with the tables of a folder as views."""
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'; SET enable_progress_bar=false")
    for f in os.listdir(d):
        if f.endswith(".parquet"):
            p = f"{d}/{f}/*.parquet" if os.path.isdir(f"{d}/{f}") else f"{d}/{f}"
            con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{p}'")
    return con


def compare(spark, con, name, run, sql, d):
    """Print one line for a query; True if it agrees."""
    t = time.time()
    df = run(spark, d)
    got = df.collect()
    took = time.time() - t
    if not sql:
        print(f"{name}: rows {len(got)} in {took:.1f}s (no SQL)", flush=True)
        return True
    cur = con.execute(sql)
    cols, want = [c[0] for c in cur.description], cur.fetchall()
    a, b = rows_of(df.columns, got), rows_of(cols, want)
    same = sorted(df.columns) == sorted(cols) and a == b
    print(f"{name}: {'ok' if same else 'DIFFERENT'} {len(a)}/{len(b)} rows in {took:.1f}s {hashlib.md5(str(a).encode()).hexdigest()[:6]}", flush=True)
    if not same:
        print("   cols", sorted(df.columns), sorted(cols))
        print("   only here", list(set(a) - set(b))[:3], "\n   only SQL", list(set(b) - set(a))[:3])
    return same


if __name__ == "__main__":
    import traceback

    import __spark_entry__ as e

    args = sys.argv[1:]
    d = "/root/testdata/sf0.01"
    if args[:1] == ["--sf"]:
        d, args = args[1], args[2:]
    spark, con, q, s = session(), duck(d), e.queries(), e.oracle_sql()
    bad = []
    for name in q:
        if not args or any(name == a or name.startswith(a) for a in args):
            try:
                ok = compare(spark, con, name, q[name], s.get(name), d)
            except Exception:
                print(f"{name}: ERROR", traceback.format_exc()[-1800:], flush=True)
                ok = False
            if not ok:
                bad.append(name)
    print("bad:", bad)

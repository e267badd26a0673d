"""Run catalogue queries against their SQL twins: python tests/oracle.py [sf] [name ...]."""

from __future__ import annotations

import datetime
import decimal
import glob
import math
import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def session(app="scrubline", cpus="8", partitions="8"):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName(app)
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", "127.0.0.1").config("spark.driver.bindAddress", "127.0.0.1")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v + 0.0, 6) + 0.0)
    if isinstance(v, decimal.Decimal):
        return repr(round(float(v), 6) + 0.0)
    if isinstance(v, datetime.datetime):
        return v.isoformat(sep=" ")
    return repr(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def duck(folder):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        path = os.path.join(folder, f"{t}.parquet")
        if glob.glob(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def check(spark, con, folder, name, run, sql):
    start = time.time()
    df = run(spark, folder)
    got = df.collect()
    spent = time.time() - start
    if sql is None:
        return "rows", spent, f"{len(got)} rows"
    start = time.time()
    cur = con.execute(sql)
    want = cur.fetchall()
    names = [d[0] for d in cur.description]
    duck_spent = time.time() - start
    if sorted(names) != sorted(df.columns):
        return "FAIL", spent, f"columns {sorted(df.columns)} != {sorted(names)}"
    a, b = rows_of(df.columns, got), rows_of(names, want)
    if a == b:
        return "ok" if a else "EMPTY", spent, f"{len(a)} rows, sql {duck_spent:.2f}s"
    in_a, in_b = set(a), set(b)
    only = [x for x in a if x not in in_b], [x for x in b if x not in in_a]
    shown = str([o[:2] for o in only])[:1200]
    return "FAIL", spent, f"{len(a)} vs {len(b)} rows, differing {len(only[0])}/{len(only[1])}: {shown}"


def main():
    args = sys.argv[1:]
    sf = args.pop(0) if args and args[0].startswith("sf") else "sf0.01"
    folder = f"/root/testdata/{sf}"
    import __spark_entry__ as entry

    queries, sqls = entry.queries(), entry.oracle_sql()
    names = [n for n in queries if not args or any(n == a or (a.endswith("*") and n.startswith(a[:-1])) for a in args)]
    spark, con = session(), duck(folder)
    bad = 0
    for name in names:
        try:
            status, spent, note = check(spark, con, folder, name, queries[name], sqls.get(name))
        except Exception as error:  # report and go on with the next query
            status, spent, note = "ERROR", 0.0, str(error)[:700]
            if os.environ.get("TRACE"):
                traceback.print_exc()
        bad += status in ("FAIL", "ERROR", "EMPTY")
        if status not in ("ok", "rows") or os.environ.get("VERBOSE") or spent > 5:
            print(f"{status:6} {name} {spent:.2f}s {note}", flush=True)
    print(f"{len(names)} queries, {bad} bad", flush=True)


if __name__ == "__main__":
    main()

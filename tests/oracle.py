"""Compare registered queries with their SQL twins, order-insensitively."""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations").split()


def canon(v):
    if v is None:
        return None
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6) + 0.0
    if isinstance(v, bool):
        return v
    if isinstance(v, int):
        return float(v)
    if isinstance(v, (list, tuple)):
        return tuple(canon(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, canon(x)) for k, x in v.items()))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    if hasattr(v, "asDict"):
        return canon(v.asDict())
    return v


def connect(d):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{d}/{t}.parquet'")
    return con


def rows_of_spark(df):
    cols = sorted(df.columns)
    return cols, sorted((tuple(canon(r[c]) for c in cols) for r in df.collect()), key=repr), dict(df.dtypes)


def rows_of_sql(con, sql):
    cur = con.execute(sql)
    names = [x[0] for x in cur.description]
    cols = sorted(names)
    at = [names.index(c) for c in cols]
    types = {x[0]: str(x[1]) for x in cur.description}
    return cols, sorted((tuple(canon(r[i]) for i in at) for r in cur.fetchall()), key=repr), types


def compare(spark, d, name, fn, sql):
    t = time.time()
    c1, r1, t1 = rows_of_spark(fn(spark, d))
    took = time.time() - t
    if sql is None:
        return f"rows-only {len(r1)}", took, len(r1) >= 0
    c2, r2, t2 = rows_of_sql(connect(d), sql)
    if c1 != c2:
        return f"COLUMNS {c1} != {c2}", took, False
    if r1 != r2:
        s1, s2 = set(map(repr, r1)), set(map(repr, r2))
        only1, only2 = sorted(s1 - s2)[:3], sorted(s2 - s1)[:3]
        return f"ROWS spark={len(r1)} sql={len(r2)}\n   spark only {len(s1-s2)}: {only1}\n   sql only {len(s2-s1)}: {only2}", took, False
    return f"ok {len(r1)}", took, True


if __name__ == "__main__":
    sys.path.insert(0, __file__.rsplit("/", 2)[0])
    from __spark_entry__ import oracle_sql, queries
    from pyspark.sql import SparkSession

    d = sys.argv[1]
    pick = sys.argv[2:]
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    qs, os_ = queries(), oracle_sql()
    bad = 0
    for name, fn in qs.items():
        if pick and not any(p in name for p in pick):
            continue
        try:
            msg, took, ok = compare(spark, d, name, fn, os_.get(name))
        except Exception as e:  # noqa: BLE001
            msg, took, ok = f"ERROR {type(e).__name__}: {str(e)[:900]}", 0, False
        bad += not ok
        print(f"{'  ' if ok else '!!'} {name:32s} {took:6.2f}s {msg}", flush=True)
    print("failed:", bad)

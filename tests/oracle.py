"""Compare registered queries with their SQL.  python tests/oracle.py <sf> [name ...]"""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if hasattr(v, "tzinfo") and v.tzinfo is not None:
        return v.replace(tzinfo=None)
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


def difference(df, con, sql):
    """None when both give the same columns and the same rows, else a description."""
    got = df.collect()
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    types = dict(zip(names, (str(d[1]) for d in cur.description)))
    want = cur.fetchall()
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    a, b = rows_of(df.columns, got), rows_of(names, want)
    if not got:
        return "no rows"
    odd = [t for t in types.values() if "HUGEINT" in t or "DECIMAL" in t]
    if odd:
        return f"types {types}"
    if a != b:
        return f"{len(got)} against {len(want)} rows; only Spark {list((a - b).items())[:3]}; only SQL {list((b - a).items())[:3]}"
    return None


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    folder = f"/root/testdata/sf{sys.argv[1]}"
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false").config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    for option in [a for a in sys.argv[2:] if "=" in a]:
        spark.conf.set(*option.split("=", 1))
    wanted = [a for a in sys.argv[2:] if "=" not in a]
    con, queries, sql = connect(folder), e.queries(), e.oracle_sql()
    bad = 0
    for name in wanted or queries:
        start = time.time()
        try:
            df = queries[name](spark, folder)
            result = difference(df, con, sql[name]) if name in sql else f"rows only: {df.count()}"
        except Exception as x:
            result = f"{type(x).__name__}: {str(x)[:1500]}"
        bad += result is not None and not result.startswith("rows only")
        print(f"{'ok  ' if result is None else '    '} {name} {time.time() - start:.1f}s {result or ''}", flush=True)
    print("bad", bad)

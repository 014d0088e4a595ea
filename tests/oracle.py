"""Runs registered queries against DuckDB on the same tables. As a script: python tests/oracle.py [NAME...]."""

import math
import os
import sys
import time

SF = os.environ.get("SF_DIR", "/root/testdata/sf0.001")


def plain(v):
    if v is None:
        return "null"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)  # every bit: queries round on both sides
    if isinstance(v, int):
        return repr(float(v))
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(plain(x) for x in v) + "]"
    if hasattr(v, "is_finite"):
        return repr(float(v))
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(plain(r[i]) for i in order) for r in rows)


def connect(sf):
    import duckdb

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def compare(spark, con, sf, query, sql):
    """An empty string if both give the same columns and rows, else what differs."""
    df = query(spark, sf)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    want = rows_of([d[0] for d in cur.description], cur.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} {want[0]}"
    if got[1] != want[1]:
        a, b = set(got[1]), set(want[1])
        return f"{len(got[1])} and {len(want[1])} rows; only here {sorted(a - b)[:2]}; only there {sorted(b - a)[:2]}"
    return "" if got[1] or sf.endswith("0.001") else "no rows"


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from pyspark.sql import SparkSession

    from lodestone.plans import catalog

    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "6g").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(SF)
    for name in sys.argv[1:] or catalog.QUERIES:
        began = time.time()
        try:
            out = compare(spark, con, SF, catalog.QUERIES[name], catalog.ORACLES[name]) if name in catalog.ORACLES else f"({catalog.QUERIES[name](spark, SF).count()} rows, no oracle)"
        except Exception as e:
            out = f"{type(e).__name__}: {str(e)[:700]}"
        print(f"{name} {time.time() - began:.1f}s {out or 'same'}", flush=True)

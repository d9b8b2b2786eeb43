"""Compare a registered Spark query with its DuckDB oracle: rows, column names, values.

Usage: python -m tests.oracle_compare [sf_dir] [name ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys

import duckdb

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6)
    if isinstance(v, decimal.Decimal):
        return str(v.normalize()) if v == v else None
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return _norm(tuple(v))
    if hasattr(v, "tolist"):
        return _norm(v.tolist())
    return v


def rows_of_spark(df):
    cols = sorted(df.columns)
    return cols, [tuple(_norm(r[c]) for c in cols) for r in df.select(*cols).collect()]


def rows_of_duck(con, sql):
    rel = con.sql(sql)
    names = rel.columns
    order = sorted(range(len(names)), key=lambda i: names[i])
    data = rel.fetchall()
    return [names[i] for i in order], [tuple(_norm(r[i]) for i in order) for r in data]


def compare(spark, name: str, sf_dir: str, con=None, verbose=True) -> bool:
    import __spark_entry__ as E
    con = con or duck(sf_dir)
    sc, sr = rows_of_spark(E.queries()[name](spark, sf_dir))
    sql = E.oracle_sql().get(name)
    if sql is None:
        if verbose:
            print(f"{name}: rows-only ({len(sr)} rows)")
        return True
    dc, dr = rows_of_duck(con, sql)
    ok = sc == dc and len(sr) == len(dr) and sorted(sr, key=repr) == sorted(dr, key=repr)
    if verbose:
        print(f"{name}: {'OK' if ok else 'MISMATCH'} spark={len(sr)} duck={len(dr)}")
        if not ok:
            if sc != dc:
                print("  spark cols", sc, "\n  duck  cols", dc)
            a, b = set(map(repr, sr)), set(map(repr, dr))
            for x in sorted(a - b)[:3]:
                print("  only spark:", x[:400])
            for x in sorted(b - a)[:3]:
                print("  only duck :", x[:400])
    return ok


if __name__ == "__main__":
    sys.path.insert(0, ".")
    from cdmspark.session import get_spark
    import __spark_entry__ as E
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or sorted(E.queries())
    spark = get_spark()
    con = duck(sf)
    bad = [n for n in names if not compare(spark, n, sf, con)]
    print("FAILED:", bad if bad else "none")

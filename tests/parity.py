"""Compare registered queries with their SQL on DuckDB.

    python tests/parity.py [--sf /root/testdata/sf0.01] [name-prefix ...]
"""

from __future__ import annotations

import argparse
import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def normal(value):
    if isinstance(value, float) and math.isnan(value):
        return None
    return value


def sort_key(row):
    return tuple((v is None, str(type(v)), str(v)) for v in row)


def spark_rows(df):
    columns = sorted(df.columns)
    rows = [tuple(normal(x) for x in r) for r in df.select(*[f"`{c}`" for c in columns]).collect()]
    return columns, rows


def duck_rows(con, sql):
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], [tuple(normal(row[i]) for i in order) for row in result.fetchall()]


def compare(spark, con, sf_dir, fn, sql) -> tuple[str, int]:
    """'ok', 'rows-only' or a description of the first difference, and the row count."""
    columns, got = spark_rows(fn(spark, sf_dir))
    if sql is None:
        return "rows-only", len(got)
    names, want = duck_rows(con, sql)
    if columns != names:
        return f"columns differ: {sorted(set(columns) ^ set(names))}", len(got)
    if len(got) != len(want):
        return f"row counts differ: spark {len(got)}, sql {len(want)}", len(got)
    got.sort(key=sort_key)
    want.sort(key=sort_key)
    bad = [(g, w) for g, w in zip(got, want) if list(map(repr, g)) != list(map(repr, w))]
    if bad:
        return f"{len(bad)} rows differ over {columns}; first: {bad[0]}", len(got)
    return "ok", len(got)


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(args.sf)
    sql = entry.oracle_sql()
    failures = 0
    for name, fn in entry.queries().items():
        if args.names and not any(name.startswith(p) for p in args.names):
            continue
        start = time.time()
        try:
            status, n = compare(spark, con, args.sf, fn, sql.get(name))
        except Exception as error:  # noqa: BLE001
            status, n = f"{type(error).__name__}: {str(error)[:900]}", -1
        flag = "  " if status in ("ok", "rows-only") else "!!"
        failures += flag == "!!"
        if n == 0 and flag != "!!":
            flag = "??"
        print(f"{flag} {name:32s} {n:8d} rows {time.time() - start:6.1f}s  {status[:1500]}", flush=True)
    print(f"failures: {failures}")
    return failures


if __name__ == "__main__":
    sys.exit(main())

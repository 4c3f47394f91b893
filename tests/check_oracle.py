"""Runs the registered queries beside their oracle SQL: python tests/check_oracle.py [names]."""

import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

import __spark_entry__ as entry  # noqa: E402
from docwarden.session import build_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages"
    " benchmark labels conversations"
).split()


def oracle_connection(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def normalise(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(repr(r[i]) for i in order) for r in rows)


def compare(spark, con, name, run, sql, sf_dir):
    df = run(spark, sf_dir)
    got = normalise(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return None, len(got[1])
    cursor = con.execute(sql)
    expected = normalise([c[0] for c in cursor.description], cursor.fetchall())
    if got == expected:
        return "", len(got[1])
    a, b = set(got[1]), set(expected[1])
    return (
        f"columns {got[0]} / {expected[0]}; rows {len(got[1])} / {len(expected[1])};"
        f" only spark {sorted(a - b)[:2]}; only oracle {sorted(b - a)[:2]}"
    ), len(got[1])


if __name__ == "__main__":
    sf = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    spark = build_session("oracle", master="local[8]", conf={
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls = oracle_connection(sf), entry.oracle_sql()
    names = sys.argv[1:] or list(entry.queries())
    bad = 0
    for name in names:
        start = time.time()
        try:
            message, rows = compare(spark, con, name, entry.queries()[name], sqls.get(name), sf)
        except Exception as error:  # noqa: BLE001
            message, rows = "ERROR " + str(error)[:600], -1
        bad += bool(message)
        state = "rows-only" if message is None else ("ok" if message == "" else "DIFF " + message)
        print(f"{name:28s} {time.time() - start:6.2f}s {rows:7d} {state}", flush=True)
    print("failed:", bad)

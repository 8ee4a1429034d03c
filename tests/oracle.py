"""Compare queries with their SQL on the given tables: python tests/oracle.py [sf] [names...]"""

import datetime
import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connection(sf_dir):
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return db


def plain(value):
    if value is None or isinstance(value, (str, bool, datetime.datetime)):
        return (str(type(value)), value)
    if isinstance(value, float) and math.isfinite(value) and value == int(value):
        return ("number", str(int(value)))
    return ("number", str(value))


def sorted_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(str([plain(r[i]) for i in order]) for r in rows)


def compare(spark, name, query, sql, sf_dir, db):
    """'' if both agree, else what differs."""
    start = time.time()
    df = query(spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    took = time.time() - start
    note = f"{len(rows)} rows {took:.1f}s"
    if sql is None:
        return "" if rows else "no rows", note
    result = db.execute(sql)
    columns = [d[0] for d in result.description]
    expected = result.fetchall()
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} / {sorted(columns)}", note
    mine, theirs = sorted_rows(df.columns, rows), sorted_rows(columns, expected)
    if mine == theirs:
        return ("" if rows else "no rows"), note
    a, b = set(mine) - set(theirs), set(theirs) - set(mine)
    return f"{len(mine)}/{len(theirs)} rows\n  spark {sorted(a)[:3]}\n  sql   {sorted(b)[:3]}", note


def main(argv):
    import __spark_entry__ as entry
    from relspark.session import local_session

    sf_dir = f"/root/testdata/sf{argv[0] if argv else '0.01'}"
    spark = local_session("oracle", 8)
    spark.sparkContext.setLogLevel("ERROR")
    db = connection(sf_dir)
    sqls = entry.oracle_sql()
    for name, query in entry.queries().items():
        if argv[1:] and name not in argv[1:]:
            continue
        try:
            wrong, note = compare(spark, name, query, sqls.get(name), sf_dir, db)
        except Exception as error:  # noqa: BLE001
            wrong, note = f"{type(error).__name__} {str(error)[:1500]}", ""
        print("ok  " if not wrong else "FAIL", name, note, wrong, flush=True)


if __name__ == "__main__":
    main(sys.argv[1:])

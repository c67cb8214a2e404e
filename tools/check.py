"""Run registered queries against DuckDB: ``python tools/check.py [sf] [name ...]``."""

from __future__ import annotations

import datetime
import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return con


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(_cell(v) for v in value) + "]"
    return repr(value)


def canonical(columns: list[str], rows) -> list[tuple]:
    places = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(row[i]) for i in places) for row in rows)


def spark_type(name: str) -> str:
    return {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "int": "INTEGER"}.get(name, name)


def compare(df, con, sql: str) -> str:
    """Empty text when both sides agree, else what differs."""
    relation = con.execute(sql)
    columns = [d[0] for d in relation.description]
    kinds = dict(zip(columns, [str(d[1]) for d in relation.description]))
    expected = canonical(columns, relation.fetchall())
    if sorted(df.columns) != sorted(columns):
        return f"columns {sorted(df.columns)} vs {sorted(columns)}"
    actual = canonical(df.columns, [tuple(r) for r in df.collect()])
    if len(actual) != len(expected):
        return f"rows {len(actual)} vs {len(expected)}"
    odd = [c for c, t in df.dtypes if spark_type(t) != kinds[c]]
    for a, e in zip(actual, expected):
        if a != e:
            bad = sum(x != y for x, y in zip(actual, expected))
            return f"{bad}/{len(actual)} rows differ, first\n   spark {a}\n   duck  {e}"
    return f"types differ: {[(c, dict(df.dtypes)[c], kinds[c]) for c in odd]}" if odd else ""


def main() -> None:
    from wayfold.plans import ORACLES, QUERIES
    from wayfold.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.001"
    names = sys.argv[2:] or list(QUERIES)
    folder = f"/root/testdata/sf{sf}"
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    failed = 0
    for name in names:
        start = time.time()
        try:
            df = QUERIES[name](spark, folder)
            if name in ORACLES:
                problem = compare(df, con, ORACLES[name])
            else:
                problem = "" if df.count() else "no rows"
        except Exception as error:  # noqa: BLE001 - a report tool shows every failure
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        failed += bool(problem)
        print(f"{'FAIL' if problem else 'ok  '} {name} {time.time() - start:.2f}s {problem}", flush=True)
    print(f"{len(names) - failed}/{len(names)} agree")


if __name__ == "__main__":
    main()

"""Compare registered queries with their DuckDB oracles on one scale directory."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def normal(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 6) + 0.0)
    if isinstance(value, bool) or value is None:
        return value
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([normal(r[i]) for i in order] for r in rows), key=lambda r: [(v is None, str(v)) for v in r])


def compare(spark, con, name, fn, sql, sf_dir):
    """None when equal, else a short description of the difference."""
    frame = fn(spark, sf_dir)
    got_rows = [tuple(r) for r in frame.collect()]
    if sql is None:
        return None
    cursor = con.execute(sql)
    want_columns = [d[0] for d in cursor.description]
    want_rows = cursor.fetchall()
    if sorted(frame.columns) != sorted(want_columns):
        return f"columns {sorted(frame.columns)} != {sorted(want_columns)}"
    got, want = rows_of(frame.columns, got_rows), rows_of(want_columns, want_rows)
    kinds = {c: t for c, t in frame.dtypes}
    for column, kind in kinds.items():
        if kind.startswith(("array", "map", "struct", "variant", "decimal")):
            return f"column {column} has type {kind}"
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}"
    if not got:
        return "no rows"
    for a, b in zip(got, want):
        if a != b:
            return f"row differs:\n  cols {sorted(frame.columns)}\n  got  {a}\n  want {b}"
    types = {d[0]: str(d[1]) for d in con.execute(f"DESCRIBE {sql}").fetchall()}
    same = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
            "timestamp": "TIMESTAMP", "date": "DATE"}
    odd = {c: (k, types[c]) for c, k in kinds.items() if same.get(k) != types[c]}
    return f"types {odd}" if odd else None


def main(patterns):
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from evalspark.session import build_session
    import __spark_entry__ as entry

    sf_dir = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.01")
    spark = build_session("check", "local[8]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connect(sf_dir), 0
    queries, oracles = entry.queries(), entry.oracle_sql()
    for name, fn in queries.items():
        if patterns and not any(p in name for p in patterns):
            continue
        start = time.time()
        try:
            problem = compare(spark, con, name, fn, oracles.get(name), sf_dir)
        except Exception as exc:  # noqa: BLE001
            problem = f"{type(exc).__name__}: {str(exc)[:1500]}"
        bad += problem is not None
        mark = "ok  " if problem is None else "FAIL"
        print(f"{mark} {name} {time.time() - start:.1f}s{'' if name in oracles else ' (no oracle)'}{'' if problem is None else ' ' + problem}", flush=True)
    print("failed:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)

"""Compare every query with its SQL oracle: names, row counts and values.

Usage: python tests/oracle_check.py SF_DIR [query...]
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def _rows(names: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=repr)


def compare(spark, con, sf: str, name: str, query, sql: str) -> str | None:
    """None if both give the same rows, else what differs first."""
    df = query(spark, sf)
    spark_rows = [tuple(r) for r in df.collect()]
    cur = con.execute(sql)
    sql_names = [d[0] for d in cur.description]
    if sorted(df.columns) != sorted(sql_names):
        return f"columns {sorted(df.columns)} != {sorted(sql_names)}"
    a, b = _rows(df.columns, spark_rows), _rows(sql_names, cur.fetchall())
    if len(a) != len(b):
        return f"{len(a)} rows != {len(b)} rows"
    for x, y in zip(a, b):
        if repr(x) != repr(y):
            return f"\n  spark {str(x)[:600]}\n  sql   {str(y)[:600]}"
    return None


def main() -> int:
    import __spark_entry__ as entry
    from blockloom.session import local_session

    sf = sys.argv[1]
    spark = local_session(cores="8")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    queries, oracle = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in sys.argv[2:] or queries:
        if name not in oracle:
            print(f"{name:24s} no oracle")
            continue
        start = time.time()
        try:
            problem = compare(spark, con, sf, name, queries[name], oracle[name])
        except Exception as e:  # report and go on with the next query
            problem = f"{type(e).__name__}: {str(e)[:800]}"
        bad += problem is not None
        print(f"{name:24s} {'ok' if problem is None else 'DIFFERS ' + problem} ({time.time() - start:.1f}s)", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main())

"""Run queries and their SQL twins side by side and report differences.

    python tests/compare.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "null" if math.isnan(value) else repr(value + 0.0)
    if value is None:
        return "null"
    if isinstance(value, (list, tuple)):
        return [_plain(v) for v in value]
    return str(value)


def normalized(columns: list[str], rows: list[tuple]) -> tuple[list[str], list[list]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(([_plain(r[i]) for i in order] for r in rows), key=repr)


def differences(df, con: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    """What differs between a frame and a SQL result; empty when nothing does."""
    mine = normalized(df.columns, [tuple(r) for r in df.collect()])
    result = con.execute(sql)
    theirs = normalized([d[0] for d in result.description], result.fetchall())
    found = []
    if mine[0] != theirs[0]:
        return [f"columns {mine[0]} != {theirs[0]}"]
    if len(mine[1]) != len(theirs[1]):
        found.append(f"rows {len(mine[1])} != {len(theirs[1])}")
    for a, b in zip(mine[1], theirs[1]):
        if a != b:
            found.append(f"{str(a)[:400]}\n    != {str(b)[:400]}")
            break
    return found


def main(sf_dir: str, names: list[str]) -> int:
    from __spark_entry__ import oracle_sql, queries
    from tapeloom.session import build_session

    spark = build_session(
        master="local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false", spark__driver__memory="8g"
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, sql, bad = database(sf_dir), oracle_sql(), 0
    for name, run in queries().items():
        if names and name not in names:
            continue
        started = time.time()
        try:
            if name in sql:
                found = differences(run(spark, sf_dir), con, sql[name])
                rows = con.execute(f"SELECT count(*) FROM ({sql[name]})").fetchone()[0]
            else:
                found, rows = [], len(run(spark, sf_dir).collect())
        except Exception as error:
            found, rows = [f"{type(error).__name__}: {str(error)[:600]}"], -1
        bad += bool(found)
        state = "DIFF" if found else ("ok" if name in sql else "rows")
        print(f"{state:5} {name:32} {rows:7} rows {time.time() - started:6.2f}s", *found, sep="\n    " if found else " ", flush=True)
    return bad


if __name__ == "__main__":
    args = sys.argv[1:]
    folder = args[0] if args else "/root/testdata/sf0.01"
    sys.exit(1 if main(folder, args[1:]) else 0)

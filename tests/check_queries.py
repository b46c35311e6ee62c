"""Compare registered queries with their SQL in DuckDB: python -m tests.check_queries SF_DIR [name ...]"""

from __future__ import annotations

import datetime as dt
import math
import sys
import time
from pathlib import Path

import duckdb

import __spark_entry__ as entry
from gaugeframe.session import build_session, local_cores

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{Path(sf_dir) / (t + '.parquet')}')")
    return con


def plain(value: object) -> object:
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, dt.date):
        return value.isoformat()
    if isinstance(value, float) and math.isnan(value):
        return "NaN"
    if isinstance(value, float) and value == 0:
        return 0.0
    return value


def table(columns: list[str], rows: list[tuple]) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    shaped = [tuple(plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(shaped, key=lambda r: [(v is None, str(type(v)), v) for v in r])


def difference(spark_df, con: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """None if names, types of values and values agree."""
    left = table(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    result = con.execute(sql)
    right = table([d[0] for d in result.description], result.fetchall())
    if left[0] != right[0]:
        return f"columns {left[0]} and {right[0]}"
    if len(left[1]) != len(right[1]):
        return f"{len(left[1])} and {len(right[1])} rows"
    for a, b in zip(left[1], right[1]):
        if a != b or [type(x) for x in a] != [type(x) for x in b]:
            return f"row {a} and {b}"
    return None


def main() -> None:
    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark = build_session(master=f"local[{local_cores()}]", spark__ui__enabled="false", spark__sql__shuffle__partitions="8", spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    con, checks = database(sf_dir), entry.oracle_sql()
    failed = []
    for name, run in entry.queries().items():
        if names and not any(name.startswith(n) for n in names):
            continue
        start = time.time()
        try:
            if name in checks:
                problem = difference(run(spark, sf_dir), con, checks[name])
                outcome = problem or "equal"
            else:
                problem, outcome = None, f"{run(spark, sf_dir).count()} rows, no SQL"
        except Exception as e:
            problem = outcome = f"{type(e).__name__}: {str(e)[:600]}"
        if problem:
            failed.append(name)
        print(f"{name:36s} {time.time() - start:6.2f}s {outcome}", flush=True)
    print(f"{len(failed)} failed: {failed}")
    sys.exit(bool(failed))


if __name__ == "__main__":
    main()

"""Run registered queries in Spark and their SQL in DuckDB, and compare the rows."""

from __future__ import annotations

import datetime
import decimal
import sys
import tempfile
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def oracle_connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _plain(value: object) -> object:
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, float):
        return 0.0 if value == 0 else value
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, _plain(v)) for k, v in value.items()))
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    return value


def normal_rows(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_plain(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda r: tuple((v is None, type(v).__name__, str(v)) for v in r))


def compare(spark, sf_dir: str, con, build, sql: str | None) -> tuple[str, float, int]:
    start = time.time()
    df = build(spark, sf_dir)
    mine = normal_rows(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - start
    if sql is None:
        return "no-sql", took, len(mine)
    rel = con.execute(sql)
    columns = [c[0] for c in rel.description]
    theirs = normal_rows(columns, rel.fetchall())
    if sorted(df.columns) != sorted(columns):
        return f"columns {sorted(df.columns)} vs {sorted(columns)}", took, len(mine)
    if mine == theirs:
        return "ok", took, len(mine)
    only_mine = [r for r in mine if r not in set(theirs)][:3]
    only_theirs = [r for r in theirs if r not in set(mine)][:3]
    return f"rows {len(mine)} vs {len(theirs)}; spark {only_mine}; sql {only_theirs}", took, len(mine)


def main(sf: str, prefixes: list[str]) -> None:
    sys.path.insert(0, ".")
    import __spark_entry__ as entry
    from faultline.session import local_session, release

    spark = local_session(8, folder=tempfile.mkdtemp(prefix="harness-"))
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir = f"/root/testdata/sf{sf}"
    con = oracle_connection(sf_dir)
    oracles = entry.oracle_sql()
    for name, build in entry.queries().items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        try:
            verdict, took, rows = compare(spark, sf_dir, con, build, oracles.get(name))
        except Exception as exc:  # report every query, then go on
            verdict, took, rows = f"FAILED {type(exc).__name__}: {str(exc)[:600]}", 0.0, 0
        print(f"{name:32s} {took:6.2f}s {rows:7d} {verdict}", flush=True)
    release(spark)


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])

"""Run registered queries next to their SQL twins in DuckDB and compare the rows.

    python -m catalog.check [--sf DIR] [name ...]
"""

from __future__ import annotations

import argparse
import glob
import math
import os
import sys
import time

import duckdb

from docketry.session import local_session

SAME_TYPE = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
             "boolean": "BOOLEAN", "float": "FLOAT"}
SF = "/root/testdata/sf0.01"


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"create view {name} as select * from read_parquet('{path}')")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    return value


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(_plain(row[i]) for i in order) for row in rows]
    return sorted(plain, key=repr)


def compare(spark, con, query, sql: str | None, sf_dir: str) -> str:
    df = query(spark, sf_dir)
    mine = rows_of(df.columns, df.collect())
    if sql is None:
        return f"rows only: {len(mine)}"
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    theirs = rows_of(columns, result.fetchall())
    if sorted(columns) != sorted(df.columns):
        return f"DIFF columns {sorted(df.columns)} / {sorted(columns)}"
    if mine == theirs:
        types = {d[0]: str(d[1]) for d in result.description}
        other = [f"{n} {t} / {types[n]}" for n, t in df.dtypes if types[n] != SAME_TYPE.get(t)]
        return f"ok {len(mine)} rows {'types: ' + ', '.join(other) if other else ''}"
    a, b = set(mine), set(theirs)
    only = [sorted(x, key=repr)[:2] for x in (a - b, b - a)]
    return f"DIFF {len(mine)} / {len(theirs)} rows, {len(a - b)} differ; {only}"


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default=SF)
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    from .oracles import ORACLES
    from .queries import QUERIES

    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(args.sf)
    bad = 0
    for name in args.names or QUERIES:
        start = time.time()
        try:
            verdict = compare(spark, con, QUERIES[name], ORACLES.get(name), args.sf)
        except Exception as error:  # report and go on with the next query
            verdict = f"FAIL {type(error).__name__}: {str(error)[:600]}"
        bad += not verdict.startswith(("ok", "rows only"))
        print(f"{name:28} {time.time() - start:6.1f}s  {verdict[:900]}", flush=True)
    print(f"{bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(main())

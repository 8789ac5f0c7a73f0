"""Compare every query with its SQL: ``python -m workload.check [sf_dir] [names]``."""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb
from pyspark.sql import SparkSession

from workload.oracles import ORACLES
from workload.queries import QUERIES


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"create view {path.stem} as select * from read_parquet('{path}')")
    return con


def _cell(v):
    return "NaN" if isinstance(v, float) and math.isnan(v) else v


def spark_rows(df) -> tuple[list[str], Counter]:
    columns = sorted(df.columns)
    return columns, Counter(tuple(_cell(v) for v in r) for r in df.select(*columns).collect())


def sql_rows(con, sql: str) -> tuple[list[str], Counter]:
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    columns = sorted(names)
    order = [names.index(c) for c in columns]
    return columns, Counter(tuple(_cell(r[i]) for i in order) for r in result.fetchall())


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark, con = session(), connection(sf_dir)
    bad = 0
    for name in names:
        start = time.time()
        columns, rows = spark_rows(QUERIES[name](spark, sf_dir))
        took = time.time() - start
        start = time.time()
        if name not in ORACLES:
            print(f"{name:24} rows={sum(rows.values())} {took:.1f}s, no SQL")
            continue
        other_columns, other = sql_rows(con, ORACLES[name])
        same = columns == other_columns and rows == other
        bad += not same
        print(f"{name:24} {'ok' if same else 'DIFFERENT'} rows={sum(rows.values())} {took:.1f}s sql {time.time() - start:.1f}s")
        if not same:
            print("   columns", columns, other_columns)
            print("   only spark", list((rows - other).items())[:3])
            print("   only sql  ", list((other - rows).items())[:3])
    sys.exit(1 if bad else 0)


if __name__ == "__main__":
    main()

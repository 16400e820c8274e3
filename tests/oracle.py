"""Runs registered queries beside their SQL and reports differences in columns, types and values."""

from __future__ import annotations

import datetime
import decimal
import glob
import os
import sys
import time

import duckdb

ROOT = os.environ.get("TESTDATA", "/root/testdata")


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW \"{name}\" AS SELECT * FROM '{path}'")
    return con


def family(kind: str) -> str:
    kind = kind.lower()
    if kind in ("int", "integer", "smallint", "tinyint"):
        return "int"
    if kind in ("bigint", "hugeint", "long"):
        return "bigint"
    if kind in ("varchar", "string"):
        return "string"
    return "timestamp" if kind.startswith("timestamp") else kind


def plain(value):
    if isinstance(value, float):
        return float(f"{value:.12g}")
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return value


def rows_of(columns: list[str], rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(row[i]) for i in order) for row in rows]
    return [columns[i] for i in order], sorted(out, key=repr)


def compare(spark, con, run, sql: str, sf_dir: str) -> list[str]:
    """Differences between a Spark query and its SQL; empty when they agree."""
    df = run(spark, sf_dir)
    got_columns, got = rows_of(df.columns, df.collect())
    result = con.execute(sql)
    kinds = {d[0]: str(d[1]) for d in result.description}
    want_columns, want = rows_of([d[0] for d in result.description], result.fetchall())
    problems = []
    if got_columns != want_columns:
        return [f"columns {got_columns} <> {want_columns}"]
    for name, kind in df.dtypes:
        if family(kind) != family(kinds[name]):
            problems.append(f"type of {name}: {kind} <> {kinds[name]}")
    if len(got) != len(want):
        problems.append(f"rows {len(got)} <> {len(want)}")
    if got != want:
        extra, missing = set(got) - set(want), set(want) - set(got)
        problems.append(f"values: {sorted(extra, key=repr)[:2]} <> {sorted(missing, key=repr)[:2]}")
    return problems


def main(names: list[str]) -> int:
    from pyspark.sql import SparkSession

    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry

    sf_dir = f"{ROOT}/{os.environ.get('SF', 'sf0.01')}"
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    failed = 0
    for name, run in entry.queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            problems = compare(spark, con, run, entry.oracle_sql()[name], sf_dir)
        except Exception as error:  # report and go on to the next query
            problems = [f"{type(error).__name__}: {str(error)[:600]}"]
        failed += bool(problems)
        print(f"{'FAIL' if problems else 'ok  '} {name} {time.time() - start:.1f}s {problems or ''}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(min(1, main(sys.argv[1:])))

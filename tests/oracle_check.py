"""Runs registered queries in Spark and DuckDB on one folder and compares whole results."""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in sorted(Path(folder).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def _cell(value):
    return None if isinstance(value, float) and math.isnan(value) else value


def _bag(names, rows) -> Counter:
    order = sorted(range(len(names)), key=names.__getitem__)
    return Counter(tuple(_cell(row[i]) for i in order) for row in rows)


def compare(df, con, sql: str) -> str | None:
    """None when the two results are the same bag of rows, otherwise what differs."""
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    kinds = {d[0]: str(d[1]).lower() for d in cursor.description}
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    same = {"string": "varchar", "timestamp_ntz": "timestamp", "int": "integer"}
    for name, kind in df.dtypes:
        if same.get(kind, kind) != kinds[name]:
            return f"type of {name}: {kind} != {kinds[name]}"
    left = _bag(df.columns, df.collect())
    right = _bag(names, cursor.fetchall())
    if left != right:
        return f"{left.total()} rows against {right.total()}; only Spark {list((left - right).items())[:2]}; only SQL {list((right - left).items())[:2]}"
    return None


def main(folder: str, wanted: list[str]) -> int:
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry
    from parcelwise.session import tuned

    builder = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
    spark = tuned(builder).config("spark.driver.memory", "8g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    queries, sql = entry.queries(), entry.oracle_sql()
    failed = 0
    print("without SQL:", sorted(set(queries) - set(sql)), "without query:", sorted(set(sql) - set(queries)))
    for name in wanted or sorted(sql):
        start = time.time()
        difference = compare(queries[name](spark, folder), con, sql[name])
        failed += difference is not None
        print(f"{name:40s} {time.time() - start:6.2f}s {difference or 'ok'}", flush=True)
    print(f"{failed} of {len(wanted or sql)} differ")
    return failed


if __name__ == "__main__":
    sys.exit(bool(main(sys.argv[1], sys.argv[2:])))

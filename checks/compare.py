"""Run queries on Spark and DuckDB and compare the results, independent of row order.

    python -m checks.compare [folder] [name-prefix …]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb
import pandas as pd

from checks.registry import TABLES


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = os.path.join(folder, f"{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def _cell(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return "∅"
    if isinstance(v, bool) or type(v).__name__ == "bool_":
        return str(bool(v))
    if isinstance(v, (int, float)) or hasattr(v, "dtype"):
        try:
            return repr(float(v))
        except (TypeError, ValueError):
            return str(v)
    return str(v)


def rows_of(pdf: pd.DataFrame) -> list[tuple]:
    pdf = pdf[sorted(pdf.columns)]
    return sorted(tuple(_cell(v) for v in row) for row in pdf.astype(object).itertuples(index=False))


def differences(spark_pdf: pd.DataFrame, sql_pdf: pd.DataFrame) -> str | None:
    if sorted(spark_pdf.columns) != sorted(sql_pdf.columns):
        return f"columns {sorted(spark_pdf.columns)} against {sorted(sql_pdf.columns)}"
    if len(spark_pdf) != len(sql_pdf):
        return f"{len(spark_pdf)} rows against {len(sql_pdf)}"
    a, b = rows_of(spark_pdf), rows_of(sql_pdf)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return f"{len(bad)} of {len(a)} rows differ ({sorted(spark_pdf.columns)}), e.g. {bad[:2]}"
    return None


def main() -> int:
    from pyspark.sql import SparkSession

    from checks import QUERIES, SQL

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    bad = 0
    for name, run in QUERIES.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            got = run(spark, folder).toPandas()
            took = time.time() - start
            if name in SQL:
                start = time.time()
                problem = differences(got, con.execute(SQL[name]).df())
                sql_took = time.time() - start
            else:
                problem, sql_took = None, 0.0
        except Exception as e:  # noqa: BLE001 - every query is reported
            problem, took, sql_took = f"{type(e).__name__}: {str(e)[:1500]}", time.time() - start, 0.0
        bad += problem is not None
        state = "ok  " if problem is None else "BAD "
        rows = "" if problem else f"{len(got)} rows"
        print(f"{state} {name:32s} {took:6.2f}s sql {sql_took:5.2f}s {rows}{' (no sql)' if name not in SQL else ''}", flush=True)
        if problem:
            print("      " + problem, flush=True)
    print(f"{bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)

"""Queries over the given tables, each with the SQL another engine must agree with."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

# A sales-shaped table: one row per order line.
SALES = """
SELECT o_orderdate AS date, p_type AS product, p_brand AS brand, r_name AS region,
       c_mktsegment AS segment, o_custkey AS customer, l_extendedprice AS revenue,
       l_quantity AS quantity, l_discount AS discount
FROM {lineitem} AS l JOIN {orders} AS o ON l_orderkey = o_orderkey
JOIN {customer} AS c ON o_custkey = c_custkey JOIN {nation} AS n ON c_nationkey = n_nationkey
JOIN {region} AS r ON n_regionkey = r_regionkey JOIN {part} AS p ON l_partkey = p_partkey
"""

# Orders with every defect the quality checks look for.
_DIRTY_ROWS = """
SELECT o_orderkey AS order_id, o_custkey AS customer,
       CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_totalprice END AS total_price,
       CASE WHEN o_orderkey % 50 = 1 THEN o_totalprice * 100 ELSE o_totalprice END AS amount,
       CASE WHEN o_orderkey % 40 = 0 THEN -o_totalprice ELSE o_totalprice END AS net_revenue,
       CASE WHEN o_orderkey % 7 = 0 THEN ' ' || lower(o_orderpriority) ELSE o_orderpriority END AS priority,
       CASE WHEN o_orderkey % 25 = 0 THEN 'bad' WHEN o_orderkey % 3 = 0
            THEN '1,' || lpad(CAST(o_custkey AS STRING), 3, '0')
            ELSE CAST(o_custkey AS STRING) END AS amount_text,
       CASE WHEN o_orderkey % 8 = 0 THEN 'not-a-date'
            ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END AS order_date,
       CASE WHEN o_orderkey % 4 = 0 THEN o_orderstatus ELSE NULL END AS rare_flag,
       'shop' AS source, CAST(NULL AS STRING) AS note
FROM {orders}
"""
DIRTY = _DIRTY_ROWS + " UNION ALL " + _DIRTY_ROWS + " WHERE o_orderkey % 50 = 0"

# Statements about orders, some of them wrong, next to what is true.
CLAIMS = """
SELECT o_orderkey AS claim_id,
       CASE WHEN o_orderkey % 13 = 0 THEN 'Sales will increase. ' ELSE '' END
       || 'The order ' || CAST(o_orderkey + CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END AS STRING)
       || ' came from Customer ' || CAST(o_custkey AS STRING)
       || CASE WHEN o_orderkey % 11 = 0 THEN ' because of the discount' ELSE '' END
       || CASE WHEN o_orderkey % 17 = 0 THEN ' in Atlantis' ELSE '' END
       || ' with status ' || o_orderstatus || ', priority ' || lower(o_orderpriority)
       || CASE WHEN o_orderkey % 19 = 0 THEN ', twice the usual; an extreme o_totalprice spike.' ELSE '.' END AS claim,
       'order ' || CAST(o_orderkey AS STRING) || ' customer ' || CAST(o_custkey AS STRING)
       || ' status ' || o_orderstatus || ' priority '
       || CASE WHEN o_orderkey % 23 = 0 THEN 'unknown' ELSE lower(o_orderpriority) END AS evidence,
       'Which customer placed the order and with what priority?' AS question
FROM {orders}
"""

# Questions of every kind, and pairs of results that agree or not.
QUESTIONS = """
SELECT o_orderkey AS question_id,
       CASE o_orderkey % 11
         WHEN 0 THEN 'Why did total sales of customer ' || CAST(o_custkey AS STRING) || ' drop?'
         WHEN 1 THEN 'What will order ' || CAST(o_orderkey AS STRING) || ' be worth next month?'
         WHEN 2 THEN 'Show a histogram of o_totalprice'
         WHEN 3 THEN 'Draw the trend of ' || o_orderpriority
         WHEN 4 THEN 'Compare ' || o_orderstatus || ' and the rest'
         WHEN 5 THEN 'Which priority has the highest total?'
         WHEN 6 THEN 'top ' || CAST(o_orderkey % 20 AS STRING) || ' customers'
         WHEN 7 THEN 'How many orders have status ' || o_orderstatus || '?'
         WHEN 8 THEN 'A pie chart by status' WHEN 9 THEN 'Revenue forecast please'
         ELSE 'Total for ' || o_orderpriority END AS question,
       'value ' || CAST(o_custkey AS STRING) || ' and ' || CAST(o_orderkey AS STRING) AS printed,
       CASE o_orderkey % 4 WHEN 0 THEN CAST(o_custkey * 100 AS STRING) WHEN 1 THEN CAST(o_custkey + 1 AS STRING)
         WHEN 2 THEN 'n/a' ELSE CAST(o_custkey AS STRING) END AS single
FROM {orders}
"""

VIEWS = {"sales": SALES, "dirty": DIRTY, "claims": CLAIMS, "questions": QUESTIONS}


class Tables:
    """The given tables, and the tables derived from them, by attribute."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        if name in VIEWS:
            used = {t: getattr(self, t) for t in TABLES if "{" + t + "}" in VIEWS[name]}
            return self.spark.sql(VIEWS[name], **used)
        raise AttributeError(name)


def _with_views(sql: str) -> str:
    """Put the derived tables a query names in front of it."""
    plain = {t: t for t in TABLES}
    used = [v for v in VIEWS if re.search(rf"\b{v}\b", sql)]
    ctes = ", ".join(f"{v} AS ({VIEWS[v].format(**plain)})" for v in used)
    text = sql.strip()
    if not ctes:
        return text
    if text[:4].upper() == "WITH":
        return f"WITH {ctes}, {text[4:]}"
    return f"WITH {ctes} {text}"


def _names(text: str) -> list[str]:
    return text.split()


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def add(
    name: str, run: Callable[[Tables], DataFrame], sql: str | None = None,
    f: str = "", dates: str = "", digits: int = 2,
) -> None:
    """Register a query. ``f`` columns are rounded and ``dates`` become text on both sides."""
    floats, days = _names(f), _names(dates)

    def query(spark: SparkSession, folder: str) -> DataFrame:
        df = run(Tables(spark, folder))
        return df.withColumns(
            {c: F.round(F.col(c), digits) + F.lit(0.0) for c in floats}
            | {c: F.col(c).cast("string") for c in days}
        )

    if name in QUERIES:
        raise ValueError(f"{name} is registered twice")
    QUERIES[name] = query
    if sql is None:
        return
    text = _with_views(sql)
    shown = [f'CAST(round("{c}", {digits}) AS DOUBLE) + 0.0::DOUBLE AS "{c}"' for c in floats]
    shown += [f'CAST("{c}" AS VARCHAR) AS "{c}"' for c in days]
    SQL[name] = f"SELECT * REPLACE ({', '.join(shown)}) FROM ({text}) AS q" if shown else text

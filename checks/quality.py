"""The data-quality gate, its report tables and the rows behind findings."""

from __future__ import annotations

from pyspark.sql import functions as F

import gridlore as g
from checks.registry import add

NUM = "try_cast(replace(trim(amount_text), ',', '') AS DOUBLE)"
DATE = "try_cast(order_date AS DATE)"
ROWS = "(SELECT count(*) FROM dirty)"
DUPS = "(SELECT count(*) FROM dirty) - (SELECT count(*) FROM (SELECT DISTINCT * FROM dirty) AS d)"


def pct(part: str, whole: str) -> str:
    return f"round(({part}) * 100.0 / ({whole}), 2)"


def issue(seq: int, name: str, severity: str, columns: str, affected: str, share: str, where: str = "true") -> str:
    return f"""SELECT {seq}::BIGINT AS seq, '{name}' AS issue, {severity} AS severity, '{columns}' AS "columns",
        ({affected})::DOUBLE AS affected_rows, ({share})::DOUBLE AS affected_pct WHERE {where}"""


def block(share: str, limit: int) -> str:
    return f"CASE WHEN {share} >= {limit} THEN 'BLOCKING' ELSE 'WARNING' END"


def count(cond: str) -> str:
    return f"(SELECT count(*) FILTER ({cond}) FROM dirty)"


_MISS_FLAG = pct(count("rare_flag IS NULL"), ROWS)
_BAD_NUM = count(f"{NUM} IS NULL")
_BAD_DATE = count(f"{DATE} IS NULL")
_VARIANTS = """(SELECT sum(n) FROM (SELECT count(*) AS n FROM dirty GROUP BY lower(trim(priority)) HAVING count(*) > 1) AS v)"""
_NEG = count("net_revenue < 0")


def outliers(c: str) -> str:
    return f"""(SELECT count(*) FILTER ({c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) FROM dirty,
        (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM dirty) AS f)"""


PARTS = {
    "dq_empty_columns": [issue(30000, "Completely empty columns", "'BLOCKING'", "note", "NULL", "NULL")],
    "dq_missing_values": [
        issue(50008, "Extremely high missing values", block(_MISS_FLAG, 70), "rare_flag",
              count("rare_flag IS NULL"), _MISS_FLAG),
        issue(50010, "Extremely high missing values", "'BLOCKING'", "note", ROWS, "100.0"),
    ],
    "dq_duplicates": [issue(60000, "Duplicate records", block(pct(DUPS, ROWS), 20), "", DUPS, pct(DUPS, ROWS))],
    "dq_numeric_as_text": [issue(80006, "Numeric values stored as text / mixed numeric type",
                                 block(pct(_BAD_NUM, ROWS), 10), "amount_text", _BAD_NUM, pct(_BAD_NUM, ROWS))],
    "dq_invalid_dates": [issue(90007, "Invalid / inconsistent date values", block(pct(_BAD_DATE, ROWS), 10),
                               "order_date", _BAD_DATE, pct(_BAD_DATE, ROWS))],
    "dq_category_variants": [issue(100005, "Inconsistent categorical values", "'WARNING'", "priority",
                                   _VARIANTS, pct(_VARIANTS, ROWS))],
    "dq_constant_columns": [issue(110000, "Constant / zero-variation columns", "'WARNING'", "source, note", "NULL", "NULL")],
    "dq_negative_values": [issue(120004, "Potentially invalid negative values", "'WARNING'", "net_revenue", _NEG, pct(_NEG, ROWS))],
    "dq_outliers": [
        issue(130000 + i, "Potential outliers", "'WARNING'", c, outliers(c), pct(outliers(c), f"SELECT count({c}) FROM dirty"),
              f"{pct(outliers(c), f'SELECT count({c}) FROM dirty')} >= 1")
        for i, c in enumerate(("order_id", "customer", "total_price", "amount", "net_revenue"))
    ],
}


def flat(df):
    return df.select(
        "seq", "issue", "severity", F.array_join("columns", ", ").alias("columns"),
        F.col("affected_rows").cast("double").alias("affected_rows"), "affected_pct",
    )


for _name, _sqls in PARTS.items():
    add(_name, lambda t, fn=getattr(g, _name): flat(fn(t.dirty)), " UNION ALL ".join(_sqls))
add("dq_issues", lambda t: flat(g.dq_issues(t.dirty)), " UNION ALL ".join(s for p in PARTS.values() for s in p))
add("dq_high_cardinality", lambda t: flat(g.dq_high_cardinality(t.customer)),
    f"""SELECT 150001::BIGINT AS seq, 'High-cardinality field' AS issue, 'INFO' AS severity, 'c_name' AS "columns",
        count(DISTINCT c_name)::DOUBLE AS affected_rows, round(count(DISTINCT c_name) * 100.0 / count(*), 2)::DOUBLE AS affected_pct
        FROM customer""")
_EMPTY_ROWS = "CASE WHEN o_orderkey % 30 = 0 THEN NULL ELSE {0} END AS {0}"
add("dq_empty_rows", lambda t: flat(g.dq_empty_rows(t.orders.selectExpr(
        *[_EMPTY_ROWS.format(c) for c in ("o_custkey", "o_orderstatus", "o_totalprice")]))),
    """SELECT 40000::BIGINT AS seq, 'Completely empty rows' AS issue, 'WARNING' AS severity, '' AS "columns",
       count(*) FILTER (o_orderkey % 30 = 0)::DOUBLE AS affected_rows,
       round(count(*) FILTER (o_orderkey % 30 = 0) * 100.0 / count(*), 2)::DOUBLE AS affected_pct FROM orders""")
add("dq_non_finite", lambda t: flat(g.dq_non_finite(t.orders.selectExpr(
        "o_orderkey", "CASE WHEN o_orderkey % 100 = 7 THEN o_totalprice / CAST('0.5' AS DOUBLE) * double('inf') ELSE o_totalprice END AS price"))),
    """SELECT 70001::BIGINT AS seq, 'Non-finite numeric values' AS issue, 'BLOCKING' AS severity, 'price' AS "columns",
       count(*) FILTER (o_orderkey % 100 = 7)::DOUBLE AS affected_rows,
       round(count(*) FILTER (o_orderkey % 100 = 7) * 100.0 / count(*), 2)::DOUBLE AS affected_pct FROM orders""")
add("dq_issues_clean", lambda t: flat(g.dq_issues(t.lineitem)),
    "SELECT 0::BIGINT AS seq, '' AS issue, '' AS severity, '' AS \"columns\", 0.0::DOUBLE AS affected_rows, 0.0::DOUBLE AS affected_pct FROM lineitem WHERE false")
_ALL = " UNION ALL ".join(s for p in PARTS.values() for s in p)
add("dq_status", lambda t: g.dq_status(t.dirty),
    f"""WITH i AS ({_ALL}) SELECT 'NOT READY' AS status, false AS analysis_ready, count(*) FILTER (severity = 'BLOCKING') AS blocking,
        count(*) FILTER (severity = 'WARNING') AS warnings, count(*) FILTER (severity = 'INFO') AS info FROM i""")
add("cleaning_plan", lambda t: g.cleaning_plan(t.dirty).select(
        "priority", "issue", "severity", F.array_join("columns", ", ").alias("columns")),
    f"""WITH i AS ({_ALL}) SELECT row_number() OVER (ORDER BY CASE WHEN severity = 'BLOCKING' THEN 0 ELSE 1 END, seq) AS priority,
        issue, severity, "columns" FROM i""")
add("whitespace_columns", lambda t: g.whitespace_columns(t.dirty),
    """SELECT 'priority' AS "column", count(*) FILTER (priority <> trim(priority)) AS affected FROM dirty""")
_NUMS = ("order_id", "customer", "total_price", "amount", "net_revenue")
add("negative_counts", lambda t: g.negative_counts(t.dirty),
    " UNION ALL ".join(f"""SELECT '{c}' AS "column", count(*) FILTER ({c} < 0) AS negative,
        count(*) FILTER ({c} < 0) * 100.0 / count({c}) AS share FROM dirty""" for c in _NUMS), f="share")
add("negative_total", lambda t: g.negative_total(t.customer),
    """SELECT count(*) FILTER (c_acctbal < 0) > 0 AS present, count(*) FILTER (c_acctbal < 0) AS negative_values FROM customer""")
add("quality_findings", lambda t: g.quality_findings(t.dirty).withColumn("n", F.col("n").cast("double")),
    f"""SELECT 'duplicate rows' AS finding, NULL AS "column", ({DUPS})::DOUBLE AS n UNION ALL
        SELECT 'missing values', 'total_price', {count('total_price IS NULL')} UNION ALL
        SELECT 'missing values', 'rare_flag', {count('rare_flag IS NULL')} UNION ALL
        SELECT 'missing values', 'note', {ROWS} UNION ALL SELECT 'constant', 'source', NULL UNION ALL SELECT 'constant', 'note', NULL UNION ALL
        SELECT 'whitespace', 'priority', {count('priority <> trim(priority)')} UNION ALL
        SELECT 'negative values', 'net_revenue', {_NEG} UNION ALL """
    + " UNION ALL ".join(f"SELECT 'outliers', '{c}', {outliers(c)} WHERE {outliers(c)} > 0" for c in _NUMS))
add("quality_actions", lambda t: g.quality_actions(t.dirty),
    """SELECT * FROM (VALUES ('duplicate check', true), ('missing-value check', true), ('date fields', false),
       ('category profile', false), ('numeric profile', false), ('negative values: net_revenue', true)) AS v(action, review)
       WHERE (SELECT count(*) > 0 FROM dirty)""")
_OUT = " + ".join(outliers(c) for c in _NUMS)
_CELLS = " + ".join(f"(SELECT count({c}) FROM dirty)" for c in _NUMS)
_MISSING = f"{count('total_price IS NULL')} + {count('rare_flag IS NULL')} + {ROWS}"
add("quality_score", lambda t: g.quality_score(t.dirty),
    f"""WITH p AS (SELECT ({_MISSING}) * 100.0 / ({ROWS} * 11) AS missing_pct, ({DUPS}) * 100.0 / {ROWS} AS duplicate_pct,
            200.0 / 11 AS constant_pct, 100.0 / 6 AS whitespace_pct, ({_OUT}) * 100.0 / ({_CELLS}) AS outlier_pct),
        s AS (SELECT *, 100 - least(missing_pct * 0.6, 30) - least(duplicate_pct * 0.5, 20) - least(constant_pct * 0.4, 10)
              - least(whitespace_pct * 0.2, 5) - least(outlier_pct * 0.15, 10) AS score FROM p)
        SELECT *, CASE WHEN score >= 90 THEN 'Excellent' WHEN score >= 75 THEN 'Good' WHEN score >= 60 THEN 'Fair'
               ELSE 'Needs Attention' END AS band FROM s""",
    f="missing_pct duplicate_pct constant_pct whitespace_pct outlier_pct score", digits=4)

# --- structure: the findings depend on the schema, the rest on the rows ---
add("dq_empty_table", lambda t: flat(g.dq_issues(t.orders.filter("o_totalprice < 0"))),
    """SELECT 0::BIGINT AS seq, 'Empty dataset' AS issue, 'BLOCKING' AS severity, '' AS "columns", NULL::DOUBLE AS affected_rows,
       NULL::DOUBLE AS affected_pct WHERE (SELECT count(*) FILTER (o_totalprice < 0) = 0 FROM orders)""")
add("dq_placeholder_names", lambda t: flat(g.dq_issues(t.orders.select(
        F.col("o_orderkey"), F.col("o_custkey").alias("Unnamed: 1"), F.col("o_orderdate").alias(" ")))).filter("seq < 60000"),
    """SELECT 10000::BIGINT AS seq, 'Blank / placeholder column names' AS issue, 'BLOCKING' AS severity, 'Unnamed: 1,  ' AS "columns",
       NULL::DOUBLE AS affected_rows, NULL::DOUBLE AS affected_pct WHERE (SELECT count(*) > 0 FROM orders)""")
add("dq_duplicate_names", lambda t: flat(g.dq_issues(t.dirty.select("order_id", F.col("priority").alias("word"), F.col("source").alias("word")))),
    f"""SELECT 20000::BIGINT AS seq, 'Duplicate column names' AS issue, 'BLOCKING' AS severity, 'word' AS "columns", NULL::DOUBLE AS affected_rows,
        NULL::DOUBLE AS affected_pct UNION ALL
        SELECT 60000, 'Duplicate records', {block(pct(DUPS, ROWS), 20)}, '', {DUPS}, {pct(DUPS, ROWS)} UNION ALL
        SELECT 100001, 'Inconsistent categorical values', 'WARNING', 'word', {_VARIANTS}, {pct(_VARIANTS, ROWS)} UNION ALL
        SELECT 110000, 'Constant / zero-variation columns', 'WARNING', 'word_2', NULL, NULL""")

# --- drill-downs ---
add("rows_missing", lambda t: g.rows_missing(t.dirty, "total_price").select("order_id"),
    "SELECT order_id FROM dirty WHERE total_price IS NULL")
add("duplicate_rows", lambda t: g.duplicate_rows(t.dirty).select("order_id", "copies"),
    """SELECT order_id, copies FROM (SELECT order_id, customer, total_price, amount, net_revenue, priority, amount_text, order_date,
       rare_flag, source, note, count(*) AS copies FROM dirty GROUP BY 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11) AS d WHERE copies > 1""")
add("non_numeric_values", lambda t: g.non_numeric_values(t.dirty, "amount_text"),
    f"SELECT amount_text AS value, count(*) AS n FROM dirty WHERE amount_text IS NOT NULL AND {NUM} IS NULL GROUP BY 1")
add("invalid_date_values", lambda t: g.invalid_date_values(t.dirty, "order_date"),
    f"SELECT order_date AS value, count(*) AS n FROM dirty WHERE order_date IS NOT NULL AND {DATE} IS NULL GROUP BY 1")
add("category_variants", lambda t: g.category_variants(t.dirty, "priority"),
    """SELECT category, variant, n, count(*) OVER (PARTITION BY category) AS variants FROM (
       SELECT lower(trim(priority)) AS category, priority AS variant, count(*) AS n FROM dirty GROUP BY 1, 2) AS v
       QUALIFY count(*) OVER (PARTITION BY category) > 1""")
add("outlier_rows", lambda t: g.outlier_rows(t.dirty, "amount").select("order_id", "amount"),
    """SELECT order_id, amount FROM dirty, (SELECT quantile_cont(amount, 0.25) AS q1, quantile_cont(amount, 0.75) AS q3 FROM dirty) AS f
       WHERE amount < q1 - 1.5 * (q3 - q1) OR amount > q3 + 1.5 * (q3 - q1)""", f="amount")
add("negative_rows", lambda t: g.negative_rows(t.dirty, "net_revenue").select("order_id"),
    "SELECT order_id FROM dirty WHERE net_revenue < 0")

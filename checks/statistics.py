"""Profiles, statistics, roles, time aggregation and chart data."""

from __future__ import annotations

from pyspark.sql import functions as F

import gridlore as g
from checks.registry import add

SALES_NUMBERS = ["revenue", "quantity", "discount"]


def union(parts: list[str]) -> str:
    return " UNION ALL ".join(parts)


# --- frequencies ---
add("value_counts", lambda t: g.value_counts(t.sales, "brand", 10),
    "SELECT brand AS value, count(*) AS n FROM sales GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
add("value_counts_all", lambda t: g.value_counts(t.dirty, "priority"),
    "SELECT priority AS value, count(*) AS n FROM dirty WHERE priority IS NOT NULL GROUP BY 1")
_TEXTS = ("product", "brand", "region", "segment")
_FREQ = union([f"SELECT '{c}' AS col, {c} AS value, count(*) AS n FROM sales GROUP BY 2" for c in _TEXTS])
add("top_values", lambda t: g.top_values(t.sales, list(_TEXTS), 5),
    f"""SELECT col AS "column", value, n, place FROM (SELECT *, row_number() OVER (PARTITION BY col ORDER BY n DESC, value) AS place
        FROM ({_FREQ}) AS f) AS r WHERE place <= 5""")
add("categorical_summary", lambda t: g.categorical_summary(t.sales, list(_TEXTS)),
    f"""WITH f AS ({_FREQ}), m AS (SELECT *, max(n) OVER (PARTITION BY col) AS top_n FROM f)
        SELECT col AS "column", count(*) AS unique_values, string_agg(value, ', ' ORDER BY value) FILTER (n = top_n) AS top,
               count(*) FILTER (n = top_n) AS n_modes, max(n) AS frequency, max(n) * 100.0 / sum(n) AS share
        FROM m GROUP BY 1""", f="share", digits=4)
add("category_modes", lambda t: g.category_modes(t.orders, ["o_orderkey", "o_orderstatus"]),
    """SELECT 'o_orderkey' AS "column", CAST(o_orderkey AS VARCHAR) AS value, 1 AS frequency FROM orders UNION ALL
       (SELECT 'o_orderstatus', o_orderstatus, count(*) FROM orders GROUP BY 2 ORDER BY 3 DESC LIMIT 1)""")

# --- numbers ---


def _stats(table: str, c: str) -> str:
    return f"""SELECT '{c}' AS "column", count({c}) AS count, avg({c}) AS mean, quantile_cont({c}, 0.5) AS median,
        stddev_samp({c}) AS std, var_samp({c}) AS variance, quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3,
        CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max, skewness({c}) AS skew,
        stddev_samp({c}) * 100 / avg({c}) AS cv FROM {table}"""


_STAT_COLUMNS = "mean median std variance q1 q3 min max skew cv"
add("numeric_statistics", lambda t: g.numeric_statistics(t.lineitem, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]),
    union([_stats("lineitem", c) for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")]),
    f=_STAT_COLUMNS, digits=4)


def _outliers(table: str, c: str) -> str:
    return f"""SELECT '{c}' AS "column", count({c}) AS n, min(q1) AS q1, min(q3) AS q3, min(q3 - q1) AS iqr,
        count(*) FILTER (q3 > q1 AND ({c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1))) AS outliers
        FROM {table}, (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM {table}) AS f"""


_STATUS = "CASE WHEN outliers > 0 THEN 'potential outliers' ELSE 'no outliers' END AS status"
add("outlier_profile", lambda t: g.outlier_profile(t.dirty, ["total_price", "amount", "net_revenue"]),
    f"SELECT *, {_STATUS} FROM ({union([_outliers('dirty', c) for c in ('total_price', 'amount', 'net_revenue')])}) AS u",
    f="q1 q3 iqr", digits=4)
add("quantile_table", lambda t: g.quantile_table(t.events, ["value", "user_id", "event_id"]),
    union([f"""SELECT '{c}' AS "column", count(*) AS n, quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.5) AS median,
               quantile_cont({c}, 0.75) AS q3 FROM events""" for c in ("value", "user_id", "event_id")]),
    f="q1 median q3", digits=4)

# --- profiles ---
_DIRTY = {
    "order_id": "n", "customer": "n", "total_price": "n", "amount": "n", "net_revenue": "n", "priority": "t",
    "amount_text": "t", "order_date": "t", "rare_flag": "t", "source": "t", "note": "t",
}


def _profile(table: str, columns: dict[str, str]) -> str:
    parts = []
    for i, (c, kind) in enumerate(columns.items()):
        num = (
            f"CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max, avg({c}) AS mean, quantile_cont({c}, 0.5) AS median, "
            f"stddev_samp({c}) AS std, quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3"
            if kind == "n" else
            "NULL::DOUBLE AS min, NULL::DOUBLE AS max, NULL::DOUBLE AS mean, NULL::DOUBLE AS median, "
            "NULL::DOUBLE AS std, NULL::DOUBLE AS q1, NULL::DOUBLE AS q3"
        )
        parts.append(f"""SELECT {i} AS position, '{c}' AS "column", '{kind}' AS kind, count(*) AS rows,
            count(*) - count({c}) AS missing, count(DISTINCT {c}) AS unique_values, {num} FROM {table}""")
    return union(parts)


add("profile", lambda t: g.profile(t.dirty),
    f"""SELECT position, "column", missing, unique_values, min, max, mean, median, missing = rows AS all_missing,
        kind = 't' AND missing < rows AND unique_values > 0.5 * rows AS is_identifier_like, 0 AS truncated_columns
        FROM ({_profile('dirty', _DIRTY)}) AS p""", f="min max mean median", digits=4)
_LINE = {
    "l_orderkey": "n", "l_partkey": "n", "l_suppkey": "n", "l_linenumber": "n", "l_quantity": "n",
    "l_extendedprice": "n", "l_discount": "n", "l_tax": "n", "l_returnflag": "t", "l_linestatus": "t", "l_shipdate": "t",
}
add("profile_lineitem", lambda t: g.profile(t.lineitem, 6),
    f"""SELECT position, "column", missing, unique_values, min, max, mean, median, missing = rows AS all_missing,
        false AS is_identifier_like, 5 AS truncated_columns FROM ({_profile('lineitem', _LINE)}) AS p WHERE position < 6""",
    f="min max mean median", digits=4)
add("column_profile", lambda t: g.column_profile(t.dirty),
    f"""SELECT position, "column", CASE WHEN "column" = 'order_date' THEN 'Date/Time' WHEN kind = 'n' THEN 'Numeric'
          ELSE 'Categorical' END AS detected_type, unique_values, missing, missing * 100.0 / rows AS missing_pct,
        min, max, mean, median, std, q1, q3 FROM ({_profile('dirty', _DIRTY)}) AS p""",
    f="missing_pct min max mean median std q1 q3", digits=4)


def _quick(table: str, columns: dict[str, str], dates: tuple[str, ...]) -> str:
    parts = []
    for i, (c, k) in enumerate(columns.items()):
        kind = "numeric" if k == "n" else "date" if c in dates else "categorical"
        num = (f"CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max, avg({c}) AS mean" if k == "n"
               else "NULL::DOUBLE AS min, NULL::DOUBLE AS max, NULL::DOUBLE AS mean")
        cat = (f"count(DISTINCT {c}) AS unique_values, (SELECT {c} FROM {table} WHERE {c} IS NOT NULL GROUP BY 1 "
               f"ORDER BY count(*) DESC, 1 LIMIT 1) AS top_value" if kind == "categorical"
               else "NULL::BIGINT AS unique_values, NULL::VARCHAR AS top_value")
        parts.append(f"""SELECT {i} AS position, '{c}' AS "column", '{kind}' AS kind, {num}, {cat},
            (count(*) - count({c})) * 100.0 / count(*) AS missing_pct,
            (count(*) - count({c})) * 100.0 / count(*) > 20 AS high_missing FROM {table}""")
    return union(parts)


add("quick_stats", lambda t: g.quick_stats(t.dirty), _quick("dirty", _DIRTY, ("order_date",)), f="min max mean missing_pct unique_values")
add("dataset_summary", lambda t: g.dataset_summary(t.dirty),
    """SELECT count(*) AS rows, 11 AS columns, 5 AS numeric_columns, 6 AS categorical_columns, 0 AS datetime_columns,
       CAST(sum(CASE WHEN total_price IS NULL THEN 1 ELSE 0 END + CASE WHEN rare_flag IS NULL THEN 1 ELSE 0 END + 1) AS BIGINT) AS missing_cells,
       count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM dirty) AS d) AS duplicate_rows FROM dirty""")
add("duplicate_count", lambda t: g.duplicate_count(t.dirty),
    "SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM dirty) AS d) AS duplicate_rows FROM dirty")
add("date_profile", lambda t: g.date_profile(t.dirty.select("order_date"), ["order_date"]).unionByName(
        g.date_profile(t.lineitem, ["l_shipdate"])),
    """SELECT 'order_date' AS "column", count(d) AS valid, min(d) AS earliest, max(d) AS latest,
         count(DISTINCT d) AS unique_days, datediff('day', min(d), max(d)) + 1 AS span_days
       FROM (SELECT try_cast(order_date AS DATE) AS d FROM dirty) AS a UNION ALL
       SELECT 'l_shipdate', count(d), min(d), max(d), count(DISTINCT d), datediff('day', min(d), max(d)) + 1
       FROM (SELECT CAST(l_shipdate AS DATE) AS d FROM lineitem) AS b""", dates="earliest latest")

# --- roles ---
_ROLES = [
    # column, role, ratio, date name, measure name, identifier
    ("order_id", "numeric", "NULL::DOUBLE", False, False, True),
    ("customer", "numeric", "NULL::DOUBLE", False, False, False),
    ("total_price", "numeric", "NULL::DOUBLE", False, True, False),
    ("amount", "numeric", "NULL::DOUBLE", False, True, False),
    ("net_revenue", "numeric", "NULL::DOUBLE", False, True, False),
    ("priority", "categorical", "0.0::DOUBLE", False, False, False),
    ("amount_text", "categorical", "0.0::DOUBLE", False, True, False),
    ("order_date", "date", "(SELECT count(try_cast(order_date AS DATE)) * 1.0 / count(*) FROM dirty)", True, False, False),
    ("rare_flag", "categorical", "0.0::DOUBLE", False, False, False),
    ("source", "categorical", "0.0::DOUBLE", False, False, False),
    ("note", "categorical", "0.0::DOUBLE", False, False, False),
]
add("column_roles", lambda t: g.column_roles(t.dirty), union([
    f"""SELECT {i} AS position, '{c}' AS "column", '{role}' AS role, {ratio} AS parse_ratio, {d} AS is_date_name,
        {m} AS measure_name, {k} AS is_identifier FROM (SELECT 1) AS one""" for i, (c, role, ratio, d, m, k) in enumerate(_ROLES)
]), f="parse_ratio", digits=6)
add("column_roles_events", lambda t: g.column_roles(t.events).select("column", "role", "is_identifier"),
    """SELECT * FROM (VALUES ('event_id', 'numeric', true), ('ts', 'date', false), ('user_id', 'numeric', true),
       ('event_type', 'categorical', false), ('value', 'numeric', false), ('props', 'categorical', false)) AS v("column", role, is_identifier)
       WHERE (SELECT count(*) = count(DISTINCT event_id) FROM events)""")
add("primary_measure", lambda t: g.primary_measure(t.sales),
    "SELECT 'revenue' AS \"primary\", 'customer' AS secondary FROM (SELECT count(*) FROM sales) AS s")
add("date_columns", lambda t: g.date_columns(t.dirty),
    """SELECT 7 AS position, 'order_date' AS "column", 'content' AS reason FROM (SELECT count(*) FROM dirty) AS s""")

# --- relations ---
add("correlation_matrix", lambda t: g.correlation_matrix(t.sales, SALES_NUMBERS),
    union([f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM sales" for a in SALES_NUMBERS for b in SALES_NUMBERS]),
    f="r", digits=6)
add("best_correlation", lambda t: g.best_correlation(t.dirty, ["total_price", "amount", "net_revenue"]).select("a", "b", "r"),
    f"""SELECT * FROM ({union([f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM dirty"
        for a, b in (("total_price", "amount"), ("total_price", "net_revenue"), ("amount", "net_revenue"))])}) AS u
        ORDER BY abs(r) DESC LIMIT 1""", f="r", digits=6)
add("relationship", lambda t: g.relationship(t.dirty, "total_price", "net_revenue"),
    """SELECT 'total_price' AS a, 'net_revenue' AS b, n, r,
         CASE WHEN abs(r) < 0.1 THEN 'none' WHEN abs(r) < 0.4 THEN 'weak' WHEN abs(r) < 0.7 THEN 'moderate'
              WHEN abs(r) < 0.8 THEN 'strong' ELSE 'very strong' END AS strength,
         CASE WHEN r > 0 THEN 'positive' ELSE 'negative' END AS direction, n < 30 AS exploratory
       FROM (SELECT count(*) FILTER (total_price IS NOT NULL AND net_revenue IS NOT NULL) AS n,
                    corr(total_price, net_revenue) AS r FROM dirty) AS s""", f="r", digits=6)
add("group_shares", lambda t: g.group_shares(t.sales, ["brand", "segment"], "revenue", 10),
    union([f"""(SELECT '{k}' AS dimension, {k} AS category, count(*) AS records, sum(revenue) AS total, avg(revenue) AS average,
               sum(revenue) * 100 / sum(sum(revenue)) OVER () AS share FROM sales GROUP BY 2 ORDER BY 4 DESC, 2 LIMIT 10)"""
           for k in ("brand", "segment")]), f="total average share")

# --- time ---
add("time_aggregation", lambda t: g.time_aggregation(t.sales, "date", "revenue"),
    """SELECT CAST(date_trunc('month', date) AS DATE) AS period, 'month' AS grain, sum(revenue) AS value FROM sales GROUP BY 1""",
    f="value", dates="period")
add("time_aggregation_days", lambda t: g.time_aggregation(t.events, "ts", "value"),
    "SELECT CAST(ts AS DATE) AS period, 'day' AS grain, sum(value) AS value FROM events GROUP BY 1", f="value", dates="period")
_HALF = "o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1997-06-01'"
add("time_aggregation_weeks", lambda t: g.time_aggregation(t.orders.filter(_HALF.replace("TIMESTAMP", "TIMESTAMP_NTZ")), "o_orderdate"),
    f"""SELECT CAST(date_trunc('week', o_orderdate) AS DATE) AS period, 'week' AS grain, count(*) AS value
        FROM orders WHERE {_HALF} GROUP BY 1""", f="value", dates="period")
_UNTIL = "date < TIMESTAMP '2001-07-20'"
add("time_extremes", lambda t: g.time_extremes(t.sales.filter(_UNTIL.replace("TIMESTAMP", "TIMESTAMP_NTZ")), "date", "revenue"),
    f"""WITH s AS (SELECT CAST(date_trunc('month', date) AS DATE) AS p, sum(revenue) AS v FROM sales WHERE {_UNTIL} GROUP BY 1),
        u AS (SELECT * FROM s WHERE p < DATE '2001-07-01')
        SELECT 'month' AS grain, (SELECT p FROM u ORDER BY v DESC, p LIMIT 1) AS highest_period, max(v) AS highest,
          (SELECT p FROM u ORDER BY v, p LIMIT 1) AS lowest_period, min(v) AS lowest,
          (SELECT max(CAST(date AS DATE)) FROM sales WHERE {_UNTIL}) AS partial_until FROM u""",
    f="highest lowest", dates="highest_period lowest_period partial_until")
add("extreme_examples", lambda t: g.extreme_examples(t.lineitem, "l_quantity"),
    union([f"""(SELECT '{kind}' AS kind, (SELECT {fn}(l_quantity) FROM lineitem) AS value,
            (SELECT count(*) FROM lineitem WHERE l_quantity = (SELECT {fn}(l_quantity) FROM lineitem)) AS records,
            'l_shipdate=' || CAST(CAST(l_shipdate AS DATE) AS VARCHAR) || ', l_returnflag=' || l_returnflag || ', l_linestatus=' || l_linestatus AS example
            FROM lineitem WHERE l_quantity = (SELECT {fn}(l_quantity) FROM lineitem)
            ORDER BY l_shipdate, l_returnflag, l_linestatus LIMIT 2)""" for kind, fn in (("maximum", "max"), ("minimum", "min"))]),
    f="value")

# --- overview and facts ---


def _overview() -> str:
    rows = ["SELECT 'dataset' AS section, NULL AS subject, 'rows' AS metric, count(*)::DOUBLE AS value, NULL AS text FROM orders",
            "SELECT 'dataset', NULL, 'missing_cells', 0.0, NULL FROM (SELECT 1) AS o",
            "SELECT 'dataset', NULL, 'duplicate_rows', count(*)::DOUBLE - (SELECT count(*) FROM (SELECT DISTINCT * FROM orders) AS d), NULL FROM orders"]
    for c in ("o_orderkey", "o_custkey", "o_totalprice"):
        rows += [f"SELECT 'numeric', '{c}', '{m}', {fn}({c})::DOUBLE, NULL FROM orders"
                 for m, fn in (("min", "min"), ("max", "max"), ("mean", "avg"), ("sum", "sum"))]
    rows += [f"SELECT 'date', 'o_orderdate', '{m}', NULL, CAST(CAST({fn}(o_orderdate) AS DATE) AS VARCHAR) FROM orders"
             for m, fn in (("earliest", "min"), ("latest", "max"))]
    for c in ("o_orderstatus", "o_orderpriority"):
        rows.append(f"SELECT 'text', '{c}', 'distinct', count(DISTINCT {c})::DOUBLE, NULL FROM orders")
        rows.append(f"SELECT 'top_value', '{c}', 'count', count(*)::DOUBLE, {c} FROM orders GROUP BY {c}")
    return union(rows)


add("overview", lambda t: g.overview(t.orders), _overview(), f="value")


def _facts() -> str:
    parts = []
    for c in ("customer", "revenue", "quantity", "discount"):
        parts.append(f"""SELECT 'numeric' AS section, '{c}' AS "column", min({c})::DOUBLE AS min, min(q1) AS q1, min(q2) AS median, min(q3) AS q3,
            max({c})::DOUBLE AS max, avg({c}) AS mean, stddev_samp({c}) AS std, skewness({c}) AS skew,
            CASE WHEN abs(skewness({c})) < 0.5 THEN 'roughly symmetric' WHEN skewness({c}) > 0 THEN 'right-skewed' ELSE 'left-skewed' END AS shape,
            count(*) FILTER (q3 > q1 AND ({c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1))) AS outliers,
            count(*) FILTER (q3 > q1 AND ({c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1))) * 100.0 / count({c}) AS share,
            count(*) FILTER ({c} < 0) AS negatives
            FROM sales, (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.5) AS q2, quantile_cont({c}, 0.75) AS q3 FROM sales) AS f""")
    for c in _TEXTS:
        parts.append(f"""(SELECT 'category', '{c}', NULL, NULL, NULL, NULL, (SELECT count(DISTINCT {c}) FROM sales)::DOUBLE, NULL, NULL, NULL, {c}, NULL,
            count(*) * 100.0 / (SELECT count({c}) FROM sales), NULL FROM sales GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)""")
    parts.append("""SELECT 'date', 'date', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL,
        CAST(CAST(min(date) AS DATE) AS VARCHAR) || ' to ' || CAST(CAST(max(date) AS DATE) AS VARCHAR), NULL, NULL, NULL FROM sales""")
    return union(parts)


add("fact_sheet", lambda t: g.fact_sheet(t.sales), _facts(), f="min q1 median q3 max mean std skew share outliers negatives", digits=4)

# --- charts ---
add("bar_data", lambda t: g.bar_data(t.sales, "product", "revenue"),
    "SELECT product, sum(revenue) AS revenue FROM sales GROUP BY 1", f="revenue")
add("bar_data_numeric", lambda t: g.bar_data(t.lineitem, "l_quantity", "l_tax"),
    "SELECT l_quantity, l_tax FROM lineitem", f="l_quantity l_tax")
add("line_data", lambda t: g.line_data(t.events, "ts", "value", 300).withColumn(
        "ts", F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts"))),
    """WITH o AS (SELECT epoch_us(ts) AS ts, value, row_number() OVER (ORDER BY ts, value) AS position, count(*) OVER () AS n FROM events)
       SELECT ts, value, position FROM o WHERE (position - 1) % greatest(1, n // 300) = 0""", f="value")
add("scatter_data", lambda t: g.scatter_data(t.lineitem, "l_quantity", "l_extendedprice", 500))
add("trend_line", lambda t: g.trend_line(t.lineitem, "l_quantity", "l_extendedprice"),
    """SELECT regr_slope(l_extendedprice, l_quantity) AS slope, regr_intercept(l_extendedprice, l_quantity) AS intercept,
       regr_r2(l_extendedprice, l_quantity) AS r2, count(*) AS n FROM lineitem""", f="slope intercept r2", digits=6)
add("grouped_chart_data", lambda t: g.grouped_chart_data(t.sales, "brand", "revenue", "segment"),
    """WITH c AS (SELECT brand AS x, segment AS series, sum(revenue) AS value FROM sales GROUP BY 1, 2),
       k AS (SELECT x FROM c GROUP BY 1 ORDER BY sum(value) DESC, 1 LIMIT 12) SELECT * FROM c WHERE x IN (SELECT x FROM k)""", f="value")
add("grouped_chart_data_monthly", lambda t: g.grouped_chart_data(
        t.sales, "date", "revenue", "region", agg="mean", grain="month", year=1998),
    """SELECT strftime(date, '%Y-%m') AS x, region AS series, avg(revenue) AS value FROM sales
       WHERE year(date) = 1998 GROUP BY 1, 2""", f="value")
add("ranked_bar_data", lambda t: g.ranked_bar_data(t.sales, "brand", "revenue"),
    "SELECT brand AS x, sum(revenue) AS value FROM sales GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15", f="value")
add("axis_data", lambda t: g.axis_data(t.sales, "date", "revenue", grain="year"),
    "SELECT CAST(year(date) AS VARCHAR) AS x, sum(revenue) AS value FROM sales GROUP BY 1", f="value")
add("pie_data", lambda t: g.pie_data(t.sales, "brand", "revenue"),
    """WITH s AS (SELECT brand, sum(revenue) AS v FROM sales GROUP BY 1),
       r AS (SELECT *, row_number() OVER (ORDER BY v DESC, brand) AS p FROM s)
       SELECT CASE WHEN p <= 7 THEN brand ELSE 'Other' END AS brand, sum(v) AS value,
              sum(v) * 100 / (SELECT sum(v) FROM s) AS share FROM r GROUP BY 1""", f="value share")
add("histogram", lambda t: g.histogram(t.customer, "c_acctbal"),
    """WITH f AS (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi, least(40, greatest(10, CAST(floor(sqrt(count(*))) AS INT))) AS b FROM customer),
       e AS (SELECT CAST(i AS INT) AS bin, lo, hi, b FROM f, range(0, 40) AS r(i) WHERE i < b),
       c AS (SELECT least(CAST(floor((c_acctbal - lo) / ((hi - lo) / b)) AS INT), b - 1) AS bin, count(*) AS n FROM customer, f GROUP BY 1)
       SELECT e.bin, lo + e.bin * ((hi - lo) / b) AS bin_low, lo + (e.bin + 1) * ((hi - lo) / b) AS bin_high, coalesce(n, 0) AS n
       FROM e LEFT JOIN c ON e.bin = c.bin""", f="bin_low bin_high", digits=3)
add("histogram_few_values", lambda t: g.histogram(t.labels, "quality"),
    """SELECT CAST(b AS INT) AS bin, b * 0.5 AS bin_low, (b + 1) * 0.5 AS bin_high, n
       FROM (SELECT quality AS b, count(*) AS n FROM labels GROUP BY 1) AS q""", f="bin_low bin_high")
add("histogram_markers", lambda t: g.histogram_markers(t.customer, "c_acctbal"),
    "SELECT avg(c_acctbal) AS mean, quantile_cont(c_acctbal, 0.5) AS median FROM customer", f="mean median", digits=4)
_BOX = """WITH v AS (SELECT source_p AS "group", amount AS v FROM (SELECT lower(trim(priority)) AS source_p, amount FROM dirty) AS d),
       q AS (SELECT "group", count(*) AS n, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS q3 FROM v GROUP BY 1),
       j AS (SELECT v.*, n, q1, median, q3, q1 - 1.5 * (q3 - q1) AS low, q3 + 1.5 * (q3 - q1) AS high FROM v JOIN q ON v."group" = q."group")"""
add("box_stats", lambda t: g.box_stats(t.dirty.withColumn("priority", F.lower(F.trim("priority"))), "amount", "priority"),
    _BOX + """ SELECT "group", any_value(n) AS n, any_value(q1) AS q1, any_value(median) AS median, any_value(q3) AS q3,
       min(v) FILTER (v >= low) AS whisker_low, max(v) FILTER (v <= high) AS whisker_high,
       count(*) FILTER (v < low OR v > high) AS outliers FROM j GROUP BY 1""",
    f="q1 median q3 whisker_low whisker_high", digits=4)
add("box_outliers", lambda t: g.box_outliers(t.dirty.withColumn("priority", F.lower(F.trim("priority"))), "amount", "priority", 20),
    _BOX + """ SELECT "group", place, value FROM (SELECT "group", v AS value, row_number() OVER (PARTITION BY "group" ORDER BY v) AS place
       FROM j WHERE v < low OR v > high) AS o WHERE place <= 20""", f="value")
add("box_stats_whole", lambda t: g.box_stats(t.events, "value"),
    """WITH q AS (SELECT count(*) AS n, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3 FROM events)
       SELECT 'value' AS "group", any_value(n) AS n, any_value(q1) AS q1, any_value(median) AS median, any_value(q3) AS q3,
         min(value) FILTER (value >= q1 - 1.5 * (q3 - q1)) AS whisker_low, max(value) FILTER (value <= q3 + 1.5 * (q3 - q1)) AS whisker_high,
         count(*) FILTER (value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) AS outliers FROM events, q""",
    f="q1 median q3 whisker_low whisker_high", digits=4)


def _chart_checks(t):
    """What is said to requests for charts of orders: one row a request."""
    cheap = t.orders.filter("o_totalprice < 0")
    asked = [(t.orders, "bar", "o_orderstatus", "o_totalprice"), (t.orders, "scatter", "o_orderstatus", "o_totalprice"),
             (t.orders, "line", "o_orderdate", "price"), (t.orders, "histogram", "o_orderpriority", None), (cheap, "bar", "o_orderstatus", "o_totalprice")]
    said = []
    for df, kind, x, y in asked:
        try:
            g.check_chart(df, kind, x, y)
            said.append((kind, x, y, "made"))
        except ValueError as e:
            said.append((kind, x, y, "no rows" if "No rows" in str(e) else "not numeric" if "not numeric" in str(e) else "unknown column"))
    return t.spark.createDataFrame(said, "kind string, x string, y string, answer string")


add("check_chart", _chart_checks,
    """SELECT * FROM (VALUES ('bar', 'o_orderstatus', 'o_totalprice', CASE WHEN (SELECT count(o_totalprice) > 0 FROM orders) THEN 'made' END),
       ('scatter', 'o_orderstatus', 'o_totalprice', 'not numeric'), ('line', 'o_orderdate', 'price', 'unknown column'),
       ('histogram', 'o_orderpriority', NULL, 'not numeric'),
       ('bar', 'o_orderstatus', 'o_totalprice', CASE WHEN (SELECT count(*) FILTER (o_totalprice < 0) = 0 FROM orders) THEN 'no rows' ELSE 'made' END)) AS v(kind, x, y, answer)""")

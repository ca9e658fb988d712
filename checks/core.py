"""Filters, aggregates, comparisons and rankings."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

import gridlore as g
from checks.registry import add

MONTH = "CAST(date_trunc('month', {}) AS DATE)"

# --- filters ---
for op, tag in ((">", "gt"), (">=", "ge"), ("<", "lt"), ("<=", "le"), ("=", "eq")):
    add(f"filter_numeric_{tag}", lambda t, op=op: g.filter_numeric(t.lineitem, "l_quantity", op, 23.0)
        .groupBy("l_returnflag").count().withColumnRenamed("count", "n"),
        f"SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_quantity {op} 23 GROUP BY 1")
add("filter_numeric_ne", lambda t: g.row_count(g.filter_numeric(t.dirty, "total_price", "!=", 112946.26)),
    "SELECT count(*) AS rows FROM dirty WHERE total_price IS DISTINCT FROM 112946.26")
add("filter_numeric", lambda t: g.filter_numeric(t.dirty, "amount_text", ">=", 1900).select("order_id", "amount_text"),
    """SELECT order_id, amount_text FROM dirty
       WHERE try_cast(replace(trim(amount_text), ',', '') AS DOUBLE) >= 1900""")
add("filter_between", lambda t: g.filter_between(t.orders, "o_totalprice", 100000, 200000)
    .select("o_orderkey", "o_totalprice"),
    "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice BETWEEN 100000 AND 200000", f="o_totalprice")
add("filter_all", lambda t: g.row_count(g.filter_all(
        t.lineitem, g.numeric_is(t.lineitem, "l_quantity", ">", 10), g.numeric_is(t.lineitem, "l_discount", "<=", 0.05))),
    "SELECT count(*) AS rows FROM lineitem WHERE l_quantity > 10 AND l_discount <= 0.05")
add("filter_any", lambda t: g.row_count(g.filter_any(
        t.lineitem, g.numeric_is(t.lineitem, "l_quantity", ">", 40), g.numeric_is(t.lineitem, "l_discount", "<", 0.02))),
    "SELECT count(*) AS rows FROM lineitem WHERE l_quantity > 40 OR l_discount < 0.02")
add("filter_equals_ci", lambda t: g.filter_equals_ci(t.dirty, "priority", "1-Urgent").select("order_id", "priority"),
    "SELECT order_id, priority FROM dirty WHERE lower(trim(priority)) = '1-urgent'")
add("filter_in_ci", lambda t: g.filter_in_ci(t.dirty, "priority", ["5-low", "2-HIGH "]).select("order_id", "priority"),
    "SELECT order_id, priority FROM dirty WHERE lower(trim(priority)) IN ('5-low', '2-high')")
add("filter_cat_numeric", lambda t: g.filter_cat_numeric(
        t.dirty, "priority", "5-LOW", g.numeric_is(t.dirty, "total_price", ">", 300000)).select("order_id"),
    "SELECT order_id FROM dirty WHERE lower(trim(priority)) = '5-low' AND total_price > 300000")
add("filter_day", lambda t: g.filter_day(t.orders, "o_orderdate", "1997-03-14").select("o_orderkey"),
    "SELECT o_orderkey FROM orders WHERE CAST(o_orderdate AS DATE) = DATE '1997-03-14'")
add("filter_month", lambda t: g.filter_month(t.orders, "o_orderdate", 1998, 12).select("o_orderkey"),
    "SELECT o_orderkey FROM orders WHERE year(o_orderdate) = 1998 AND month(o_orderdate) = 12")
add("filter_year", lambda t: g.row_count(g.filter_year(t.dirty, "order_date", 1996)),
    "SELECT count(*) AS rows FROM dirty WHERE year(try_cast(order_date AS DATE)) = 1996")
add("contains_value", lambda t: g.contains_value(t.customer, "c_mktsegment", "building")
    .withColumn("other", g.contains_value(t.customer, "c_mktsegment", "no such").select("found").scalar()),
    """SELECT bool_or(lower(trim(c_mktsegment)) = 'building') AS found,
              bool_or(lower(trim(c_mktsegment)) = 'no such') AS other FROM customer""")
add("locate_value", lambda t: g.locate_value(t.sales, "asia"),
    """SELECT 'region' AS "column", count(*) AS matches, true AS accepted FROM sales WHERE lower(region) = 'asia'
       HAVING count(*) > 0""")
add("search_rows", lambda t: g.search_rows(t.customer, "MACH").select("c_custkey"),
    """SELECT c_custkey FROM customer WHERE contains(lower(c_name), 'mach') OR contains(lower(c_mktsegment), 'mach')
       OR contains(CAST(c_custkey AS VARCHAR), 'mach')""")
add("capped_rows", lambda t: g.capped_rows(
        g.filter_numeric(t.orders, "o_totalprice", ">", 400000).select("o_orderkey", "o_totalprice"), 30, ["o_orderkey"]),
    """SELECT o_orderkey, o_totalprice, count(*) OVER () AS total_rows FROM orders WHERE o_totalprice > 400000
       ORDER BY o_orderkey LIMIT 30""", f="o_totalprice")
add("plottable", lambda t: g.plottable(t.dirty, "amount_text", "total_price"),
    """SELECT try_cast(replace(amount_text, ',', '') AS DOUBLE) AS amount_text, total_price FROM dirty
       WHERE try_cast(replace(amount_text, ',', '') AS DOUBLE) IS NOT NULL AND total_price IS NOT NULL""",
    f="amount_text total_price")
add("coerced", lambda t: g.coerced(t.dirty.select("order_id", "amount_text", "order_date"),
                                   numbers=("amount_text",), dates=("order_date",)).withColumn(
        "order_date_ts", F.col("order_date_ts").cast("date")),
    """SELECT order_id, amount_text, order_date, try_cast(replace(amount_text, ',', '') AS DOUBLE) AS amount_text_number,
       try_cast(order_date AS DATE) AS order_date_ts FROM dirty""",
    f="amount_text_number", dates="order_date_ts")

# --- aggregates ---
add("total", lambda t: g.total(t.orders, "o_totalprice"), "SELECT sum(o_totalprice) AS value FROM orders", f="value")
add("average", lambda t: g.average(t.dirty, "total_price"), "SELECT avg(total_price) AS value FROM dirty",
    f="value", digits=4)
add("filtered_aggregate", lambda t: g.filtered_aggregate(
        t.sales, "revenue", "mean", g.text_is(t.sales, "region", "europe") & g.numeric_is(t.sales, "quantity", ">=", 25)
        & g.within_year(t.sales, "date", 1997)),
    """SELECT avg(revenue) AS value FROM sales WHERE lower(region) = 'europe' AND quantity >= 25
       AND year(date) = 1997""", f="value", digits=4)
add("period_aggregate", lambda t: g.period_aggregate(
        t.orders, "o_totalprice", "sum", "o_orderdate", dt.date(1996, 2, 1), dt.date(1996, 3, 1)),
    """SELECT sum(o_totalprice) AS value FROM orders
       WHERE o_orderdate >= TIMESTAMP '1996-02-01' AND o_orderdate < TIMESTAMP '1996-03-01'""", f="value")
add("group_aggregate", lambda t: g.group_aggregate(t.sales, "region", "revenue"),
    "SELECT region, sum(revenue) AS value FROM sales GROUP BY 1", f="value")
for agg, fn in (("mean", "avg"), ("count", "count"), ("min", "min"), ("max", "max")):
    add(f"group_aggregate_{agg}", lambda t, agg=agg: g.group_aggregate(t.dirty, "rare_flag", "total_price", agg),
        f"SELECT rare_flag, {fn}(total_price) AS value FROM dirty GROUP BY 1", f="value", digits=4)
add("group_aggregate2", lambda t: g.group_aggregate2(t.sales, "region", "segment", "revenue"),
    "SELECT region, segment, sum(revenue) AS value FROM sales GROUP BY 1, 2", f="value")
add("daily_aggregate", lambda t: g.daily_aggregate(t.events, "ts", "value"),
    "SELECT CAST(ts AS DATE) AS day, sum(value) AS value FROM events GROUP BY 1", f="value", dates="day")
add("monthly_totals", lambda t: g.monthly_totals(t.dirty, "order_date", "total_price"),
    f"""SELECT {MONTH.format("try_cast(order_date AS DATE)")} AS month, coalesce(sum(total_price), 0) AS value
        FROM dirty GROUP BY 1""", f="value", dates="month")
add("monthly_totals_where", lambda t: g.monthly_totals(
        t.orders, "o_orderdate", "o_totalprice", g.within_year(t.orders, "o_orderdate", 1999)),
    f"""SELECT {MONTH.format("o_orderdate")} AS month, sum(o_totalprice) AS value FROM orders
        WHERE year(o_orderdate) = 1999 GROUP BY 1""", f="value", dates="month")
add("yearly_totals", lambda t: g.yearly_totals(t.orders, "o_orderdate", "o_totalprice"),
    "SELECT CAST(year(o_orderdate) AS INT) AS year, sum(o_totalprice) AS value FROM orders GROUP BY 1", f="value")
add("row_count", lambda t: g.row_count(t.lineitem), "SELECT count(*) AS rows FROM lineitem")
add("count_distinct", lambda t: g.count_distinct(t.lineitem, "l_partkey"),
    "SELECT count(DISTINCT l_partkey) AS distinct_values FROM lineitem")
add("count_distinct_days", lambda t: g.count_distinct_days(t.lineitem, "l_shipdate"),
    "SELECT count(DISTINCT CAST(l_shipdate AS DATE)) AS distinct_days FROM lineitem")
add("distinct_values", lambda t: g.distinct_values(t.dirty, "priority"),
    "SELECT DISTINCT trim(priority) AS value FROM dirty WHERE trim(priority) <> ''")
add("count_distinct_where", lambda t: g.count_distinct_where(
        t.sales, "customer", g.text_is(t.sales, "product", "promo") & g.within_month(t.sales, "date", 1998, 5)),
    """SELECT count(DISTINCT customer) AS distinct_values FROM sales WHERE lower(product) = 'promo'
       AND year(date) = 1998 AND month(date) = 5""")
add("distinct_where", lambda t: g.distinct_where(
        t.sales, "customer", g.text_is(t.sales, "product", "SMALL") & g.numeric_is(t.sales, "revenue", ">", 90000)),
    """SELECT DISTINCT CAST(customer AS VARCHAR) AS value FROM sales
       WHERE lower(product) = 'small' AND revenue > 90000""")
add("group_metrics", lambda t: g.group_metrics(t.dirty, "rare_flag", "total_price"),
    """SELECT rare_flag, sum(total_price) AS total, avg(total_price) AS average, count(total_price) AS count
       FROM dirty WHERE rare_flag IS NOT NULL AND total_price IS NOT NULL GROUP BY 1""", f="total average")
add("composition", lambda t: g.composition(t.sales, "segment", "revenue"),
    """SELECT segment, sum(revenue) AS total, sum(revenue) * 100 / sum(sum(revenue)) OVER () AS share
       FROM sales GROUP BY 1""", f="total share")

# --- comparisons ---
_COMPARE = """SELECT a AS first, b AS second, b - a AS difference, (b - a) * 100 / nullif(a, 0) AS difference_pct FROM (
    SELECT coalesce(sum(CASE WHEN {0} THEN o_totalprice END), 0) AS a,
           coalesce(sum(CASE WHEN {1} THEN o_totalprice END), 0) AS b FROM orders) AS s"""
add("compare_months", lambda t: g.compare_months(t.orders, "o_orderdate", "o_totalprice", (1996, 1), (1996, 2)),
    _COMPARE.format("year(o_orderdate) = 1996 AND month(o_orderdate) = 1",
                    "year(o_orderdate) = 1996 AND month(o_orderdate) = 2"),
    f="first second difference difference_pct")
add("compare_years", lambda t: g.compare_years(t.orders, "o_orderdate", "o_totalprice", 1990, 1998),
    _COMPARE.format("year(o_orderdate) = 1990", "year(o_orderdate) = 1998"),
    f="first second difference difference_pct")
add("compare_entities", lambda t: g.compare_entities(t.sales, "region", ["ASIA", "EUROPE", "ATLANTIS"], "revenue"),
    """WITH s AS (SELECT
         count(*) FILTER (region = 'ASIA') AS c1, sum(revenue) FILTER (region = 'ASIA') AS t1, avg(revenue) FILTER (region = 'ASIA') AS a1,
         count(*) FILTER (region = 'EUROPE') AS c2, sum(revenue) FILTER (region = 'EUROPE') AS t2, avg(revenue) FILTER (region = 'EUROPE') AS a2
       FROM sales)
       SELECT 'count' AS metric, c1::DOUBLE AS "ASIA", c2::DOUBLE AS "EUROPE", 0.0::DOUBLE AS "ATLANTIS", 'ATLANTIS' AS unknown FROM s
       UNION ALL SELECT 'total', t1, t2, NULL, 'ATLANTIS' FROM s UNION ALL SELECT 'average', a1, a2, NULL, 'ATLANTIS' FROM s""",
    f="ASIA EUROPE ATLANTIS")
add("change_breakdown", lambda t: g.change_breakdown(
        t.sales, "date", "revenue", (dt.date(1996, 1, 1), dt.date(1997, 1, 1)),
        (dt.date(1997, 1, 1), dt.date(1998, 1, 1)), ["region", "segment", "product"]),
    """WITH s AS (SELECT region, segment, product, CASE WHEN year(date) = 1996 THEN revenue ELSE 0 END AS a,
                         CASE WHEN year(date) = 1997 THEN revenue ELSE 0 END AS b
                  FROM sales WHERE year(date) IN (1996, 1997)),
       l AS (SELECT 'region' AS dimension, region AS category, a, b FROM s UNION ALL
             SELECT 'segment', segment, a, b FROM s UNION ALL SELECT 'product', product, a, b FROM s)
       SELECT dimension, category, sum(a) AS first, sum(b) AS second, sum(b) - sum(a) AS change,
              (sum(b) - sum(a)) * 100 / (SELECT sum(b) - sum(a) FROM s) AS share FROM l GROUP BY 1, 2""",
    f="first second change share")
add("consistency_check", lambda t: g.consistency_check(
        t.dirty, "amount", F.col("net_revenue"), 0.5),
    """SELECT count(abs(amount - net_revenue)) AS checked,
              count(*) FILTER (abs(amount - net_revenue) > 0.5) AS failing, max(abs(amount - net_revenue)) AS largest_gap,
              count(*) FILTER (abs(amount - net_revenue) > 0.5) * 100.0 / count(abs(amount - net_revenue)) AS failing_pct
       FROM dirty""", f="largest_gap failing_pct")
add("inconsistent_rows", lambda t: g.inconsistent_rows(t.dirty, "amount", F.col("net_revenue"), 0.5).select("order_id"),
    "SELECT order_id FROM dirty WHERE abs(amount - net_revenue) > 0.5")
add("matching_rows", lambda t: g.matching_rows(
        t.orders, g.text_is(t.orders, "o_orderstatus", "f"), ["o_orderkey"]).select("o_orderkey", "total_rows"),
    """SELECT o_orderkey, count(*) OVER () AS total_rows FROM orders WHERE o_orderstatus = 'F'
       ORDER BY o_orderkey LIMIT 20""")

# --- rankings ---
for high, order in ((True, "DESC"), (False, "ASC")):
    tag = "highest" if high else "lowest"
    add(f"extreme_row_{tag}", lambda t, high=high: g.extreme_row(t.orders, "o_totalprice", high)
        .select("o_orderkey", "o_totalprice"),
        f"""SELECT o_orderkey, o_totalprice FROM orders
            ORDER BY o_totalprice {order}, o_orderkey LIMIT 1""", f="o_totalprice")
    add(f"extreme_group_{tag}", lambda t, high=high: g.extreme_group(t.sales, "customer", "revenue", high),
        f"SELECT customer, sum(revenue) AS value FROM sales GROUP BY 1 ORDER BY 2 {order}, 1 LIMIT 1", f="value")
    add(f"extreme_day_{tag}", lambda t, high=high: g.extreme_day(t.events, "ts", "value", high),
        f"SELECT CAST(ts AS DATE) AS day, sum(value) AS value FROM events GROUP BY 1 ORDER BY 2 {order}, 1 LIMIT 1",
        f="value", dates="day")
    add(f"top_rows_{tag}", lambda t, high=high: g.top_rows(t.orders, "o_totalprice", 25, high)
        .select("o_orderkey", "o_totalprice"),
        f"SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice {order}, o_orderkey LIMIT 25",
        f="o_totalprice")
    add(f"top_groups_{tag}", lambda t, high=high: g.top_groups(t.sales, "brand", "revenue", 10, high),
        f"""SELECT brand, sum(revenue) AS value, count(*) OVER () AS available FROM sales GROUP BY 1
            ORDER BY 2 {order}, 1 LIMIT 10""", f="value")
add("top_groups", lambda t: g.top_groups(g.filter_year(t.orders, "o_orderdate", 1997), "o_orderpriority", "o_totalprice", 3),
    """SELECT o_orderpriority, sum(o_totalprice) AS value, count(*) OVER () AS available FROM orders
       WHERE year(o_orderdate) = 1997 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3""", f="value")
add("rank_groups", lambda t: g.rank_groups(t.sales, "customer", "revenue"),
    """SELECT customer, sum(revenue) AS value, row_number() OVER (ORDER BY sum(revenue) DESC, customer) AS position
       FROM sales GROUP BY 1""", f="value")
add("winner_monthly", lambda t: g.winner_monthly(t.sales, "region", "revenue", "date"),
    f"""WITH w AS (SELECT region FROM sales GROUP BY 1 ORDER BY sum(revenue) DESC, 1 LIMIT 1)
        SELECT region, {MONTH.format('date')} AS month, sum(revenue) AS value FROM sales
        WHERE region = (SELECT region FROM w) GROUP BY 1, 2""", f="value", dates="month")
add("top_k_other", lambda t: g.top_k_other(t.sales, "brand", "revenue", 7),
    """WITH s AS (SELECT brand, sum(revenue) AS v FROM sales GROUP BY 1),
       r AS (SELECT *, row_number() OVER (ORDER BY v DESC, brand) AS p, count(*) OVER () AS n FROM s)
       SELECT CASE WHEN p <= 7 OR n <= 8 THEN brand ELSE 'Other' END AS brand, sum(v) AS value FROM r GROUP BY 1""",
    f="value")

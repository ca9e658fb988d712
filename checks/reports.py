"""Compositions: insights, recommendations and the report."""

from __future__ import annotations

from pyspark.sql import functions as F

import gridlore as g
from checks.registry import add
from gridlore.functions.shapes import union_all

TEXTS = ("product", "brand", "region", "segment")


def metric(kind: str, subject: str, name: str, value: str) -> str:
    return f"SELECT '{kind}' AS kind, {subject} AS subject, '{name}' AS metric, CAST({value} AS VARCHAR) AS value"


def _insights() -> str:
    two = lambda x: f"format('{{:.2f}}', {x})"
    parts = []
    out = "count(*) FILTER (revenue < q1 - 1.5 * (q3 - q1) OR revenue > q3 + 1.5 * (q3 - q1))"
    src = "FROM sales, (SELECT quantile_cont(revenue, 0.25) AS q1, quantile_cont(revenue, 0.75) AS q3 FROM sales) AS f"
    shape = "CASE WHEN abs(skewness(revenue)) < 0.5 THEN 'roughly symmetric' WHEN skewness(revenue) > 0 THEN 'right-skewed' ELSE 'left-skewed' END"
    for name, value in (("shape", shape), ("skew", two("skewness(revenue)")), ("mean", two("avg(revenue)")),
                        ("median", two("quantile_cont(revenue, 0.5)")), ("outliers", out), ("outlier_pct", two(f"{out} * 100.0 / count(*)"))):
        parts.append(f"{metric('distribution', chr(39) + 'revenue' + chr(39), name, value)} {src}")
    r = "corr(revenue, customer)"
    strength = f"CASE WHEN abs({r}) < 0.1 THEN 'none' WHEN abs({r}) < 0.4 THEN 'weak' WHEN abs({r}) < 0.7 THEN 'moderate' WHEN abs({r}) < 0.8 THEN 'strong' ELSE 'very strong' END"
    for name, value in (("r", f"format('{{:.3f}}', {r})"), ("strength", strength),
                        ("direction", f"CASE WHEN {r} > 0 THEN 'positive' ELSE 'negative' END"), ("exploratory", "count(*) < 30")):
        parts.append(f"{metric('relationship', chr(39) + 'revenue / customer' + chr(39), name, value)} FROM sales")
    for c in TEXTS:
        best = f"(SELECT {c} AS k, count(*) AS n FROM sales GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1) AS b"
        for name, value in (("value", "k"), ("modes", "1"), ("records", "n"),
                            ("share", "format('{:.1f}', n * 100.0 / (SELECT count(*) FROM sales))")):
            parts.append(f"{metric('most frequent', chr(39) + c + chr(39), name, value)} FROM {best}")
        sums = f"(SELECT {c} AS k, sum(revenue) AS v, count(*) AS n FROM sales GROUP BY 1 ORDER BY 2 {{}}, 1 LIMIT 1) AS b"
        whole = "(SELECT sum(revenue) FROM sales)"
        for name, value, order in (("top", "k", "DESC"), ("top_total", two("v"), "DESC"), ("top_records", "n", "DESC"),
                                   ("top_share", two(f"v * 100 / {whole}"), "DESC"), ("bottom", "k", "ASC"), ("bottom_total", two("v"), "ASC")):
            parts.append(f"{metric('group performance', chr(39) + c + chr(39), name, value)} FROM {sums.format(order)}")
    d = "CAST(date AS DATE)"
    for name, value in (("earliest", f"min({d})"), ("latest", f"max({d})"), ("days", f"datediff('day', min({d}), max({d})) + 1"),
                        ("unique_days", f"count(DISTINCT {d})")):
        parts.append(f"{metric('period', chr(39) + 'date' + chr(39), name, value)} FROM sales")
    return " UNION ALL ".join(parts)


add("insights", lambda t: g.insights(t.sales, keep=True).filter("kind <> 'extreme'")
    .select("kind", "subject", F.explode("metrics").alias("metric", "value")), _insights())
add("insights_extremes", lambda t: g.insights(t.orders).filter("kind = 'extreme'")
    .select("kind", "subject", F.explode("metrics").alias("metric", "value")),
    " UNION ALL ".join(
        f"""{metric('extreme', "'o_totalprice'", name, value)} FROM (SELECT *, count(*) OVER () AS n FROM orders
            WHERE o_totalprice = (SELECT {fn}(o_totalprice) FROM orders) ORDER BY o_orderdate, o_orderstatus, o_orderpriority LIMIT 2) AS x"""
        for which, fn in (("maximum", "max"), ("minimum", "min"))
        for name, value in (("which", f"'{which}'"), ("value", "format('{:.2f}', o_totalprice)"), ("records", "n"),
                            ("example", "'o_orderdate=' || CAST(CAST(o_orderdate AS DATE) AS VARCHAR) || ', o_orderstatus=' || o_orderstatus || ', o_orderpriority=' || o_orderpriority"))))

_TOP = "(SELECT priority FROM dirty WHERE net_revenue IS NOT NULL GROUP BY 1 ORDER BY sum(net_revenue) {}, 1 LIMIT 1)"
_PAIRS = " UNION ALL ".join(
    f"SELECT '{a} / {b}' AS p, corr({a}, {b}) AS r FROM dirty"
    for i, a in enumerate(("customer", "total_price", "amount", "net_revenue"))
    for b in ("customer", "total_price", "amount", "net_revenue")[i + 1:]
)
add("recommendations", lambda t: g.recommendations(t.dirty),
    f"""SELECT 1 AS priority, 'review missing values' AS kind, NULL AS subject,
          CAST((SELECT count(*) * 3 - count(total_price) - count(rare_flag) - count(note) FROM dirty) AS VARCHAR) AS detail
        UNION ALL SELECT 2, 'review duplicates', NULL, CAST((SELECT count(*) FROM dirty) - (SELECT count(*) FROM (SELECT DISTINCT * FROM dirty) AS d) AS VARCHAR)
        UNION ALL SELECT 3, 'compare segments', 'priority', {_TOP.format('DESC')} || ' .. ' || {_TOP.format('ASC')}
        UNION ALL SELECT 4, 'monitor segments', 'amount_text', 'net_revenue'
        UNION ALL SELECT 5, 'track over time', 'net_revenue', 'month'
        UNION ALL (SELECT 6, 'explore correlation', p, format('{{:.3f}}', r) FROM ({_PAIRS}) AS u ORDER BY abs(r) DESC LIMIT 1)""")
add("executive_summary", lambda t: g.executive_summary(t.sales, keep=True),
    """SELECT count(*) AS rows, 9 AS columns, 4 AS numeric, 4 AS categorical, 1 AS dates, 0 AS missing_cells,
         count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM sales) AS d) AS duplicate_rows, 'revenue' AS "primary",
         avg(revenue) AS mean, quantile_cont(revenue, 0.5) AS median, min(revenue) AS min, max(revenue) AS max,
         (SELECT product FROM sales GROUP BY 1 ORDER BY sum(revenue) DESC, 1 LIMIT 1) AS leading_category FROM sales""",
    f="mean median min max", digits=4)


def _report(t):
    """What the report's sections say, as rows (section, subject, metric, value)."""
    tables = g.report_tables(t.orders)

    def said(section: str, subject: str, *metrics: str):
        cells = [F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics]
        rows = tables[section].select(F.expr(subject).cast("string").alias("subject"), F.inline(F.array(*cells)))
        return rows.select(F.lit(section).alias("section"), "subject", "metric", "value")

    return union_all([
        said("overview", "'all'", "rows", "missing_cells", "duplicate_rows", "median"),
        said("columns", "column", "unique_values", "missing", "q3"), said("quality_score", "band", "score"),
        said("numeric_statistics", "column", "mean", "median", "std", "cv"), said("outliers", "column", "outliers", "iqr"),
        said("categorical_statistics", "column", "unique_values", "frequency", "n_modes"),
        said("top_categories", "concat(column, ' ', value)", "n", "place"),
        said("group_performance", "concat(dimension, ' ', category)", "total", "records", "share"), said("chart_ranked", "x", "value"),
        said("dates", "column", "valid", "unique_days", "span_days"), said("time_series", "concat(grain, ' ', period)", "value"),
        said("chart_box", "group", "n", "whisker_low", "whisker_high", "outliers"),
    ])


def _metrics(section: str, subject: str, source: str, **metrics: str) -> list[str]:
    return [f"SELECT '{section}' AS section, CAST({subject} AS VARCHAR) AS subject, '{m}' AS metric, CAST({v} AS DOUBLE) AS value FROM {source}"
            for m, v in metrics.items()]


def _report_sql() -> str:
    numbers, texts = ("o_orderkey", "o_custkey", "o_totalprice"), ("o_orderstatus", "o_orderpriority")
    q = lambda c: f"(SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM orders) AS f"
    low, high = "q1 - 1.5 * (q3 - q1)", "q3 + 1.5 * (q3 - q1)"
    out = lambda c: f"count(*) FILTER ({c} < {low} OR {c} > {high})"
    parts = _metrics("overview", "'all'", "orders", rows="count(*)", missing_cells="count(*) * 0", median="quantile_cont(o_totalprice, 0.5)",
                     duplicate_rows="count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM orders) AS d)")
    for c in (*numbers, *texts, "o_orderdate"):
        parts += _metrics("columns", f"'{c}'", "orders", unique_values=f"count(DISTINCT {c})", missing=f"count(*) - count({c})",
                          q3=f"quantile_cont({c}, 0.75)" if c in numbers else "max(NULL)")
    every = " + ".join(f"(SELECT {out(c)} FROM orders, {q(c)})" for c in numbers)
    score = f"100 - least(({every}) * 100.0 / (count(*) * 3) * 0.15, 10)"
    parts += _metrics("quality_score", f"CASE WHEN {score} >= 90 THEN 'Excellent' ELSE 'Good' END", "orders", score=score)
    for c in numbers:
        parts += _metrics("numeric_statistics", f"'{c}'", "orders", mean=f"avg({c})", median=f"quantile_cont({c}, 0.5)", std=f"stddev_samp({c})",
                          cv=f"stddev_samp({c}) * 100 / avg({c})")
        parts += _metrics("outliers", f"'{c}'", f"orders, {q(c)}", outliers=out(c), iqr="any_value(q3 - q1)")
    ranked = " UNION ALL ".join(
        f"SELECT '{c}' AS c, {c} AS v, count(*) AS n, sum(o_totalprice) AS s, row_number() OVER (ORDER BY count(*) DESC, {c}) AS place FROM orders GROUP BY {c}" for c in texts)
    source = f"({ranked}) AS g"
    parts += _metrics("categorical_statistics", "c", f"(SELECT c, count(*) AS d, max(n) AS m, count(*) FILTER (n = top) AS k FROM (SELECT *, max(n) OVER (PARTITION BY c) AS top FROM {source}) AS w GROUP BY c) AS x",
                      unique_values="d", frequency="m", n_modes="k")
    parts += _metrics("top_categories", "c || ' ' || v", source, n="n", place="place")
    parts += _metrics("group_performance", "c || ' ' || v", source, total="s", records="n", share="s * 100 / (SELECT sum(o_totalprice) FROM orders)")
    parts += _metrics("chart_ranked", "v", f"{source} WHERE c = 'o_orderstatus'", value="s")
    day = "CAST(o_orderdate AS DATE)"
    parts += _metrics("dates", "'o_orderdate'", "orders", valid="count(*)", unique_days=f"count(DISTINCT {day})", span_days=f"datediff('day', min({day}), max({day})) + 1")
    parts += _metrics("time_series", "'month ' || m", f"(SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS m, sum(o_totalprice) AS v FROM orders GROUP BY 1) AS x", value="v")
    c = "o_totalprice"
    parts += _metrics("chart_box", f"'{c}'", f"orders, {q(c)}", n="count(*)", whisker_low=f"min({c}) FILTER ({c} >= {low})",
                      whisker_high=f"max({c}) FILTER ({c} <= {high})", outliers=out(c))
    return " UNION ALL ".join(parts)


add("report_tables", _report, _report_sql(), f="value", digits=3)

"""Forecasting and its steps."""

from __future__ import annotations

import gridlore as g
from checks.registry import add

UNTIL = "o_orderdate < TIMESTAMP '2001-07-20'"
LOW = "o_orderpriority = '5-LOW'"
UNTIL_NTZ = "o_orderdate < TIMESTAMP_NTZ '2001-07-20'"


def spine(table: str, keys: str, ts: str, v: str, grain: str, label: str, where: str = "true") -> str:
    """Totals per period, gaps 0, with the period start ``p``, row number ``i`` and series length ``n``."""
    on = " AND ".join(f"b.{k} IS NOT DISTINCT FROM s.{k}" for k in keys.split(", ") if k)
    pick = f"{keys}, " if keys else ""
    own = "".join(f"s.{k} AS {k}, " for k in keys.split(", ") if k)
    part = f"PARTITION BY {keys}" if keys else ""
    group = f"GROUP BY {keys}" if keys else ""
    step = {"quarter": "INTERVAL 3 MONTH"}.get(grain, f"INTERVAL 1 {grain.upper()}")
    return f"""b AS (SELECT {pick}CAST(date_trunc('{grain}', {ts}) AS DATE) AS p, sum({v}) AS v FROM {table}
           WHERE {where} AND {ts} IS NOT NULL AND {v} IS NOT NULL GROUP BY ALL),
        e AS (SELECT {pick}unnest(generate_series(min(p)::TIMESTAMP, max(p)::TIMESTAMP, {step}))::DATE AS p FROM b {group}),
        y AS (SELECT {own}s.p AS p, coalesce(b.v, 0) AS v FROM e AS s LEFT JOIN b ON b.p = s.p {('AND ' + on) if on else ''}),
        series AS (SELECT *, {label} AS period, row_number() OVER ({part} ORDER BY p) - 1 AS i, count(*) OVER ({part}) AS n FROM y)"""


LABELS = {
    "D": ("day", "p"), "W": ("week", "p + 6"), "MS": ("month", "p"),
    "QE": ("quarter", "CAST(p + INTERVAL 3 MONTH AS DATE) - 1"), "Y": ("year", "CAST(p + INTERVAL 1 YEAR AS DATE) - 1"),
}
for _freq, (_grain, _label) in LABELS.items():
    add(f"resample_{_freq.lower()}", lambda t, f=_freq: g.resample(
            t.orders.filter("o_orderpriority = '5-LOW'"), "o_orderdate", "o_totalprice", f),
        f"WITH {spine('orders', '', 'o_orderdate', 'o_totalprice', _grain, _label, LOW)} "
        "SELECT period, v AS value FROM series", f="value", dates="period")
add("resample_many", lambda t: g.resample(t.sales, "date", "revenue", "MS", ("region", "segment")),
    f"WITH {spine('sales', 'region, segment', 'date', 'revenue', 'month', 'p')} SELECT region, segment, period, v AS value FROM series",
    f="value", dates="period")
add("trim_partial_period", lambda t: g.trim_partial_period(t.orders.filter(UNTIL_NTZ), "o_orderdate", "o_totalprice", "MS"),
    f"""WITH {spine('orders', '', 'o_orderdate', 'o_totalprice', 'month', 'p', UNTIL)}
        SELECT period, v AS value, DATE '2001-07-01' AS excluded_period FROM series WHERE p < DATE '2001-07-01'""",
    f="value", dates="period excluded_period")


def scores(keys: str, table: str, ts: str, v: str, where: str, cut: str) -> str:
    """Errors of the three models on the held-out end, as ``scores``."""
    part = f"PARTITION BY {keys}" if keys else ""
    k = f"{keys}, " if keys else ""
    same = " AND ".join(f"x.{c} = l.{c}" for c in keys.split(", ") if c) or "true"
    return f"""{spine(table, keys, ts, v, 'month', 'p', f'{where} AND {ts} < {cut}')},
        h AS (SELECT *, n - greatest(1, least(greatest(3, n // 5), n // 2)) AS train FROM series),
        lin AS (SELECT {k}regr_slope(v, i) AS a, regr_intercept(v, i) AS c FROM h WHERE i < train GROUP BY ALL),
        last AS (SELECT {k}v AS nv FROM h WHERE i = train - 1),
        pred AS (
          SELECT {k}i, 'naive' AS method, 0 AS o, v, (SELECT nv FROM last AS l WHERE {same}) AS f FROM h AS x WHERE i >= train
          UNION ALL SELECT {k}i, 'linear_trend', 1, v, (SELECT c + a * x.i FROM lin AS l WHERE {same}) FROM h AS x WHERE i >= train
          UNION ALL SELECT {k}i, 'seasonal_naive', 2, v,
            (SELECT l.v FROM h AS l WHERE {same} AND l.i = x.train - 12 + (x.i - x.train) % 12) FROM h AS x WHERE i >= train AND train >= 24),
        scores AS (SELECT {k}method, o, avg(abs(v - f)) AS mae, sqrt(avg((v - f) * (v - f))) AS rmse,
            avg(CASE WHEN abs(v) > 1e-9 THEN abs(v - f) / abs(v) END) * 100 AS mape,
            row_number() OVER ({part} ORDER BY avg(abs(v - f)), o) = 1 AS best FROM pred GROUP BY {k}method, o)"""


_ALL = scores("", "orders", "o_orderdate", "o_totalprice", UNTIL, "DATE '2001-07-01'")
_MANY = scores("region", "sales", "date", "revenue", "date < TIMESTAMP '2001-07-20'", "DATE '2001-07-01'")
add("backtest_scores", lambda t: g.backtest_scores(t.orders.filter(UNTIL_NTZ), "o_orderdate", "o_totalprice", "MS"),
    f"WITH {_ALL} SELECT method, mae, rmse, mape, best FROM scores", f="mae rmse mape")
add("backtest_scores_many", lambda t: g.backtest_scores(
        t.sales.filter("date < TIMESTAMP_NTZ '2001-07-20'"), "date", "revenue", "MS", ("region",)),
    f"WITH {_MANY} SELECT region, method, mae, rmse, mape, best FROM scores", f="mae rmse mape")


def forecast_sql(keys: str, base: str, horizon: int, first: str, year: int | None = None, last: str = "2001-07-01") -> str:
    """History tail and forecast; the first forecast month is ``gap + 1`` steps after the history."""
    k = f"{keys}, " if keys else ""
    part = f"PARTITION BY {keys}" if keys else ""
    same = " AND ".join(f"x.{c} = l.{c}" for c in keys.split(", ") if c) or "true"
    kb = "".join(f"l.{c}, " for c in keys.split(", ") if c)
    on = (f"JOIN best AS l ON {same}" if keys else "CROSS JOIN best AS l")
    use = f"USING ({keys})" if keys else "ON true"
    keep = f"WHERE year(period) = {year}" if year else ""
    return f"""WITH {base},
        best AS (SELECT * FROM scores WHERE best),
        d AS (SELECT {k}stddev_pop(step) AS wobble FROM (SELECT {k}v - lag(v) OVER ({part} ORDER BY p) AS step FROM series) AS s GROUP BY ALL),
        m AS (SELECT {k}regr_slope(v, i) AS a, regr_intercept(v, i) AS c, max(n) AS n, max(p) AS last_p, arg_max(v, p) AS final FROM series GROUP BY ALL),
        z AS (SELECT {k}method, mae, rmse, mape, a, c, n, last_p, final, 1.96 * greatest(mae, wobble) AS band
              FROM best JOIN d {use} JOIN m {use}),
        f AS (SELECT z.*, CAST(DATE '{first}' + to_months(CAST(j AS INT)) AS DATE) AS period,
                datediff('month', last_p, CAST(DATE '{first}' + to_months(CAST(j AS INT)) AS DATE)) AS ahead FROM z, range(0, {horizon}) AS r(j)),
        g AS (SELECT x.*, CASE method WHEN 'naive' THEN final WHEN 'linear_trend' THEN c + a * (x.n - 1 + ahead)
                ELSE (SELECT l.v FROM series AS l WHERE {same} AND l.i = x.n - 12 + (x.ahead - 1) % 12) END AS value FROM f AS x)
        SELECT {k}'history' AS kind, x.period AS period, x.v AS value, NULL::DOUBLE AS lower, NULL::DOUBLE AS upper,
               l.method, l.mae, l.rmse, l.mape, DATE '{last}' AS excluded_period, 'ok' AS status
        FROM series AS x {on} WHERE x.i >= x.n - 24
        UNION ALL SELECT {k}'forecast', period, value, value - band, value + band, method, mae, rmse, mape, DATE '{last}', 'ok' FROM g {keep}
        """.replace(f"SELECT {k}'history'", f"SELECT {kb}'history'")


_F = "value lower upper mae rmse mape"
add("forecast", lambda t: g.forecast(t.orders.filter(UNTIL_NTZ), "o_orderdate", "o_totalprice", "MS", horizon=6),
    forecast_sql("", _ALL, 6, "2001-08-01"), f=_F, dates="period excluded_period")
add("forecast_many", lambda t: g.forecast(
        t.sales.filter("date < TIMESTAMP_NTZ '2001-07-20'"), "date", "revenue", "MS", horizon=15, group_cols=("region",)),
    forecast_sql("region", _MANY, 15, "2001-08-01"), f=_F, dates="period excluded_period")
add("forecast_target_year", lambda t: g.forecast(
        t.orders.filter(UNTIL_NTZ), "o_orderdate", "o_totalprice", target_year=2002),
    forecast_sql("", _ALL, 18, "2001-08-01", 2002), f=_F, dates="period excluded_period")
add("forecast_rest_of_year", lambda t: g.forecast(
        t.orders.filter(UNTIL_NTZ), "o_orderdate", "o_totalprice", target_year=2001),
    forecast_sql("", _ALL, 5, "2001-08-01", 2001), f=_F, dates="period excluded_period")
add("forecast_covered_year", lambda t: g.forecast(t.orders, "o_orderdate", "o_totalprice", target_year=1999)
    .select("kind", "status"),
    "SELECT 'refused' AS kind, 'already covered' AS status FROM (SELECT max(o_orderdate) AS d FROM orders) AS m WHERE year(d) > 1999")
add("forecast_many_series", lambda t: g.forecast(t.orders, "o_orderdate", "o_totalprice", "QE", 4, group_cols=("o_custkey",)))

"""Forecasts on series with known answers."""

import datetime as dt

import pytest

import gridlore as g

SEASON = [0, 50, 100, 40, -20, 80, 120, 60, -10, 30, 90, 140]


def monthly(spark):
    rows = [(dt.date(2023 + i // 12, i % 12 + 1, 1), 1000.0 + 25 * i + SEASON[i % 12]) for i in range(36)]
    return spark.createDataFrame(rows, "date date, revenue double")


def daily(spark, level):
    start = dt.date(2023, 1, 1)
    days = [start + dt.timedelta(days=i) for i in range(900)]
    return spark.createDataFrame([(d, float(level(d.month))) for d in days], "date date, revenue double")


def parts(df, kind):
    return [r for r in df.orderBy("period").collect() if r["kind"] == kind]


def test_next_months_and_target_year(spark):
    three = parts(g.forecast(monthly(spark), "date", "revenue", horizon=3), "forecast")
    assert [str(r["period"]) for r in three] == ["2026-01-01", "2026-02-01", "2026-03-01"]
    assert all(r["lower"] < r["value"] < r["upper"] and r["mae"] is not None for r in three)
    assert three[0]["excluded_period"] is None
    year = parts(g.forecast(monthly(spark), "date", "revenue", target_year=2027), "forecast")
    assert len(year) == 12 and {r["period"].year for r in year} == {2027}


def test_partial_month_is_left_out_and_labels_follow_the_data(spark):
    out = g.forecast(daily(spark, lambda m: 100 + 10 * m), "date", "revenue")
    history, future = parts(out, "history"), parts(out, "forecast")
    assert str(history[-1]["period"]) == "2025-05-01" and len(history) == 24
    assert str(future[0]["period"]) == "2025-07-01" and str(future[0]["excluded_period"]) == "2025-06-01"


def test_seasonal_values_line_up_with_their_months(spark):
    future = parts(g.forecast(daily(spark, lambda m: 100 * m), "date", "revenue", horizon=3), "forecast")
    assert [r["value"] for r in future] == pytest.approx([700 * 31, 800 * 31, 900 * 30])


def test_current_year_rest_and_covered_year(spark):
    df = daily(spark, lambda m: 100 + 10 * m)
    rest = parts(g.forecast(df, "date", "revenue", target_year=2025), "forecast")
    assert [r["period"].month for r in rest] == [7, 8, 9, 10, 11, 12]
    refused = g.forecast(df, "date", "revenue", target_year=2024).collect()
    assert [r["status"] for r in refused] == ["already covered"]


def test_short_series_are_refused_and_others_are_not(spark):
    long = [("a", dt.date(2024, 1, 1) + dt.timedelta(days=i), float(i)) for i in range(40)]
    short = [("b", dt.date(2024, 1, 1 + i), 1.0) for i in range(3)]
    df = spark.createDataFrame(long + short, "k string, d date, v double")
    out = g.forecast(df, "d", "v", "D", 2, group_cols=("k",)).collect()
    assert {r["status"] for r in out if r["k"] == "b"} == {"too few time points"}
    future = sorted((str(r["period"]), r["value"]) for r in out if r["k"] == "a" and r["kind"] == "forecast")
    assert future == [("2024-02-10", pytest.approx(40)), ("2024-02-11", pytest.approx(41))]


def test_gaps_are_zero(spark):
    df = spark.createDataFrame([(dt.date(2024, 1, 31), 5.0), (dt.date(2024, 4, 1), 7.0)], "d date, v double")
    rows = {str(r["period"]): r["value"] for r in g.resample(df, "d", "v", "MS").collect()}
    assert rows == {"2024-01-01": 5.0, "2024-02-01": 0.0, "2024-03-01": 0.0, "2024-04-01": 7.0}
    weeks = {str(r["period"]): r["value"] for r in g.resample(df, "d", "v", "W").collect()}
    assert weeks["2024-02-04"] == 5.0 and weeks["2024-04-07"] == 7.0 and len(weeks) == 10


def test_partly_covered_final_month_is_not_the_lowest(spark):
    out = g.time_extremes(daily(spark, lambda m: 100 + 10 * m), "date", "revenue").first()
    assert str(out["partial_until"]) == "2025-06-18" and str(out["lowest_period"]) == "2023-02-01"

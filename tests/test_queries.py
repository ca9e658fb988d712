"""Filters, aggregates and rankings on small tables."""

import math

import pytest

import gridlore as g


def values(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def test_totals_and_periods(sample):
    assert g.total(sample, "fare_amount").first()["value"] == 310 + 128 + 455 + 97 + 260
    march = g.filtered_aggregate(sample, "fare_amount", "sum", g.within_month(sample, "day", 1998, 3))
    assert march.first()["value"] == 310 + 128
    day = g.filtered_aggregate(sample, "fare_amount", "sum", g.within_day(sample, "day", "1998-05-17"))
    assert day.first()["value"] == 455 + 97
    nothing = g.filtered_aggregate(sample, "fare_amount", "sum", g.within_year(sample, "day", 1961))
    assert nothing.first()["value"] == 0


def test_distinct_and_counts(sample):
    assert values(g.distinct_values(sample, "harbour"), "value") == [("Old Pier",), ("Sandholm",), ("West Quay",)]
    assert g.row_count(sample).first()["rows"] == 5
    assert g.count_distinct(sample, "boat").first()["distinct_values"] == 3


def test_nan_is_missing_everywhere(spark):
    df = spark.createDataFrame([(1, float("nan")), (2, 5.0), (3, None), (4, -1.0)], "id long, v double")
    assert values(g.filter_numeric(df, "v", ">", 0), "id") == [(2,)]
    assert values(g.filter_numeric(df, "v", "!=", 5), "id") == [(1,), (3,), (4,)]
    assert values(g.rows_missing(df, "v"), "id") == [(1,), (3,)]
    assert g.average(df, "v").first()["value"] == 2.0
    assert g.extreme_row(df, "v").first()["id"] == 2
    assert g.dataset_summary(df).first()["missing_cells"] == 2


def test_missing_group_is_kept_and_top_groups_says_how_many_exist(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), (None, 9), ("b", 4)], "k string, v long")
    assert {(r["k"], r["value"]) for r in g.group_aggregate(df, "k", "v").collect()} == {("a", 3), (None, 9), ("b", 4)}
    top = g.top_groups(df, "k", "v", 99).collect()
    assert [r["k"] for r in top] == [None, "b", "a"] and top[0]["available"] == 3


def test_comparison_with_nothing_has_no_percentage(sample):
    row = g.compare_months(sample, "day", "fare_amount", (1997, 1), (1998, 5)).first()
    assert (row["first"], row["second"], row["difference_pct"]) == (0, 552, None)


def test_positions_are_a_whole_ranking(spark):
    df = spark.range(5000).selectExpr("id", "cast(id % 7 as double) as v")
    ranked = g.rank_groups(df, "id", "v").collect()
    assert sorted(r["position"] for r in ranked) == list(range(1, 5001))
    ordered = sorted(ranked, key=lambda r: r["position"])
    assert [(-r["value"], r["id"]) for r in ordered] == sorted((-r["value"], r["id"]) for r in ranked)


def test_line_is_thinned_but_keeps_its_order(spark):
    df = spark.range(20000).selectExpr("cast(id as double) as x", "cast(id % 3 as double) as y")
    xs = sorted(r["x"] for r in g.line_data(df, "x", "y", 5000).collect())
    assert xs == [float(i) for i in range(0, 20000, 4)]


def test_charts_are_refused_before_a_job_runs(sample):
    with pytest.raises(ValueError, match="Did you mean 'fare_amount'"):
        g.check_chart(sample, "bar", "boat", "fare_am")
    with pytest.raises(ValueError, match="not numeric"):
        g.check_chart(sample, "scatter", "boat", "riders")
    g.check_chart(sample, "bar", "boat", "riders")


def test_pie_folds_small_groups_and_never_a_single_one(spark):
    eight = spark.createDataFrame([(f"g{i}", float(i + 1)) for i in range(8)], "k string, v double")
    assert "Other" not in {r["k"] for r in g.pie_data(eight, "k", "v").collect()}
    nine = spark.createDataFrame([(f"g{i}", float(i + 1)) for i in range(9)], "k string, v double")
    rows = {r["k"]: r["value"] for r in g.pie_data(nine, "k", "v").collect()}
    assert len(rows) == 8 and rows["Other"] == 3.0


def test_histogram_of_a_constant(spark):
    rows = g.histogram(spark.range(10).selectExpr("5.0D as v"), "v").collect()
    assert sum(r["n"] for r in rows) == 10
    assert math.isclose(min(r["bin_low"] for r in rows), 4.5) and math.isclose(max(r["bin_high"] for r in rows), 5.5)


@pytest.mark.parametrize("sql", [
    "DROP TABLE df", "SELECT 1; SELECT 2", "SELECT * FROM '/etc/hostname'", "INSERT INTO df VALUES (1)",
    "SELECT * FROM read_csv('/etc/hostname')", "SELECT * FROM parquet.`/tmp/x`", "SELECT * FROM glob('/*')",
    "SELECT reflect('java.lang.System', 'getenv')",
])
def test_sql_only_reads_tables(spark, sample, sql):
    with pytest.raises(ValueError):
        g.run_sql(spark, {"df": sample}, sql)


def test_sql_over_a_table(spark, sample):
    sql = "SELECT harbour, sum(riders) AS total FROM df GROUP BY harbour ORDER BY total DESC LIMIT 1 OFFSET 1;"
    assert g.run_sql(spark, {"df": sample}, sql).first()["total"] == 82

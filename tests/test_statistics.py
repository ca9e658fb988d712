"""Quantiles and profiles against brute force."""

import math
import random

import numpy as np
import pytest

import gridlore as g
from gridlore.functions.quantiles import exact_quantiles

PROBS = {"p0": 0.0, "p10": 0.1, "q1": 0.25, "median": 0.5, "q3": 0.75, "p99": 0.99, "p100": 1.0}


def made(seed):
    rnd = random.Random(seed)
    return [
        [rnd.uniform(-1, 1) for _ in range(1001)],
        [rnd.gauss(0, 1e6) for _ in range(777)] + [0.0, -0.0, 1e-310, -1e-310],
        [float(rnd.randint(-3, 3)) for _ in range(500)],
        [2.0 ** k for k in range(-60, 60)] + [-(2.0 ** k) for k in range(-60, 60)],
        [7.25] * 300 + [rnd.random() for _ in range(100)],
        [1.0 + i * 2.0 ** -50 for i in range(200)],
        [math.nextafter(2.0 ** k, d) for k in range(1, 40) for d in (0, 1e9)],
        [3.0], [1.0, 2.0],
        [1.7e308, -1.7e308, 1e300, 5.0, float("inf"), float("-inf"), 4.0],
    ]


@pytest.mark.parametrize("small", [True, False])
def test_quantiles_equal_a_full_sort(spark, small):
    groups = made(7)
    rows = [(i, v) for i, vs in enumerate(groups) for v in vs]
    df = spark.createDataFrame(rows, "k int, value double").repartition(5)
    got = {r["k"]: r for r in exact_quantiles(df, ["k"], PROBS, small_keys=small).collect()}
    assert len(got) == len(groups)
    for i, vs in enumerate(groups):
        vs = sorted(vs)
        assert got[i]["n"] == len(vs)
        for name, p in PROBS.items():
            at = (len(vs) - 1) * p
            low, high = vs[math.floor(at)], vs[math.ceil(at)]
            want = low if low == high else low + (high - low) * (at - math.floor(at))
            same = (math.isnan(want) and math.isnan(got[i][name])) or got[i][name] == want
            assert same or math.isclose(got[i][name], want, rel_tol=1e-12), (i, name)


def test_uniform_has_no_outliers_and_spiked_has(spark):
    even = spark.range(5000).selectExpr("cast(id as double) as v")
    assert g.outlier_profile(even).first()["outliers"] == 0
    spiked = spark.createDataFrame([(float(100 + i % 20),) for i in range(2000)] + [(900.0,), (950.0,), (1000.0,)], "amount double")
    assert g.outlier_profile(spiked).first()["outliers"] == 3
    facts = g.fact_sheet(spiked).first()
    assert facts["outliers"] == 3 and facts["shape"] == "right-skewed"


def test_few_values_are_not_assessed(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (None,)], "v double")
    row = g.outlier_profile(df).first()
    assert row["status"] == "not assessed" and row["n"] == 2 and row["q1"] is None


def test_skewness_is_bias_corrected(spark):
    vs = [1.0, 2.0, 2.5, 9.0, 4.0, 4.5]
    row = g.numeric_statistics(spark.createDataFrame([(v,) for v in vs], "v double")).first()
    x = np.array(vs) - np.mean(vs)
    n = len(vs)
    g1 = np.mean(x**3) / np.mean(x**2) ** 1.5
    assert math.isclose(row["skew"], g1 * math.sqrt(n * (n - 1)) / (n - 2), rel_tol=1e-9)
    assert math.isclose(row["std"], np.std(vs, ddof=1), rel_tol=1e-12)


def test_profile_of_empty_identifier_and_wide_columns(spark):
    empty = spark.createDataFrame([(i, None) for i in range(3)], "a long, b double")
    rows = {r["column"]: r for r in g.profile(empty).collect()}
    assert rows["b"]["all_missing"] and rows["b"]["mean"] is None and rows["a"]["mean"] == 1.0
    ids = spark.createDataFrame([(f"u{i}",) for i in range(100)], "id string")
    assert g.profile(ids).first()["is_identifier_like"]
    wide = spark.range(3).selectExpr(*[f"id as col_{i}" for i in range(50)])
    part = g.profile(wide, 10).collect()
    assert len(part) == 10 and part[0]["truncated_columns"] == 40


def test_roles_need_name_and_content(spark):
    df = spark.createDataFrame(
        [("2024-01-01 10:00:00", "5%", i, "x") for i in range(30)],
        "created_at string, flat_rate string, order_id int, label string",
    )
    roles = g.roles_of(df)
    assert roles.dates == ["created_at"] and roles.categorical == ["flat_rate", "label"]
    assert roles.identifiers == ["order_id"] and roles.measures == []
    assert [r["column"] for r in g.stats_date_columns(df).collect()] == ["created_at"]


def test_modes_list_all_ties(spark):
    df = spark.createDataFrame([("a",), ("b",), ("a",), ("b",), ("c",), (None,)], "v string")
    row = g.categorical_summary(df, ["v"]).first()
    assert (row["top"], row["n_modes"], row["frequency"], row["share"]) == ("a, b", 2, 2, 40.0)


def test_report_tables_can_be_written(spark, sample, tmp_path):
    names = g.write_report(sample, str(tmp_path / "report"))
    assert {"overview", "columns", "quality_score", "insights", "time_series"} <= set(names)
    score = spark.read.parquet(str(tmp_path / "report" / "quality_score")).first()
    assert score["score"] == 100.0 and score["band"] == "Excellent"

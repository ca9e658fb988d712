"""The gate's findings on small tables."""

import pytest

import gridlore as g


def issues(df):
    return {r["issue"]: r["severity"] for r in g.dq_issues(df).collect()}


def test_clean_table_is_ready(spark):
    df = spark.createDataFrame(
        [("A", 100, "North"), ("B", 200, "South"), ("C", 150, "North"), ("D", 175, "West")],
        "customer string, revenue long, region string",
    )
    assert issues(df) == {}
    assert g.dq_status(df).first()["status"] == "READY"


def test_few_missing_values_are_only_noted(spark):
    df = spark.createDataFrame([(None if i == 2 else chr(65 + i), i) for i in range(10)], "customer string, revenue long")
    assert issues(df) == {"Missing values present": "INFO"}
    assert g.dq_status(df).first()["analysis_ready"]


def test_mostly_missing_column_blocks(spark):
    df = spark.createDataFrame([(chr(65 + i), None if i < 8 else 100.0 * i) for i in range(10)], "customer string, income double")
    assert issues(df)["Extremely high missing values"] == "BLOCKING"


def test_several_findings_at_once(spark):
    rows = [("2026-01-01" if i < 25 else "bad", str(i) if i < 25 else "bad", "North") for i in range(30)]
    df = spark.createDataFrame(rows + rows[:1], "order_date string, amount string, region string")
    found = issues(df)
    assert found["Invalid / inconsistent date values"] == "BLOCKING"
    assert found["Numeric values stored as text / mixed numeric type"] == "BLOCKING"
    assert found["Duplicate records"] == "WARNING"  # 5 of 31
    assert found["Constant / zero-variation columns"] == "WARNING"
    plan = g.cleaning_plan(df).orderBy("priority").collect()
    assert [p["severity"] for p in plan] == ["BLOCKING"] * 2 + ["WARNING"] * 2


def test_empty_and_constant_columns(spark):
    df = spark.createDataFrame([(None, "same", i) for i in range(30)], "empty string, constant string, value long")
    found = {r["issue"]: r["columns"] for r in g.dq_issues(df).collect()}
    assert found["Completely empty columns"] == ["empty"]
    assert found["Constant / zero-variation columns"] == ["empty", "constant"]


def test_variants_and_infinite_values(spark):
    rows = [(["North", "north ", "NORTH"][i % 3], float("inf") if i == 4 else float(i)) for i in range(30)]
    df = spark.createDataFrame(rows, "city string, amount double")
    found = {r["issue"]: r for r in g.dq_issues(df).collect()}
    assert found["Inconsistent categorical values"]["affected_rows"] == 30
    assert found["Non-finite numeric values"]["affected_rows"] == 1
    assert {r["variant"] for r in g.category_variants(df, "city").collect()} == {"North", "north ", "NORTH"}


@pytest.mark.parametrize("rows, schema", [([], "a long, b string")])
def test_table_without_rows_blocks(spark, rows, schema):
    assert issues(spark.createDataFrame(rows, schema)) == {"Empty dataset": "BLOCKING"}


def test_structure(spark):
    assert issues(spark.range(3).select()) == {"No columns": "BLOCKING"}
    assert issues(spark.range(3).selectExpr("id", "id + 1 as `Unnamed: 0`"))["Blank / placeholder column names"] == "BLOCKING"
    assert issues(spark.range(3).selectExpr("id as a", "id as a"))["Duplicate column names"] == "BLOCKING"


def test_duplicates_and_drilldown(spark):
    df = spark.createDataFrame([(1, 10.0), (1, 10.0), (2, float("nan")), (2, None), (4, 40.0)], "id long, value double")
    assert g.duplicate_count(df).first()["duplicate_rows"] == 2  # NaN and NULL are the same gap
    assert sorted(r["copies"] for r in g.duplicate_rows(df).collect()) == [2, 2]

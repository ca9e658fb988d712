"""Which integer columns are unique, settled by range, sketch, bits or values."""

import pytest

import gridlore as g
from gridlore.operators import roles


@pytest.mark.parametrize("expr,unique", [
    ("id", True), ("id - 50000", True), ("id * 63", True), ("id * 1000003 - 77", True), ("if(id = 9, 8, id)", False),
    ("if(id = 9, 8, id) * 1000003", False), ("id % 100", False), ("id div 2", False), ("if(id = 5, null, id)", True), ("cast(null as bigint)", False),
    ("id * 9000000000000", True), ("cast(id as smallint)", True), ("if(id = 3, 9223372036854775807, if(id = 4, -9223372036854775808, id))", True),
])
def test_unique_integers(spark, expr, unique):
    df = spark.range(3000, numPartitions=5).selectExpr(f"{expr} as headcount", "'x' as kind")
    assert {r["column"]: r["all_unique"] for r in roles._unique_integers(df).collect()} == {"headcount": unique}


def test_identifiers_by_values(spark):
    df = spark.range(3000).selectExpr("id * 3 as bay", "id % 7 as headcount", "cast(id as double) as fare_amount")
    assert {r["column"]: r["is_identifier"] for r in g.column_roles(df).collect()} == {"bay": True, "headcount": False, "fare_amount": False}

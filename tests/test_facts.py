"""The facts stage: how often it reads the source, and that its sections equal the functions for one section."""

import math

import pytest
from pyspark.sql import functions as F

import gridlore as g
from checks.compare import differences
from gridlore.operators.facts import TableFacts, repeated_rows


@pytest.fixture(scope="module")
def trips(spark):
    return spark.range(400).selectExpr(
        "id as trip_id", "cast(id % 37 as double) * 1.5 + if(id % 90 = 0, 4000, 0) as fare_amount", "cast(id % 11 as int) as riders",
        "if(id % 13 = 0, null, concat('boat ', id % 3)) as boat", "if(id % 5 = 0, ' Pier', 'pier') as stop",
        "cast(date_add(date'1998-01-01', cast(id as int)) as timestamp_ntz) as day", "'ferry' as kind", "if(id % 100 = 0, null, 1.0D) as flag")


def counted(spark, df):
    """df, and a function that says how often all of it has been read since."""
    rows, total = spark.sparkContext.accumulator(0), df.count()

    def seen(batches):
        for batch in batches:
            rows.add(batch.num_rows)
            yield batch

    return df.mapInArrow(seen, df.schema), lambda: rows.value / total


def test_the_source_is_read_a_fixed_number_of_times(spark, trips):
    df, reads = counted(spark, trips)
    g.dq_issues(df).collect()
    gate = reads()
    assert gate <= 8
    roles = g.roles_of(trips)
    g.insights(df, roles).collect()
    assert reads() - gate <= 14
    before = reads()
    for table in g.report_tables(df, roles).values():
        table.collect()
    assert reads() - before <= 32
    # a wider report doesn't read more often
    wide = trips.select("*", *[(F.col("riders") * k + F.col("fare_amount")).alias(f"extra_{k}_amount") for k in range(6)])
    more, again = counted(spark, wide)
    for table in g.report_tables(more, g.roles_of(wide)).values():
        table.collect()
    assert again() <= 32


def test_sections_equal_the_single_functions(trips):
    roles = g.roles_of(trips)
    tables = g.report_tables(trips, roles)
    m = roles.primary
    single = {
        "columns": g.column_profile(trips, roles), "numeric_statistics": g.numeric_statistics(trips, roles.numeric),
        "outliers": g.outlier_profile(trips, roles.numeric), "categorical_statistics": g.categorical_summary(trips, roles.categorical),
        "group_performance": g.group_shares(trips, roles.categorical, m, 10), "chart_ranked": g.ranked_bar_data(trips, roles.categorical[0], m),
        "dates": g.date_profile(trips, roles.dates), "time_series": g.time_aggregation(trips, roles.dates[0], m),
        "time_extremes": g.time_extremes(trips, roles.dates[0], m), "correlations": g.correlation_matrix(trips, roles.measures),
        "relationship": g.relationship(trips, m, roles.secondary), "chart_box": g.box_stats(trips, m), "quality_gate": g.dq_issues(trips),
    }
    for name, want in single.items():
        rounded = lambda df: df.toPandas().map(lambda v: round(v, 9) if isinstance(v, float) and not math.isnan(v) else str(v) if isinstance(v, list) or hasattr(v, "tolist") else v)
        assert differences(rounded(tables[name]), rounded(want)) is None, name


@pytest.mark.parametrize("values,found", [(4, False), (5, True), (9, True)])
def test_outliers_need_five_different_values(spark, values, found):
    # 96 rows over the values, of which the last is far away and in 4 rows
    df = spark.range(100).selectExpr(f"if(id < 4, 1000000D, cast(id % {values - 1} as double)) as v")
    assert {r["issue"] for r in g.dq_outliers(df).collect()} == ({"Potential outliers"} if found else set())


def test_few_different_numbers_are_told_from_several(spark):
    names = [f"v{n}" for n in range(1, 12)]
    df = spark.range(5000, numPartitions=16).selectExpr(*[f"cast(pmod(hash(id), {n}) as double) * 1e9 as v{n}" for n in range(1, 12)])
    facts = TableFacts(df)
    assert all(facts.known[f"v{n}"]["bits"] <= n for n in range(1, 12))
    assert facts.several(names, 5) == {f"v{n}": n >= 5 for n in range(1, 12)}


@pytest.mark.parametrize("distinct,found", [(94, False), (95, True), (100, True)])
def test_high_cardinality_on_both_sides_of_its_limit(spark, distinct, found):
    df = spark.range(100).selectExpr(f"concat('v', least(id, {distinct - 1})) as v")
    rows = g.dq_high_cardinality(df).collect()
    assert [r["affected_rows"] for r in rows] == ([distinct] if found else [])


def test_repeats_by_digest_are_compared_whole(spark):
    rows = [(1, None, 0.0), (1, None, -0.0), (None, 1, 0.0), (None, 1, 2.0), (None, None, float("nan")), (None, None, None), (3, 3, 3.0)]
    df = spark.createDataFrame(rows, "a int, b int, c double")
    got = sorted((r["a"], r["b"], r["c"], r["_copies"]) for r in repeated_rows(df).collect() if r["a"])
    assert got == [(1, None, 0.0, 2)] and repeated_rows(df).count() == 2
    assert g.dataset_summary(df).first()["duplicate_rows"] == 2


def test_columns_of_one_name_are_all_looked_at(spark):
    df = spark.createDataFrame([(1.0, "x", None)] * 3, "a double, a string, b string")
    found = {r["issue"]: list(r["columns"]) for r in g.dq_issues(df).collect()}
    assert found["Duplicate column names"] == ["a"] and found["Completely empty columns"] == ["b"]
    assert found["Constant / zero-variation columns"] == ["a", "a_2", "b"] and "Duplicate records" in found


def test_caps_are_arguments(spark, trips):
    wide = trips.select("trip_id", "fare_amount", "day", *[F.concat(F.lit(f"c{k} "), F.col("riders") % 3).alias(f"cat_{k}") for k in range(8)])
    told = {r["subject"] for r in g.insights(wide).filter("kind = 'most frequent'").collect()}
    assert told == {f"cat_{k}" for k in range(8)}
    assert {r["subject"] for r in g.insights(wide, categories=3).filter("kind = 'most frequent'").collect()} == {f"cat_{k}" for k in range(3)}
    sheet = g.fact_sheet(wide).filter("section = 'category'")
    assert sheet.count() == 8 and g.fact_sheet(wide, categories=6).filter("section = 'category'").count() == 6
    assert {r["grain"] for r in g.time_aggregation(trips, "day", "fare_amount", grain="week").collect()} == {"week"}
    tied = spark.createDataFrame([(f"v{k}",) for k in range(7)], "v string")
    assert g.categorical_summary(tied, ["v"]).first()["top"].endswith("...")
    assert g.categorical_summary(tied, ["v"], named_modes=None).first()["top"].count("v") == 7


def test_insights_count_the_values_of_categories_alone(trips, monkeypatch):
    from gridlore.operators import facts

    asked, plain = [], facts.value_frequencies
    monkeypatch.setattr(facts, "value_frequencies", lambda df, names: asked.extend(names) or plain(df, names))
    roles = g.roles_of(trips)
    g.insights(trips, roles).collect()
    assert set(asked) == set(roles.categorical) and len(asked) == len(roles.categorical)


def test_a_summary_reads_one_number_column_for_its_median(trips, monkeypatch):
    from gridlore.operators import facts

    asked, plain = [], facts.quartile_facts
    monkeypatch.setattr(facts, "quartile_facts", lambda df, names, finite: asked.append(names) or plain(df, names, finite))
    roles = g.roles_of(trips)
    g.executive_summary(trips, roles).collect()
    assert asked == [[roles.primary]]


def test_a_kept_input_is_read_once(spark, trips):
    roles = g.roles_of(trips)
    for f in (g.insights, g.executive_summary):
        df, reads = counted(spark, trips)
        got = f(df, roles, keep=True)
        assert differences(got.withColumn("metrics", F.to_json("metrics")).toPandas() if "metrics" in got.columns else got.toPandas(),
                           f(trips, roles).withColumn("metrics", F.to_json("metrics")).toPandas() if "metrics" in got.columns else f(trips, roles).toPandas()) is None
        assert reads() == 1


@pytest.mark.parametrize("broadcast", [0, 300_000])
def test_repeated_rows_are_counted_either_way(spark, trips, monkeypatch, broadcast):
    from gridlore.operators import facts

    monkeypatch.setattr(facts, "BROADCAST_DIGESTS", broadcast)
    df, reads = counted(spark, trips)
    assert TableFacts(trips.union(trips.limit(7)).union(trips.limit(7))).duplicate_rows == 14
    of = TableFacts(df)
    of.columns
    before = reads()
    assert of.duplicate_rows == 0 and reads() - before == 1  # nothing repeats, so nothing is read again to be compared

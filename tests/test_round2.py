"""Cases that an earlier version got wrong."""

import pytest

import gridlore as g


def test_unique_names_pass_over_taken_ones():
    assert g.unique_names(["a", "a", "a_2"]) == ["a", "a_3", "a_2"]
    assert g.unique_names(["a", "a", "a"]) == ["a", "a_2", "a_3"]


def test_other_keeps_small_groups(spark):
    rows = [("big", 1e17)] + [(f"s{k}", 0.25) for k in range(4)]
    got = {r["k"]: r["value"] for r in g.top_k_other(spark.createDataFrame(rows, "k string, v double"), "k", "v", 2).collect()}
    assert got == {"big": 1e17, "s0": 0.25, "Other": 0.75}


def test_agreement_ignores_line_ends(spark):
    got = g.results_agree(spark.createDataFrame([("Different items: 4", "3\n")], "p string, s string"), "p", "s").collect()[0]
    assert True in [v for v in got if isinstance(v, bool)]


def test_no_caps_by_default(spark):
    wide = spark.range(30).selectExpr(*[f"id * {k} + rand({k}) AS c{k}" for k in range(12)])
    assert g.correlation_matrix(wide, wide.columns).select("a").distinct().count() == 12
    many = spark.range(6000).selectExpr("concat('value ', id) AS v")
    assert g.known_values(many).count() == 6000
    assert g.known_values(many, max_values=5000).count() == 0


def test_csv_doubled_quotes(spark, tmp_path):
    (tmp_path / "q.csv").write_text('a,b\n"say ""hi""",1\n')
    assert g.read_csv(spark, str(tmp_path / "q.csv")).first()["a"] == 'say "hi"'


def test_csv_missing_tokens_and_line_breaks(spark, tmp_path):
    (tmp_path / "m.csv").write_text('a,b,c\n1,x,"one\ntwo"\nNA,N/A,three\n2.5,y,null\n')
    df = g.read_csv(spark, str(tmp_path / "m.csv"), multi_line=True)
    assert dict(df.dtypes) == {"a": "double", "b": "string", "c": "string"}
    assert [tuple(r) for r in df.collect()] == [(1.0, "x", "one\ntwo"), (None, None, "three"), (2.5, "y", None)]


def test_admission_leaves_rows_as_they_are(spark):
    rows = [(None, 0.0, 9007199254740995), (None, 1.0, None), (1, 0.0, 1), (1, 5.0, 2)]
    df = spark.createDataFrame(rows, "s long, t double, big long")
    got = {(r["s"], r["t"]): (r["big"], r["allowed"]) for r in g.session_admission(df, "s", "t").collect()}
    assert got == {(None, 0.0): (9007199254740995, True), (None, 1.0): (None, False), (1, 0.0): (1, True), (1, 5.0): (2, True)}


def test_claims_with_missing_ids_keep_their_values(spark):
    claims = spark.createDataFrame([(None, "an otter", ""), (1, "an otter", "otter")], "id int, claim string, evidence string")
    values = g.known_values(spark.createDataFrame([("otter",)], "v string"))
    assert [r["id"] for r in g.stray_values(claims, values, ["id"], "claim", "evidence").collect()] == [None]


def test_sql_gate_reads_the_plan(spark):
    df = spark.range(3).toDF("x")
    spark.range(7).createOrReplaceTempView("kept_view")
    for sql in ("SELECT * FROM parquet/**/.`/tmp/x`", "SELECT * FROM kept_view", "SELECT * FROM range(5)",
                "WITH a AS (SELECT * FROM kept_view), kept_view AS (SELECT 1) SELECT * FROM a",
                "SELECT sum(x) OVER w FROM t WINDOW w AS (ORDER BY reflect('java.lang.System', 'getenv'))"):
        with pytest.raises(ValueError):
            g.run_sql(spark, {"t": df}, sql)
    assert g.run_sql(spark, {"t": df}, "SELECT count(*) AS n FROM t WHERE 'UPDATE' <> 'DROP'").first()["n"] == 3
    assert g.run_sql(spark, {"kept_view": df}, "SELECT * FROM kept_view").count() == 3
    assert spark.table("kept_view").count() == 7 and not spark.catalog.tableExists("t")

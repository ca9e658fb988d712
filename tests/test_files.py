"""Reading and writing files."""

import pytest

import gridlore as g


def write(tmp_path, name, data):
    path = tmp_path / name
    path.write_bytes(data if isinstance(data, bytes) else data.encode())
    return str(path)


def test_types_are_inferred_and_dates_promoted(spark, tmp_path):
    path = write(tmp_path, "a.csv", "date,product,revenue\n1/15/2024,Laptop,75000\n3/22/2024,Phone,47000\n")
    df = g.read_csv(spark, path)
    assert dict(df.dtypes)["revenue"] == "int"
    promoted = g.promote_dates(df)
    assert dict(promoted.dtypes)["date"] == "timestamp_ntz"
    assert [str(r["date"])[:10] for r in promoted.orderBy("date").collect()] == ["2024-01-15", "2024-03-22"]


def test_latin_1_is_a_fallback(spark, tmp_path):
    path = write(tmp_path, "l.csv", "name,city\nJosé,Málaga\n".encode("latin-1"))
    assert g.read_csv(spark, path).first()["name"] == "José"
    utf = write(tmp_path, "u.csv", "name,city\nJosé,Málaga\n")
    assert g.read_csv(spark, utf).first()["city"] == "Málaga"


def test_repeated_names_are_numbered(spark, tmp_path):
    path = write(tmp_path, "d.csv", "name,name,revenue\na,b,1\n")
    assert g.read_csv(spark, path).columns == ["name", "name_2", "revenue"]
    assert g.unique_names(["a", "a", "b", "a"]) == ["a", "a_2", "b", "a_3"]


@pytest.mark.parametrize("text, kw, message", [
    ("name,amount\n", {}, "nothing but a header"), ("", {}, "no header line"), ("a,b,c\n1,2,3\n", {"max_cols": 2}, "limit of 2"),
    ("a\n1\n2\n3\n", {"max_rows": 2}, "limit of 2 rows"),
])
def test_unusable_files_are_refused(spark, tmp_path, text, kw, message):
    with pytest.raises(ValueError, match=message):
        g.read_csv(spark, write(tmp_path, "x.csv", text), **kw)


@pytest.mark.parametrize("fmt", ["parquet", "json", "csv", "orc"])
def test_tables_are_written(spark, sample, tmp_path, fmt):
    path = str(tmp_path / fmt)
    g.write_table(sample, path, fmt)
    back = spark.read.option("header", True).format(fmt).load(path)
    assert back.count() == 5 and set(back.columns) == set(sample.columns)

"""The rows behind a quality finding."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlore.functions.columns import as_number, as_ts, col, fold, missing, present, require, strip
from gridlore.operators.facts import repeated_rows
from gridlore.operators.profile import fences, quantile_table

__all__ = [
    "rows_missing", "duplicate_rows", "non_numeric_values", "invalid_date_values",
    "category_variants", "outlier_rows", "negative_rows",
]


def rows_missing(df: DataFrame, name: str) -> DataFrame:
    require(df, name)
    return df.filter(missing(df, name))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows that occur more than once, each once, with its number of ``copies``."""
    return repeated_rows(df).withColumnRenamed("_copies", "copies")


def _unreadable(df: DataFrame, name: str, parsed) -> DataFrame:
    return (
        df.filter(~missing(df, name) & parsed.isNull())
        .groupBy(col(name).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    )


def non_numeric_values(df: DataFrame, name: str) -> DataFrame:
    require(df, name)
    return _unreadable(df, name, as_number(df, name))


def invalid_date_values(df: DataFrame, name: str) -> DataFrame:
    require(df, name)
    return _unreadable(df, name, as_ts(df, name))


def category_variants(df: DataFrame, name: str) -> DataFrame:
    """Spellings of one category that differ in case or surrounding blanks only."""
    require(df, name)
    c = present(df, name).cast("string")
    forms = (
        df.filter(c.isNotNull())
        .groupBy(fold(c).alias("category"), c.alias("variant"), strip(c).alias("trimmed"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    several = forms.groupBy("category").agg(F.count(F.lit(1)).alias("variants")).filter("variants > 1")
    return forms.drop("trimmed").join(several, "category")


def outlier_rows(df: DataFrame, name: str) -> DataFrame:
    """Rows with values outside the 1.5 × IQR fences of the column."""
    require(df, name)
    limits = fences(quantile_table(df, [name]), ["column"]).select(
        F.struct("iqr", "low", "high").alias("f")
    ).scalar()
    v = as_number(df, name)
    return df.filter((limits["iqr"] > 0) & ((v < limits["low"]) | (v > limits["high"])))


def negative_rows(df: DataFrame, name: str) -> DataFrame:
    require(df, name)
    return df.filter(as_number(df, name) < 0)

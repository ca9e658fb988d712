"""Row filters. Conditions are plain columns, so they reach the scan as pushed filters."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridlore.functions.columns import (
    as_number, as_ts, col, dtype_of, fold, is_floating, require, rows_total, text_columns,
)

__all__ = [
    "numeric_is", "number_between", "text_is", "text_in", "within_day", "within_month",
    "within_year", "within_dates", "filter_numeric", "filter_between", "filter_all", "filter_any",
    "filter_equals_ci", "filter_in_ci", "filter_cat_numeric", "filter_day", "filter_month",
    "filter_year", "contains_value", "locate_value", "search_rows", "capped_rows", "plottable", "coerced",
]


# --- conditions -------------------------------------------------------------

def _number(df: DataFrame, name: str) -> tuple[Column, Column]:
    """The value to compare and a guard against NaN, kept apart so the comparison is pushed."""
    require(df, name)
    dtype = dtype_of(df, name)
    if not isinstance(dtype, T.NumericType):
        return as_number(df, name), F.lit(True)
    guard = ~F.isnan(col(name)) if is_floating(dtype) else F.lit(True)
    return col(name), guard


def numeric_is(df: DataFrame, name: str, op: str, value: float) -> Column:
    """``name op value``; a missing value satisfies only ``!=``."""
    c, guard = _number(df, name)
    v = F.lit(value)
    if op == "!=":
        return ~c.eqNullSafe(v)
    compare = {
        ">": c > v, ">=": c >= v, "<": c < v, "<=": c <= v, "=": c == v, "==": c == v,
    }
    if op not in compare:
        raise ValueError(f"Unknown operator {op!r}")
    return compare[op] & guard


def number_between(df: DataFrame, name: str, low: float, high: float) -> Column:
    c, guard = _number(df, name)
    return c.between(low, high) & guard


def text_is(df: DataFrame, name: str, value: str) -> Column:
    require(df, name)
    return fold(col(name).cast("string")) == F.lit(value.strip().lower())


def text_in(df: DataFrame, name: str, values: list[str]) -> Column:
    require(df, name)
    return fold(col(name).cast("string")).isin([v.strip().lower() for v in values])


def within_dates(df: DataFrame, name: str, start: dt.date, end: dt.date) -> Column:
    """The half-open range [start, end), comparable with file statistics."""
    require(df, name)
    dtype = dtype_of(df, name)
    if isinstance(dtype, T.DateType):
        c, kind = col(name), "date"
    elif isinstance(dtype, T.TimestampType):
        c, kind = col(name), "timestamp"
    else:
        c, kind = as_ts(df, name), "timestamp_ntz"
    return (c >= F.lit(start.isoformat()).cast(kind)) & (c < F.lit(end.isoformat()).cast(kind))


def _month_after(year: int, month: int) -> dt.date:
    return dt.date(year + month // 12, month % 12 + 1, 1)


def within_day(df: DataFrame, name: str, day: str | dt.date) -> Column:
    d = dt.date.fromisoformat(day) if isinstance(day, str) else day
    return within_dates(df, name, d, d + dt.timedelta(days=1))


def within_month(df: DataFrame, name: str, year: int, month: int) -> Column:
    return within_dates(df, name, dt.date(year, month, 1), _month_after(year, month))


def within_year(df: DataFrame, name: str, year: int) -> Column:
    return within_dates(df, name, dt.date(year, 1, 1), dt.date(year + 1, 1, 1))


# --- filters ----------------------------------------------------------------

def filter_numeric(df: DataFrame, name: str, op: str, value: float) -> DataFrame:
    return df.filter(numeric_is(df, name, op, value))


def filter_between(df: DataFrame, name: str, low: float, high: float) -> DataFrame:
    return df.filter(number_between(df, name, low, high))


def filter_all(df: DataFrame, *conditions: Column) -> DataFrame:
    return df.filter(reduce(lambda a, b: a & b, conditions)) if conditions else df


def filter_any(df: DataFrame, *conditions: Column) -> DataFrame:
    return df.filter(reduce(lambda a, b: a | b, conditions)) if conditions else df


def filter_equals_ci(df: DataFrame, name: str, value: str) -> DataFrame:
    return df.filter(text_is(df, name, value))


def filter_in_ci(df: DataFrame, name: str, values: list[str]) -> DataFrame:
    return df.filter(text_in(df, name, values))


def filter_cat_numeric(df: DataFrame, name: str, value: str, condition: Column) -> DataFrame:
    return df.filter(text_is(df, name, value) & condition)


def filter_day(df: DataFrame, ts: str, day: str | dt.date) -> DataFrame:
    return df.filter(within_day(df, ts, day))


def filter_month(df: DataFrame, ts: str, year: int, month: int) -> DataFrame:
    return df.filter(within_month(df, ts, year, month))


def filter_year(df: DataFrame, ts: str, year: int) -> DataFrame:
    return df.filter(within_year(df, ts, year))


def contains_value(df: DataFrame, name: str, value: str) -> DataFrame:
    """One row: does the value occur in the column."""
    return df.agg(F.coalesce(F.bool_or(text_is(df, name, value)), F.lit(False)).alias("found"))


def locate_value(df: DataFrame, value: str) -> DataFrame:
    """Text columns that hold the value, with how often; ``accepted`` when there is only one."""
    names = text_columns(df)
    counts = df.agg(
        *[F.count_if(text_is(df, n, value)).alias(f"c{i}") for i, n in enumerate(names)]
    )
    pairs = [
        F.struct(F.lit(n).alias("column"), F.col(f"c{i}").alias("matches"))
        for i, n in enumerate(names)
    ]
    hits = counts.select(F.filter(F.array(*pairs), lambda p: p["matches"] > 0).alias("hits"))
    return hits.select(F.inline("hits"), (F.size("hits") == 1).alias("accepted"))


def search_rows(df: DataFrame, needle: str) -> DataFrame:
    """Rows where any column contains the text, whatever its case."""
    wanted = F.lit(needle.lower())
    return filter_any(
        df, *[F.contains(F.lower(col(n).cast("string")), wanted) for n in df.columns]
    )


def capped_rows(df: DataFrame, n: int, order_by: list[Column | str]) -> DataFrame:
    """The first ``n`` rows in an order, each with the number of rows there are in all."""
    return df.orderBy(*order_by).limit(n).withColumn("total_rows", rows_total(df))


def plottable(df: DataFrame, x: str, y: str) -> DataFrame:
    """Rows with both values present and readable as numbers."""
    require(df, x, y)
    return df.select(as_number(df, x).alias(x), as_number(df, y).alias(y)).dropna()


def coerced(df: DataFrame, numbers: tuple[str, ...] = (), dates: tuple[str, ...] = ()) -> DataFrame:
    """Add ``<name>_number`` / ``<name>_ts`` columns; values that do not parse are NULL."""
    return df.withColumns(
        {f"{n}_number": as_number(df, n) for n in numbers}
        | {f"{n}_ts": as_ts(df, n) for n in dates}
    )

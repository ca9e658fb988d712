"""Totals, grouped aggregates, distinct counts and comparisons.

A sum over nothing is 0 and a missing group key is a group of its own.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlore.functions.columns import (
    as_day, as_number, col, fold, measure, missing, percent, present, require, rows_total, strip,
)
from gridlore.operators.filters import within_dates, within_month, within_year

__all__ = [
    "total", "average", "filtered_aggregate", "period_aggregate", "group_aggregate",
    "group_aggregate2", "daily_aggregate", "monthly_totals", "yearly_totals", "row_count",
    "count_distinct", "count_distinct_days", "distinct_values", "count_distinct_where",
    "distinct_where", "compare_months", "compare_years", "compare_entities", "change_breakdown",
    "consistency_check", "inconsistent_rows", "group_metrics",
]


def aggregate_of(df: DataFrame, m: str, agg: str) -> Column:
    require(df, m)
    v = measure(df, m)
    forms = {
        "sum": lambda: F.coalesce(F.sum(v).cast("double"), F.lit(0.0)),
        "mean": lambda: F.avg(v),
        "avg": lambda: F.avg(v),
        "count": lambda: F.count(v),
        "min": lambda: F.min(v),
        "max": lambda: F.max(v),
    }
    if agg not in forms:
        raise ValueError(f"Unknown aggregate {agg!r}; use one of {sorted(forms)}")
    return forms[agg]().alias("value")


def total(df: DataFrame, m: str) -> DataFrame:
    return df.agg(aggregate_of(df, m, "sum"))


def average(df: DataFrame, m: str) -> DataFrame:
    return df.agg(aggregate_of(df, m, "mean"))


def filtered_aggregate(df: DataFrame, m: str, agg: str, where: Column) -> DataFrame:
    return df.filter(where).agg(aggregate_of(df, m, agg))


def period_aggregate(
    df: DataFrame, m: str, agg: str, ts: str, start: dt.date, end: dt.date
) -> DataFrame:
    """Aggregate over the half-open period [start, end)."""
    return filtered_aggregate(df, m, agg, within_dates(df, ts, start, end))


def group_aggregate(df: DataFrame, key: str, m: str, agg: str = "sum") -> DataFrame:
    require(df, key)
    return df.groupBy(present(df, key).alias(key)).agg(aggregate_of(df, m, agg))


def group_aggregate2(df: DataFrame, k1: str, k2: str, m: str, agg: str = "sum") -> DataFrame:
    require(df, k1, k2)
    keys = [present(df, k).alias(k) for k in (k1, k2)]
    return df.groupBy(*keys).agg(aggregate_of(df, m, agg))


def daily_aggregate(df: DataFrame, ts: str, m: str, agg: str = "sum") -> DataFrame:
    require(df, ts)
    return df.groupBy(as_day(df, ts).alias("day")).agg(aggregate_of(df, m, agg))


def monthly_totals(df: DataFrame, ts: str, m: str, where: Column | None = None) -> DataFrame:
    """Total per calendar month; rows without a usable date form one group of their own."""
    require(df, ts)
    rows = df if where is None else df.filter(where)
    return rows.groupBy(F.trunc(as_day(df, ts), "month").alias("month")).agg(aggregate_of(df, m, "sum"))


def yearly_totals(df: DataFrame, ts: str, m: str) -> DataFrame:
    require(df, ts)
    return df.groupBy(F.year(as_day(df, ts)).alias("year")).agg(aggregate_of(df, m, "sum"))


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("rows"))


def count_distinct(df: DataFrame, name: str, approx: bool = False) -> DataFrame:
    require(df, name)
    count = F.approx_count_distinct if approx else F.count_distinct
    return df.agg(count(present(df, name)).alias("distinct_values"))


def count_distinct_days(df: DataFrame, ts: str) -> DataFrame:
    require(df, ts)
    return df.agg(F.count_distinct(as_day(df, ts)).alias("distinct_days"))


def distinct_values(df: DataFrame, name: str) -> DataFrame:
    """Every value once, trimmed, without missing and empty ones."""
    require(df, name)
    value = strip(present(df, name).cast("string"))
    return df.select(value.alias("value")).filter(F.col("value") != "").distinct()


def count_distinct_where(df: DataFrame, name: str, where: Column) -> DataFrame:
    return count_distinct(df.filter(where), name)


def distinct_where(df: DataFrame, name: str, where: Column) -> DataFrame:
    return distinct_values(df.filter(where), name)


# --- comparisons ------------------------------------------------------------

def _compare(df: DataFrame, m: str, first: Column, second: Column) -> DataFrame:
    v = measure(df, m)
    both = df.filter(first | second).agg(
        F.coalesce(F.sum(F.when(first, v)).cast("double"), F.lit(0.0)).alias("first"),
        F.coalesce(F.sum(F.when(second, v)).cast("double"), F.lit(0.0)).alias("second"),
    )
    change = F.col("second") - F.col("first")
    return both.select(
        "first", "second", change.alias("difference"),
        percent(change, F.col("first")).alias("difference_pct"),
    )


def compare_months(
    df: DataFrame, ts: str, m: str, first: tuple[int, int], second: tuple[int, int]
) -> DataFrame:
    """One row: totals of two months, their difference and its share of the first."""
    require(df, ts, m)
    return _compare(df, m, within_month(df, ts, *first), within_month(df, ts, *second))


def compare_years(df: DataFrame, ts: str, m: str, first: int, second: int) -> DataFrame:
    require(df, ts, m)
    return _compare(df, m, within_year(df, ts, first), within_year(df, ts, second))


def compare_entities(df: DataFrame, key: str, values: list[str], m: str) -> DataFrame:
    """One row per metric, one column per entity; ``unknown`` lists entities without rows."""
    require(df, key, m)
    folded, v = fold(col(key).cast("string")), measure(df, m)
    wanted = [x.strip().lower() for x in values]
    aggs = []
    for i, x in enumerate(wanted):
        mine = folded == x
        aggs += [
            F.count_if(mine).cast("double").alias(f"count_{i}"),
            F.sum(F.when(mine, v)).cast("double").alias(f"total_{i}"),
            F.avg(F.when(mine, v)).alias(f"average_{i}"),
        ]
    one = df.filter(folded.isin(wanted)).agg(*aggs)
    unknown = F.filter(
        F.array(*[F.when(F.col(f"count_{i}") == 0, F.lit(x)) for i, x in enumerate(values)]),
        lambda x: x.isNotNull(),
    )
    rows = [
        F.struct(
            F.lit(metric).alias("metric"),
            *[F.col(f"{metric}_{i}").alias(x) for i, x in enumerate(values)],
        )
        for metric in ("count", "total", "average")
    ]
    return one.select(F.inline(F.array(*rows)), F.array_join(unknown, ", ").alias("unknown"))


def change_breakdown(
    df: DataFrame, ts: str, m: str, first: tuple[dt.date, dt.date],
    second: tuple[dt.date, dt.date], dims: list[str],
) -> DataFrame:
    """How much each category of each dimension moved between two periods.

    ``share`` is the category's part of the overall change. It describes an
    association in the data, not a cause.
    """
    require(df, ts, m, *dims)
    a, b = within_dates(df, ts, *first), within_dates(df, ts, *second)
    v = measure(df, m).cast("double")
    rows = df.filter(a | b).select(
        F.coalesce(F.when(a, v), F.lit(0.0)).alias("_a"),
        F.coalesce(F.when(b, v), F.lit(0.0)).alias("_b"),
        *[present(df, d).cast("string").alias(d) for d in dims],
    )
    long = rows.unpivot(["_a", "_b"], [col(d) for d in dims], "dimension", "category")
    parts = long.groupBy("dimension", "category").agg(
        F.sum("_a").alias("first"), F.sum("_b").alias("second")
    )
    overall = rows.agg((F.sum("_b") - F.sum("_a")).alias("change")).scalar()
    change = F.col("second") - F.col("first")
    return parts.select(
        "dimension", "category", "first", "second", change.alias("change"),
        percent(change, overall).alias("share"),
    )


def _gap(df: DataFrame, name: str, expected: Column) -> Column:
    return F.abs(as_number(df, name) - expected.cast("double"))


def consistency_check(df: DataFrame, name: str, expected: Column, tolerance: float) -> DataFrame:
    """One row: how many rows could be checked and how many differ by more than the tolerance."""
    require(df, name)
    gap = _gap(df, name, expected)
    checked = df.agg(
        F.count(gap).alias("checked"), F.count_if(gap > tolerance).alias("failing"),
        F.max(gap).alias("largest_gap"),
    )
    return checked.withColumn("failing_pct", percent(F.col("failing"), F.col("checked")))


def inconsistent_rows(df: DataFrame, name: str, expected: Column, tolerance: float) -> DataFrame:
    return df.filter(_gap(df, name, expected) > tolerance)


def group_metrics(df: DataFrame, key: str, m: str) -> DataFrame:
    """Total, average and count per category; rows without key or measure are left out."""
    require(df, key, m)
    v = measure(df, m).cast("double")
    return (
        df.filter(~missing(df, key) & v.isNotNull())
        .groupBy(col(key))
        .agg(F.sum(v).alias("total"), F.avg(v).alias("average"), F.count(v).alias("count"))
    )


def shares_of_total(groups: DataFrame, value: str = "total") -> Column:
    """The percentage each group's value is of the sum over all groups."""
    whole = groups.agg(F.sum(value).alias("whole")).scalar()
    return percent(F.col(value), F.nullif(whole, F.lit(0.0)))


def composition(df: DataFrame, key: str, m: str) -> DataFrame:
    """Share of the whole by category."""
    groups = group_metrics(df, key, m)
    return groups.select(col(key), "total", shares_of_total(groups).alias("share"))


def matching_rows(df: DataFrame, where: Column, order_by: list[Column | str], n: int = 20) -> DataFrame:
    """The first rows that satisfy a condition and how many there are in all."""
    hits = df.filter(where)
    return hits.orderBy(*order_by).limit(n).withColumn("total_rows", rows_total(hits))


__all__ += ["composition", "matching_rows"]

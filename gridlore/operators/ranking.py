"""Extremes, top lists and rankings.

Ties are broken by the key (or by all columns) ascending. Top lists are
``orderBy().limit()``, which keeps n rows per task; only the full ranking sorts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlore.functions.columns import as_day, col, measure, missing, present, require, rows_total
from gridlore.functions.positions import with_position
from gridlore.operators.aggregates import aggregate_of, group_aggregate

__all__ = [
    "extreme_row", "extreme_group", "extreme_day", "top_rows", "top_groups", "rank_groups",
    "winner_monthly", "top_k_other",
]


def _ordered(c: Column, highest: bool) -> Column:
    return c.desc_nulls_last() if highest else c.asc_nulls_last()


def top_rows(df: DataFrame, m: str, n: int, highest: bool = True) -> DataFrame:
    require(df, m)
    ties = [col(c).asc_nulls_last() for c in df.columns]
    return df.orderBy(_ordered(measure(df, m), highest), *ties).limit(n)


def extreme_row(df: DataFrame, m: str, highest: bool = True) -> DataFrame:
    return top_rows(df.filter(~missing(df, m)), m, 1, highest)


def _best(groups: DataFrame, key: str, n: int, highest: bool) -> DataFrame:
    return groups.orderBy(_ordered(F.col("value"), highest), col(key).asc_nulls_last()).limit(n)


def extreme_group(df: DataFrame, key: str, m: str, highest: bool = True) -> DataFrame:
    return _best(group_aggregate(df, key, m), key, 1, highest)


def extreme_day(df: DataFrame, ts: str, m: str, highest: bool = True) -> DataFrame:
    require(df, ts)
    days = df.groupBy(as_day(df, ts).alias("day")).agg(aggregate_of(df, m, "sum"))
    return _best(days, "day", 1, highest)


def top_groups(df: DataFrame, key: str, m: str, n: int, highest: bool = True) -> DataFrame:
    """The n groups with the largest totals and, in ``available``, how many groups exist."""
    groups = group_aggregate(df, key, m)
    return _best(groups, key, n, highest).withColumn("available", rows_total(groups))


def rank_groups(df: DataFrame, key: str, m: str, highest: bool = True) -> DataFrame:
    """Every group with its position by total."""
    groups = group_aggregate(df, key, m)
    return with_position(groups, [_ordered(F.col("value"), highest), col(key).asc_nulls_last()])


def winner_monthly(df: DataFrame, key: str, m: str, ts: str, highest: bool = True) -> DataFrame:
    """Monthly totals of the group with the highest (lowest) total; undated rows are dropped."""
    require(df, ts)
    winner = extreme_group(df, key, m, highest).select(col(key)).scalar()
    day = as_day(df, ts)
    return (
        df.filter(present(df, key).eqNullSafe(winner) & day.isNotNull())
        .groupBy(present(df, key).alias(key), F.trunc(day, "month").alias("month"))
        .agg(aggregate_of(df, m, "sum"))
    )


def fold_small_groups(groups: DataFrame, key: str, value: str, k: int) -> DataFrame:
    """Keep the k largest groups and add the rest up as ``Other``.

    With up to k + 1 groups all are kept: one group is never renamed to ``Other``.
    """
    order = [F.col(value).desc_nulls_last(), col(key).asc_nulls_last()]
    best = groups.orderBy(*order).limit(k + 1)
    # at most k + 1 rows from here on
    ranked = best.withColumn("_place", F.row_number().over(Window.orderBy(*order)))
    n = groups.agg(F.count(F.lit(1)).alias("n")).scalar()
    kept = ranked.filter((F.col("_place") <= k) | (n <= k + 1))
    named = kept.select(col(key).cast("string").alias(key), F.col(value).alias(value))
    # the rest is added up by itself: a whole minus its top loses small groups beside large ones
    top = F.broadcast(ranked.filter(F.col("_place") <= k).select(col(key).alias("_top")))
    rest = groups.join(top, col(key).eqNullSafe(F.col("_top")), "left_anti").agg(F.sum(value).alias(value)).filter(
        n > k + 1).select(F.lit("Other").alias(key), value)
    return named.unionByName(rest)


def top_k_other(df: DataFrame, key: str, m: str, k: int = 7) -> DataFrame:
    """The k largest groups by total, the others added up under ``Other``."""
    require(df, key)
    groups = df.filter(~missing(df, key)).groupBy(col(key)).agg(aggregate_of(df, m, "sum"))
    return fold_small_groups(groups, key, "value", k)

"""Plan fragments that turn columns into rows.

Statistics over many columns come from one wide aggregate (a single scan, one
partial row per task) that is then exploded to a row per column. Anything that
needs the distinct values goes through ``(column, value)`` counts instead, which
are combined before the shuffle and spread over all reducers.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridlore.functions.columns import col, dtype_of, present

COLUMNS_PER_SCAN = 40


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def per_column(
    df: DataFrame, names: list[str], facts: Callable[[str], dict[str, Column]]
) -> DataFrame:
    """One row per column with the aggregates ``facts(name)`` gives for it.

    Wide tables are aggregated some columns at a time so that the generated
    aggregate code stays small enough to be compiled.
    """
    order = {n: i for i, n in enumerate(df.columns)}
    frames = []
    for start in range(0, len(names), COLUMNS_PER_SCAN):
        chunk = names[start : start + COLUMNS_PER_SCAN]
        packed = [
            F.struct(
                F.lit(order[n]).alias("position"),
                F.lit(n).alias("column"),
                *[c.alias(k) for k, c in facts(n).items()],
            ).alias(f"c{i}")
            for i, n in enumerate(chunk)
        ]
        one = df.agg(*packed)
        frames.append(one.select(F.inline(F.array(*[F.col(f"c{i}") for i in range(len(chunk))]))))
    return union_all(frames)


def _kind(dtype: T.DataType) -> str:
    if isinstance(dtype, T.IntegralType):
        return "bigint"
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return "double"
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return dtype.simpleString()
    return "string"


def stacked(df: DataFrame, columns: list[Column]) -> DataFrame:
    """``(place, value)`` rows for columns of one type, missing values dropped."""
    picked = df.select(*[c.alias(f"c{i}") for i, c in enumerate(columns)])
    pairs = [x for i in range(len(columns)) for x in (F.lit(i), F.col(f"c{i}"))]
    rows = picked.select(F.stack(F.lit(len(columns)), *pairs).alias("place", "value"))
    return rows.filter(F.col("value").isNotNull())


def named(df: DataFrame, names: list[str]) -> DataFrame:
    """Replace the small number ``place`` by the name it stands for."""
    labels = F.array(*[F.lit(n) for n in names])
    others = [col(c) for c in df.columns if c != "place"]
    return df.select(F.element_at(labels, F.col("place") + 1).alias("column"), *others)


def long_numbers(df: DataFrame, names: list[str]) -> DataFrame:
    """``(place, value)`` rows with every value as a double."""
    return stacked(df, [present(df, n).cast("double") for n in names])


def value_frequencies(df: DataFrame, names: list[str]) -> DataFrame:
    """``(column, value, n)``: how often each value occurs in each column.

    Columns of one type are counted together in their own type; values become text
    only once they are counted. Each type's scan reads just its own columns.
    """
    groups: dict[str, list[str]] = {}
    for n in names:
        groups.setdefault(_kind(dtype_of(df, n)), []).append(n)
    frames = []
    for kind, members in groups.items():
        values = [present(df, n).cast(kind) for n in members]
        if kind == "double":
            values = [v + F.lit(0.0) for v in values]  # 0.0 and -0.0 are one value
        counts = stacked(df, values).groupBy("place", "value").agg(F.count(F.lit(1)).alias("n"))
        frames.append(named(counts.withColumn("value", F.col("value").cast("string")), members))
    return union_all(frames)

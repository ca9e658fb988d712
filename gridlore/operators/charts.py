"""The data behind each chart. Nothing is drawn."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridlore.functions.columns import (
    as_day, as_number, col, dtype_of, missing, numeric_columns, percent, present, require,
)
from gridlore.functions.positions import with_position
from gridlore.functions.quantiles import coarse_digit, exact_quantiles
from gridlore.operators.aggregates import aggregate_of
from gridlore.operators.filters import plottable, within_year
from gridlore.operators.profile import QUARTILES, fences, quantile_table
from gridlore.operators.ranking import fold_small_groups

__all__ = [
    "check_chart", "bar_data", "line_data", "scatter_data", "trend_line", "grouped_chart_data",
    "ranked_bar_data", "pie_data", "histogram", "box_stats", "box_outliers",
]


def check_chart(df: DataFrame, kind: str, x: str | None, y: str | None) -> None:
    """Refuse a chart that cannot be made: unknown column, values that are not numbers, no rows."""
    require(df, *[c for c in (x, y) if c])
    numbers = numeric_columns(df)
    values = {"bar": [y], "line": [y], "pie": [y], "box": [y], "scatter": [x, y], "histogram": [x]}
    for c in values.get(kind, []):
        if c and c not in numbers:
            raise ValueError(f"'{c}' is not numeric and cannot be the value axis of a {kind} chart.")
    both = [c for c in (x, y) if c]
    if both and df.filter(_both_present(df, both)).isEmpty():
        raise ValueError(f"No rows have values in {' and '.join(both)}: nothing to plot.")


def _both_present(df: DataFrame, names: list[str]) -> Column:
    ok = F.lit(True)
    for n in names:
        ok = ok & ~missing(df, n)
    return ok


def bar_data(df: DataFrame, x: str, y: str) -> DataFrame:
    """Text x: the sum of y per x. Numeric x: the pairs as they are."""
    require(df, x, y)
    if isinstance(dtype_of(df, x), T.NumericType):
        return df.filter(_both_present(df, [x, y])).select(col(x), col(y))
    rows = df.filter(~missing(df, x))
    return rows.groupBy(col(x)).agg(aggregate_of(df, y, "sum").alias(y))


def line_data(df: DataFrame, x: str, y: str, max_points: int = 5000) -> DataFrame:
    """Pairs in order of x, thinned to every (n // max_points)-th one when there are more.

    Positions come from the slices of a distributed sort, so no task sees all rows.
    """
    require(df, x, y)
    rows = df.filter(_both_present(df, [x, y])).select(col(x), col(y))
    placed = with_position(rows, [col(x), col(y)])
    n = rows.agg(F.count(F.lit(1)).alias("n")).scalar()
    step = F.greatest(F.lit(1), F.floor(n / max_points))
    return placed.filter((F.col("position") - 1) % step == 0)


def scatter_data(df: DataFrame, x: str, y: str, n: int = 5000, seed: int = 42) -> DataFrame:
    """A repeatable sample of n pairs: those with the smallest hash of row and seed."""
    require(df, x, y)
    pick = F.xxhash64(F.lit(seed), *[col(c) for c in df.columns])
    rows = df.select(
        as_number(df, x).alias("x"), as_number(df, y).alias("y"), pick.alias("_pick")
    ).dropna()
    return rows.orderBy("_pick", "x", "y").limit(n).drop("_pick")


def trend_line(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: least-squares slope and intercept over all pairs."""
    pairs = plottable(df, x, y)
    return pairs.agg(
        F.regr_slope(col(y), col(x)).alias("slope"), F.regr_intercept(col(y), col(x)).alias("intercept"),
        F.regr_r2(col(y), col(x)).alias("r2"), F.count(F.lit(1)).alias("n"),
    )


def _axis(df: DataFrame, x: str, grain: str | None) -> Column:
    if grain is None:
        return present(df, x)
    if grain == "year":
        return F.year(as_day(df, x)).cast("string")
    if grain == "month":
        return F.date_format(as_day(df, x), "yyyy-MM")
    raise ValueError("grain is None, 'month' or 'year'")


def _chart_rows(df: DataFrame, x: str, y: str, year: int | None) -> DataFrame:
    rows = df if year is None else df.filter(within_year(df, x, year))
    return rows.filter(~missing(df, x) & as_number(df, y).isNotNull())


def grouped_chart_data(
    df: DataFrame, x: str, y: str, group_by: str, agg: str = "sum", grain: str | None = None,
    year: int | None = None, max_categories: int = 12, max_series: int = 8,
) -> DataFrame:
    """x × group cells: the 12 largest categories (all, if chronological) and 8 largest series."""
    require(df, x, y, group_by)
    rows = _chart_rows(df, x, y, year)
    cells = rows.groupBy(
        _axis(df, x, grain).alias("x"), present(df, group_by).cast("string").alias("series")
    ).agg(aggregate_of(df, y, agg))
    chronological = grain is not None or isinstance(
        dtype_of(df, x), (T.TimestampNTZType, T.TimestampType, T.DateType)
    )
    kept = cells
    if not chronological:
        kept = _largest(kept, "x", max_categories)
    return _largest(kept, "series", max_series)


def _largest(cells: DataFrame, key: str, n: int) -> DataFrame:
    sums = cells.groupBy(key).agg(F.sum("value").alias("_s")).orderBy(F.desc("_s"), key).limit(n)
    same = cells[key].eqNullSafe(F.col("_k"))
    best = sums.select(F.col(key).alias("_k"))
    return cells.join(F.broadcast(best), same, "left_semi")  # at most n rows


def ranked_bar_data(
    df: DataFrame, x: str, y: str, n: int = 15, agg: str = "sum", year: int | None = None,
) -> DataFrame:
    """The n largest groups."""
    require(df, x, y)
    groups = _chart_rows(df, x, y, year).groupBy(present(df, x).alias("x")).agg(aggregate_of(df, y, agg))
    return groups.orderBy(F.desc("value"), "x").limit(n)


def axis_data(df: DataFrame, x: str, y: str, agg: str = "sum", grain: str | None = None,
              year: int | None = None) -> DataFrame:
    """One series along a (period) axis."""
    require(df, x, y)
    return _chart_rows(df, x, y, year).groupBy(_axis(df, x, grain).alias("x")).agg(aggregate_of(df, y, agg))


def pie_data(df: DataFrame, x: str, y: str, k: int = 8) -> DataFrame:
    """At most k slices of the positive group totals, the last one ``Other``, with shares."""
    require(df, x, y)
    groups = df.filter(~missing(df, x)).groupBy(col(x)).agg(aggregate_of(df, y, "sum"))
    positive = groups.filter((F.col("value") > 0) & (F.col("value") < float("inf")))
    slices = fold_small_groups(positive, x, "value", k - 1)
    whole = positive.agg(F.sum("value").alias("w")).scalar()
    return slices.withColumn("share", percent(F.col("value"), whole))


def histogram(df: DataFrame, name: str, bins: int | None = None) -> DataFrame:
    """Counts per equal-width bin, empty bins included; the last bin holds its upper edge.

    Without ``bins`` there are √n of them, between 10 and 40, or one per distinct
    value (at least two) when there are up to four.
    """
    require(df, name)
    v = as_number(df, name)
    values = df.select(v.alias("v")).filter(F.col("v").isNotNull() & (F.abs("v") != float("inf")))
    if bins is None:
        # Only up to four distinct values matter. Values in five or more different
        # coarse slices need no distinct count, and then no row reaches it.
        slices = coarse_digit(values.select(F.col("v").alias("value"))).select("slice").distinct()
        spread = slices.agg(F.count(F.lit(1)).alias("c")).scalar()
        close = values.filter(spread <= 4).distinct().agg(F.count(F.lit(1)).alias("d")).scalar()
        few = F.greatest(spread, close)
        wanted = F.when(few <= 4, F.greatest(F.lit(2), few.cast("int"))).otherwise(
            F.least(F.lit(40), F.greatest(F.lit(10), F.floor(F.sqrt(F.count(F.lit(1)))).cast("int")))
        )
    else:
        wanted = F.lit(bins)
    facts = values.agg(F.struct(
        F.min("v").alias("low"), F.max("v").alias("high"), wanted.cast("int").alias("bins"),
    ).alias("f")).filter("f.low is not null")
    flat = facts.select(
        F.when(F.col("f.low") == F.col("f.high"), F.col("f.low") - 0.5).otherwise(F.col("f.low")).alias("low"),
        F.when(F.col("f.low") == F.col("f.high"), F.col("f.high") + 0.5).otherwise(F.col("f.high")).alias("high"),
        F.col("f.bins").alias("bins"),
    )
    f = flat.select(F.struct("low", "high", "bins").alias("f")).scalar()
    width = (f["high"] - f["low"]) / f["bins"]
    bin_no = F.least(F.floor((F.col("v") - f["low"]) / width), f["bins"] - 1).cast("int")
    counts = values.groupBy(bin_no.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    edges = flat.select(
        F.explode(F.sequence(F.lit(0), F.col("bins") - 1)).alias("bin"), "low",
        ((F.col("high") - F.col("low")) / F.col("bins")).alias("w"),
    ).select(
        "bin", (F.col("low") + F.col("bin") * F.col("w")).alias("bin_low"),
        (F.col("low") + (F.col("bin") + 1) * F.col("w")).alias("bin_high"),
    )
    # both sides have a row per bin
    return edges.join(F.broadcast(counts), "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def histogram_markers(df: DataFrame, name: str) -> DataFrame:
    """One row: the mean and the median drawn into a histogram."""
    q = quantile_table(df, [name]).select(F.col("median")).scalar()
    return df.agg(F.avg(as_number(df, name)).alias("mean")).withColumn("median", q)


def _box_rows(df: DataFrame, y: str, by: str | None) -> DataFrame:
    key = F.lit(y) if by is None else present(df, by).cast("string")
    rows = df.select(key.alias("group"), as_number(df, y).alias("value"))
    return rows.filter(
        F.col("group").isNotNull() & F.col("value").isNotNull() & (F.abs("value") != float("inf"))
    )


def _with_fences(rows: DataFrame, by: str | None) -> DataFrame:
    q = fences(exact_quantiles(rows, ["group"], QUARTILES, small_keys=by is None), ["group"])
    return rows.join(q, "group").filter("n >= 2")


def box_stats(df: DataFrame, y: str, by: str | None = None) -> DataFrame:
    """Quartiles, whiskers (last values inside the fences) and outliers outside, per group."""
    require(df, y, *([by] if by else []))
    rows = _with_fences(_box_rows(df, y, by), by)
    v = F.col("value")
    return rows.groupBy("group").agg(
        F.first("n").alias("n"),
        *[F.first(c).alias(c) for c in QUARTILES],
        F.min(F.when(v >= F.col("low"), v)).alias("whisker_low"),
        F.max(F.when(v <= F.col("high"), v)).alias("whisker_high"),
        F.count_if((v < F.col("low")) | (v > F.col("high"))).alias("outliers"),
    )


def box_outliers(df: DataFrame, y: str, by: str | None = None, n: int = 200) -> DataFrame:
    """Up to n values outside the fences per group, smallest first: the points a box plot draws."""
    require(df, y, *([by] if by else []))
    rows = _with_fences(_box_rows(df, y, by), by)
    outside = rows.filter((F.col("value") < F.col("low")) | (F.col("value") > F.col("high")))
    # the rank limit is applied before the shuffle as well
    place = F.row_number().over(Window.partitionBy("group").orderBy("value"))
    return outside.withColumn("place", place).filter(F.col("place") <= n).select("group", "place", "value")


__all__ += ["axis_data", "histogram_markers"]

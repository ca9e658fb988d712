"""Column profiles, statistics, correlations and time profiles."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlore.functions.columns import (
    as_day, as_number, col, measure, missing, numeric_columns, percent, present, require,
    text_columns, time_columns,
)
from gridlore.functions.quantiles import approx_quantiles, exact_quantiles
from gridlore.functions.shapes import long_numbers, named, per_column, union_all, value_frequencies
from gridlore.operators.facts import group_facts, repeated_rows
from gridlore.operators.roles import Roles, roles_of, stats_date_columns

__all__ = [
    "value_counts", "category_modes", "categorical_summary", "quantile_table",
    "numeric_statistics", "outlier_profile", "profile", "column_profile", "top_values",
    "quick_stats", "dataset_summary", "duplicate_count", "date_profile", "correlation_matrix",
    "best_correlation", "relationship", "time_aggregation", "time_extremes", "extreme_examples",
    "group_shares", "overview", "fact_sheet",
]

QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}


# --- frequencies ------------------------------------------------------------

def value_counts(df: DataFrame, name: str, k: int | None = None) -> DataFrame:
    """How often each value occurs; the k most frequent ones if k is given."""
    require(df, name)
    counts = (
        df.filter(~missing(df, name))
        .groupBy(col(name).cast("string").alias("value"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return counts if k is None else counts.orderBy(F.desc("n"), "value").limit(k)


def top_values(df: DataFrame, names: list[str], k: int) -> DataFrame:
    """The k most frequent values of every column, with their place.

    The rank filter is also applied before the shuffle, so no task sees more than
    k rows per column and input partition.
    """
    order = Window.partitionBy("column").orderBy(F.desc("n"), "value")
    placed = value_frequencies(df, names).withColumn("place", F.row_number().over(order))
    return placed.filter(F.col("place") <= k)


def _frequency_facts(df: DataFrame, names: list[str]) -> DataFrame:
    """Per column with values: distinct values, filled rows, highest frequency, first mode."""
    return value_frequencies(df, names).groupBy("column").agg(
        F.count(F.lit(1)).alias("unique_values"),
        F.sum("n").alias("filled"),
        F.max("n").alias("top_frequency"),
        F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("top_value"),
    )


def category_modes(df: DataFrame, names: list[str]) -> DataFrame:
    """All most frequent values of every column, one row each."""
    freq = value_frequencies(df, names)
    best = freq.groupBy("column").agg(F.max("n").alias("frequency"))  # one row per column
    at_top = freq.join(F.broadcast(best), "column").filter(F.col("n") == F.col("frequency"))
    return at_top.select("column", "value", "frequency")


def categorical_summary(df: DataFrame, names: list[str], named_modes: int | None = 5) -> DataFrame:
    """Distinct values, the modes (so many named, all if None, with their number), frequency and share."""
    freq = value_frequencies(df, names)
    facts = freq.groupBy("column").agg(
        F.count(F.lit(1)).alias("unique_values"), F.sum("n").alias("filled"),
        F.max("n").alias("frequency"),
    )
    at_top = freq.join(F.broadcast(facts.select("column", "frequency")), "column").filter(
        F.col("n") == F.col("frequency")
    )
    place = F.row_number().over(Window.partitionBy("column").orderBy("value"))
    named = (
        (at_top if named_modes is None else at_top.withColumn("place", place).filter(F.col("place") <= named_modes))
        .groupBy("column").agg(F.sort_array(F.collect_list("value")).alias("named"))
    )
    modes = at_top.groupBy("column").agg(F.count(F.lit(1)).alias("n_modes"))
    text = F.concat(
        F.array_join("named", ", "), F.when(F.col("n_modes") > F.size("named"), "...").otherwise("")
    )
    return (
        facts.join(F.broadcast(modes), "column").join(F.broadcast(named), "column")
        .select(
            "column", "unique_values", text.alias("top"), "n_modes", "frequency",
            percent(F.col("frequency"), F.col("filled")).alias("share"),
        )
    )


# --- numbers ----------------------------------------------------------------

def quantile_table(df: DataFrame, names: list[str], approx: bool = False) -> DataFrame:
    """Quartiles per numeric column."""
    return named(_quartiles(long_numbers(df, names), approx), names)


def _quartiles(values: DataFrame, approx: bool = False) -> DataFrame:
    make = approx_quantiles if approx else exact_quantiles
    return make(values, ["place"], QUARTILES)


def _moments(df: DataFrame, names: list[str]) -> DataFrame:
    """Count, mean, spread, range and bias-corrected skewness per column, in one scan."""

    def facts(name: str) -> dict[str, Column]:
        v = present(df, name).cast("double")
        n = F.count(v)
        d = n.cast("double")
        skew = F.try_divide(F.skewness(v) * F.sqrt(d * (d - 1)), d - 2)
        return {
            "count": n, "mean": F.avg(v), "std": F.stddev_samp(v), "variance": F.var_samp(v),
            "min": F.min(v), "max": F.max(v),
            "skew": F.when((n >= 3) & (F.min(v) < F.max(v)), skew).when(n >= 3, F.lit(0.0)),
            "negatives": F.count_if(v < 0),
        }

    return per_column(df, names, facts)


def numeric_statistics(df: DataFrame, names: list[str] | None = None, approx: bool = False) -> DataFrame:
    """Count, mean, median, spread, quartiles, range, skewness and variation per column."""
    names = numeric_columns(df) if names is None else names
    q = quantile_table(df, names, approx).drop("n")
    joined = _moments(df, names).join(F.broadcast(q), "column", "left")  # one row per column
    cv = F.try_divide(F.col("std") * 100.0, F.col("mean"))
    return joined.select(
        "column", "count", "mean", "median", "std", "variance", "q1", "q3", "min", "max", "skew",
        cv.alias("cv"),
    )


def fences(q: DataFrame, ids: list[str]) -> DataFrame:
    """The 1.5 × IQR limits next to the quartiles."""
    iqr = F.col("q3") - F.col("q1")
    return q.select(
        *[col(i) for i in ids], "n", "q1", "median", "q3", iqr.alias("iqr"),
        (F.col("q1") - 1.5 * iqr).alias("low"), (F.col("q3") + 1.5 * iqr).alias("high"),
    )


def outlier_counts(df: DataFrame, names: list[str], approx: bool = False, finite: bool = False) -> DataFrame:
    """Quartiles, fences and the number of values outside (0 when the IQR is 0) per column."""
    values = long_numbers(df, names)
    if finite:
        values = values.filter(F.abs("value") != float("inf"))
    limits = fences(_quartiles(values, approx), ["place"])
    outside = (F.col("iqr") > 0) & ((F.col("value") < F.col("low")) | (F.col("value") > F.col("high")))
    # one row per column on the small side, here and below
    counted = (
        values.join(F.broadcast(limits), "place")
        .groupBy("place").agg(
            F.count_if(outside).alias("outliers"),
            *[F.max(c).alias(c) for c in ("n", "q1", "median", "q3", "iqr", "low", "high")],
        )
    )
    return named(counted, names)


def outlier_profile(df: DataFrame, names: list[str] | None = None, approx: bool = False) -> DataFrame:
    """Quartiles and the number of values outside the fences; not assessed below 4 values."""
    names = numeric_columns(df) if names is None else names
    counted = outlier_counts(df, names, approx)
    sized = per_column(df, names, lambda c: {"filled": F.count(present(df, c))})
    enough = F.col("filled") >= 4
    rows = sized.join(F.broadcast(counted), "column", "left")
    status = (
        F.when(~enough, "not assessed")
        .when(F.col("outliers") > 0, "potential outliers")
        .otherwise("no outliers")
    )
    return rows.select(
        "column", F.col("filled").alias("n"),
        *[F.when(enough, F.col(c)).alias(c) for c in ("q1", "q3", "iqr", "outliers")],
        status.alias("status"),
    )


# --- profiles ---------------------------------------------------------------

def _basic(df: DataFrame, names: list[str]) -> DataFrame:
    numbers = set(numeric_columns(df))

    def facts(name: str) -> dict[str, Column]:
        v = present(df, name).cast("double") if name in numbers else F.lit(None).cast("double")
        return {
            "rows": F.count(F.lit(1)), "missing": F.count_if(missing(df, name)),
            "min": F.min(v), "max": F.max(v), "mean": F.avg(v), "std": F.stddev_samp(v),
        }

    return per_column(df, names, facts)


def _joined_profile(df: DataFrame, names: list[str]) -> DataFrame:
    """Basic facts, distinct values and quartiles; every joined table has a row per column."""
    numbers = [n for n in names if n in numeric_columns(df)]
    rows = _basic(df, names).join(F.broadcast(_frequency_facts(df, names)), "column", "left")
    if numbers:
        rows = rows.join(F.broadcast(quantile_table(df, numbers).drop("n")), "column", "left")
    else:
        rows = rows.withColumns({q: F.lit(None).cast("double") for q in QUARTILES})
    return rows.withColumns({
        "unique_values": F.coalesce("unique_values", F.lit(0)),
        "kind": F.when(F.col("column").isin(numbers), "numeric").otherwise("other"),
    })


def profile(df: DataFrame, max_cols: int | None = None) -> DataFrame:
    """Missing and distinct counts per column, with range, mean and median of numbers.

    If ``max_cols`` is given, only so many columns are detailed; ``truncated_columns`` says how
    many were left out. The most frequent values are in ``top_values``.
    """
    names = df.columns[:max_cols]
    rows = _joined_profile(df, names)
    text = F.col("kind") == "other"
    empty = F.col("missing") == F.col("rows")
    return rows.select(
        "position", "column", "missing", "unique_values", "min", "max", "mean", "median",
        empty.alias("all_missing"),
        (text & ~empty & (F.col("unique_values") > 0.5 * F.col("rows"))).alias("is_identifier_like"),
        F.lit(len(df.columns) - len(names)).alias("truncated_columns"),
    )


def column_profile(df: DataFrame, roles: Roles | None = None) -> DataFrame:
    """The report's column description: detected type, missing share, spread and quartiles."""
    roles = roles or roles_of(df)
    kind = (
        F.when(F.col("column").isin(roles.dates), "Date/Time")
        .when(F.col("column").isin(roles.numeric), "Numeric")
        .otherwise("Categorical")
    )
    return _joined_profile(df, df.columns).select(
        "position", "column", kind.alias("detected_type"), "unique_values", "missing",
        percent(F.col("missing"), F.col("rows")).alias("missing_pct"),
        "min", "max", "mean", "median", "std", "q1", "q3",
    )


def quick_stats(df: DataFrame) -> DataFrame:
    """One row per column: range and mean, or distinct count and mode, or its date role."""
    rows = _basic(df, df.columns).join(
        F.broadcast(_frequency_facts(df, df.columns)), "column", "left"
    )
    dates = stats_date_columns(df).select("column", F.lit(True).alias("is_date"))
    rows = rows.join(F.broadcast(dates), "column", "left")
    numeric = F.col("column").isin(numeric_columns(df))
    kind = (
        F.when(numeric, "numeric").when(F.col("is_date"), "date").otherwise("categorical")
    )
    missing_pct = percent(F.col("missing"), F.col("rows"))
    return rows.withColumn("kind", kind).select(
        "position", "column", "kind", "min", "max", "mean",
        F.when(F.col("kind") == "categorical", F.coalesce("unique_values", F.lit(0))).alias("unique_values"),
        F.when(F.col("kind") == "categorical", F.col("top_value")).alias("top_value"),
        missing_pct.alias("missing_pct"), (missing_pct > 20).alias("high_missing"),
    )


def duplicate_count(df: DataFrame) -> DataFrame:
    """One row: how many rows repeat an earlier one."""
    return repeated_rows(df).agg(
        F.coalesce(F.sum(F.col("_copies") - 1), F.lit(0)).alias("duplicate_rows")
    )


def dataset_summary(df: DataFrame) -> DataFrame:
    """One row: rows, columns by type, missing cells and duplicate rows."""
    gaps = sum((F.when(missing(df, n), 1).otherwise(0) for n in df.columns), F.lit(0))
    facts = df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(gaps), F.lit(0)).alias("missing_cells"))
    return facts.select(
        "rows", F.lit(len(df.columns)).alias("columns"),
        F.lit(len(numeric_columns(df))).alias("numeric_columns"),
        F.lit(len(text_columns(df))).alias("categorical_columns"),
        F.lit(len(time_columns(df))).alias("datetime_columns"),
        "missing_cells", duplicate_count(df).scalar().alias("duplicate_rows"),
    )


def date_profile(df: DataFrame, names: list[str]) -> DataFrame:
    """Valid values, first and last day, different days and span in days per column."""
    require(df, *names)
    frames = []
    for n in names:
        day = as_day(df, n)
        # counted per day first, so each column shuffles one row per day and task
        days = df.groupBy(day.alias("day")).agg(F.count(F.lit(1)).alias("n")).filter("day is not null")
        frames.append(days.agg(
            F.lit(n).alias("column"),
            F.coalesce(F.sum("n"), F.lit(0)).alias("valid"),
            F.min("day").alias("earliest"), F.max("day").alias("latest"),
            F.count(F.lit(1)).alias("unique_days"),
            (F.datediff(F.max("day"), F.min("day")) + 1).alias("span_days"),
        ))
    return union_all(frames)


# --- relations --------------------------------------------------------------

PAIRS_PER_SCAN = 150


def _pairwise(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Pearson correlation and usable rows per pair of columns, many pairs in one scan."""
    frames = []
    for start in range(0, len(pairs), PAIRS_PER_SCAN):
        packed = []
        for a, b in pairs[start : start + PAIRS_PER_SCAN]:
            x, y = as_number(df, a), as_number(df, b)
            both = x.isNotNull() & y.isNotNull()
            r = F.corr(F.when(both, x), F.when(both, y))
            packed.append(F.struct(
                F.lit(a).alias("a"), F.lit(b).alias("b"),
                F.when(~F.isnan(r), r).alias("r"), F.count_if(both).alias("n"),
            ))
        one = df.agg(*[p.alias(f"p{i}") for i, p in enumerate(packed)])
        frames.append(one.select(F.inline(F.array(*[F.col(f"p{i}") for i in range(len(packed))]))))
    return union_all(frames)


def correlation_matrix(df: DataFrame, names: list[str]) -> DataFrame:
    """All pairwise correlations of the measures, long form, both halves and the diagonal."""
    require(df, *names)
    pairs = list(combinations(names, 2)) + [(n, n) for n in names]
    upper = _pairwise(df, pairs).select("a", "b", "r")
    mirrored = upper.select(
        F.explode(F.when(F.col("a") == F.col("b"), F.array(F.struct("a", "b"))).otherwise(
            F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
        )).alias("p"),
        "r",
    )
    return mirrored.select("p.a", "p.b", "r")


def best_correlation(df: DataFrame, names: list[str]) -> DataFrame:
    """The pair with the strongest absolute correlation; ties go to the earlier pair."""
    require(df, *names)
    pairs = list(combinations(names, 2))
    order = {f"{a}\x00{b}": i for i, (a, b) in enumerate(pairs)}
    place = F.create_map(*[x for k, i in order.items() for x in (F.lit(k), F.lit(i))])
    rows = _pairwise(df, pairs).filter(F.col("r").isNotNull())
    key = F.concat("a", F.lit("\x00"), "b")
    return rows.orderBy(F.abs("r").desc(), place[key]).limit(1)


def relationship(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: correlation of a pair in words; none below three usable rows."""
    require(df, a, b)
    return strength_of(_pairwise(df, [(a, b)]))


def strength_of(pairs: DataFrame) -> DataFrame:
    """The same from (a, b, r, n)."""
    size = F.abs("r")
    label = (
        F.when(F.col("r").isNull() | (F.col("n") < 3), None)
        .when(size < 0.1, "none").when(size < 0.4, "weak").when(size < 0.7, "moderate")
        .when(size < 0.8, "strong").otherwise("very strong")
    )
    direction = F.when(F.col("r") > 0, "positive").when(F.col("r") < 0, "negative").otherwise("near-zero")
    return pairs.select(
        "a", "b", "n", F.when(F.col("n") >= 3, F.col("r")).alias("r"), label.alias("strength"),
        F.when(label.isNotNull(), direction).alias("direction"),
        (F.col("n") < 30).alias("exploratory"),
    )


def group_shares(df: DataFrame, keys: list[str], m: str, n: int | None = None) -> DataFrame:
    """For each category: its groups, or the n largest by total, with their share. All keys are grouped in one scan."""
    require(df, m, *keys)
    return shares_of_groups(group_facts(df, keys, m), n)


def shares_of_groups(groups: DataFrame, n: int | None = None) -> DataFrame:
    """The same from (dimension, category, total, average, count)."""
    # a row per key
    facts = groups.groupBy("dimension").agg(F.count(F.lit(1)).alias("_groups"), F.sum("total").alias("_whole")).filter("_groups >= 2")
    if n is not None:
        # the limit is applied before the shuffle as well
        place = F.row_number().over(Window.partitionBy("dimension").orderBy(F.desc("total"), "category"))
        groups = groups.withColumn("_place", place).filter(F.col("_place") <= n)
    return groups.join(F.broadcast(facts), "dimension").select(
        "dimension", "category", F.col("count").alias("records"), "total", "average",
        percent(F.col("total"), F.nullif(F.col("_whole"), F.lit(0.0))).alias("share"),
    )


# --- time -------------------------------------------------------------------

def _periods(df: DataFrame, ts: str, m: str | None, grain: str | None = None) -> DataFrame:
    """Total, days and last day per day, week or month, whichever suits the observed span.

    Rows are summed per day first; the span and the periods are read from those days.
    """
    v = measure(df, m).cast("double") if m else F.lit(1.0)
    days = (
        df.select(as_day(df, ts).alias("day"), v.alias("v")).filter(F.col("day").isNotNull())
        .groupBy("day").agg(F.sum("v").alias("value"))
    )
    return periods_of_days(days, grain)


def periods_of_days(days: DataFrame, grain: str | None = None) -> DataFrame:
    """The same from (day, value). grain: day, week or month, where the span isn't to decide."""
    if grain not in (None, "day", "week", "month"):
        raise ValueError(f"Unknown grain {grain!r}; use day, week or month")
    # counting the values keeps this aggregate on the very same daily sums
    facts = days.agg(F.struct(
        (F.datediff(F.max("day"), F.min("day")) + 1).alias("span"), F.count("value").alias("filled"),
    ).alias("f")).scalar()
    unit = F.lit(grain) if grain else (
        F.when(facts["filled"] < 0, None).when(facts["span"] <= 31, "day")
        .when(facts["span"] <= 180, "week").otherwise("month")
    )
    period = (
        F.when(unit == "day", F.col("day"))
        .when(unit == "week", F.trunc("day", "week"))
        .otherwise(F.trunc("day", "month"))
    )
    return days.groupBy(period.alias("period"), unit.alias("grain")).agg(
        F.sum("value").alias("value"), F.count(F.lit(1)).alias("days"), F.max("day").alias("last_day"),
    )


def time_aggregation(df: DataFrame, ts: str, m: str | None = None, grain: str | None = None) -> DataFrame:
    """Totals per day, week or month, whichever suits the observed span if no grain is given.

    Up to 31 days gives days, up to 180 weeks (Monday), else months. Periods whose
    values are all missing are left out. Without a measure rows are counted.
    """
    require(df, ts, *([m] if m else []))
    return _periods(df, ts, m, grain).filter(F.col("value").isNotNull()).select("period", "grain", "value")


def time_extremes(df: DataFrame, ts: str, m: str | None = None, grain: str | None = None) -> DataFrame:
    """One row: highest and lowest period; a partly covered final one is flagged and left out."""
    require(df, ts, *([m] if m else []))
    return extremes_of_periods(_periods(df, ts, m, grain))


def extremes_of_periods(periods: DataFrame) -> DataFrame:
    whole = Window.partitionBy("grain")  # one row per calendar period
    filled = F.col("value").isNotNull()
    rows = periods.withColumn("start", F.max(F.when(filled, F.col("period"))).over(whole))
    tail = F.col("period") >= F.col("start")
    rows = rows.withColumns({
        "size": F.count("value").over(whole), "until": F.max("last_day").over(whole),
        "tail_days": F.sum(F.when(tail, F.col("days"))).over(whole),
    }).filter(filled)
    end = F.when(F.col("grain") == "month", F.last_day("start")).otherwise(F.date_add("start", 6))
    covered = (F.datediff("until", "start") + 1) / (F.datediff(end, F.col("start")) + 1)
    partial = (
        F.col("grain").isin("month", "week") & (F.col("tail_days") >= 3) & (covered < 0.9)
        & (F.col("size") >= 2)
    )
    rows = rows.withColumn("partial", partial)
    used = rows.filter(~(F.col("partial") & (F.col("size") > 2) & (F.col("period") == F.col("start"))))
    return used.agg(
        F.max("grain").alias("grain"),
        F.min_by("period", F.struct(-F.col("value"), F.col("period"))).alias("highest_period"),
        F.max("value").alias("highest"),
        F.min_by("period", F.struct("value", "period")).alias("lowest_period"),
        F.min("value").alias("lowest"),
        F.max(F.when(F.col("partial"), F.col("until"))).alias("partial_until"),
    )


def extreme_examples(df: DataFrame, m: str, roles: Roles | None = None, examples: int = 2, categories: int = 2) -> DataFrame:
    """How many rows hold the maximum and the minimum, with that many example rows each, shown by their first date and
    as many categories.

    Each task keeps the first rows of its own maximum and minimum, so the source is read twice: once for the ends,
    once for the rows that hold them.
    """
    roles = roles or roles_of(df)
    require(df, m)
    context = roles.dates[:1] + roles.categorical[:categories]
    v = measure(df, m).cast("double")
    ends = df.agg(F.struct(F.max(v).alias("high"), F.min(v).alias("low")).alias("e")).scalar()
    kinds = F.array_compact(F.array(F.when(v == ends["high"], "maximum"), F.when(v == ends["low"], "minimum")))
    parts = [
        F.when(col(c).isNotNull(), F.concat(F.lit(f"{c}="), _shown(df, c, c in roles.dates)))
        for c in context
    ]
    hits = df.filter((v == ends["high"]) | (v == ends["low"])).select(
        F.explode(kinds).alias("kind"), v.alias("value"), F.concat_ws(", ", *parts).alias("example"),
        *[col(c).alias(f"_c{i}") for i, c in enumerate(context)])
    # counted per shown row first: a value that a third of all rows hold is few rows to rank
    shown = hits.groupBy("kind", "value", "example", *[f"_c{i}" for i in range(len(context))]).agg(F.count(F.lit(1)).alias("_n"))
    records = shown.groupBy("kind").agg(F.sum("_n").alias("records"))
    order = [F.col(f"_c{i}").asc_nulls_last() for i in range(len(context))]
    first = shown.withColumn("_place", F.row_number().over(Window.partitionBy("kind").orderBy(*(order or ["value"])))).filter(F.col("_place") <= examples)
    # a row that occurs more often fills the places after its own
    earlier = Window.partitionBy("kind").orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
    room = F.lit(examples) - F.coalesce(F.sum("_n").over(earlier), F.lit(0))
    filled = first.withColumn("_room", F.least(room, F.col("_n"))).filter("_room > 0")
    listed = filled.select("kind", "value", "example", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_room"))).alias("_k"))
    return listed.join(F.broadcast(records), "kind").select("kind", "value", "records", "example")


def _shown(df: DataFrame, name: str, is_date: bool) -> Column:
    return as_day(df, name).cast("string") if is_date else col(name).cast("string")


# --- overviews --------------------------------------------------------------

def _fact(kind: str, subject: Column, metric: str, value: Column, text: Column | None = None) -> list[Column]:
    return [
        F.lit(kind).alias("section"), subject.alias("subject"), F.lit(metric).alias("metric"),
        value.cast("double").alias("value"), (text if text is not None else F.lit(None)).cast("string").alias("text"),
    ]


def _melt(df: DataFrame, kind: str, metrics: list[str]) -> DataFrame:
    rows = [
        F.struct(*_fact(kind, F.col("column"), m, F.col(m))) for m in metrics
    ]
    return df.select(F.inline(F.array(*rows)))


def overview(df: DataFrame) -> DataFrame:
    """Long rows: size, ranges and sums of numbers, date ranges, distinct and top values, gaps."""
    numbers, texts, dates = numeric_columns(df), text_columns(df), time_columns(df)
    summary = dataset_summary(df).withColumn("column", F.lit(None).cast("string"))
    frames = [_melt(summary, "dataset", ["rows", "missing_cells", "duplicate_rows"])]
    if numbers:
        sums = per_column(df, numbers, lambda n: {
            "min": F.min(present(df, n)).cast("double"), "max": F.max(present(df, n)).cast("double"),
            "mean": F.avg(present(df, n)),
            "sum": F.coalesce(F.sum(present(df, n)).cast("double"), F.lit(0.0)),
        })
        frames.append(_melt(sums, "numeric", ["min", "max", "mean", "sum"]))
    if dates:
        ranges = date_profile(df, dates)
        for metric in ("earliest", "latest"):
            frames.append(ranges.select(*_fact("date", F.col("column"), metric, F.lit(None), F.col(metric))))
    if texts:
        distinct = _frequency_facts(df, texts)
        frames.append(distinct.select(*_fact("text", F.col("column"), "distinct", F.col("unique_values"))))
        frames.append(top_values(df, texts, 10).select(
            *_fact("top_value", F.col("column"), "count", F.col("n"), F.col("value"))
        ))
    return union_all(frames)


def shape_word(skew: Column) -> Column:
    return (
        F.when(F.abs(skew) < 0.5, "roughly symmetric")
        .when(skew > 0, "right-skewed").otherwise("left-skewed")
    )


def fact_sheet(df: DataFrame, roles: Roles | None = None, measures: int | None = None, categories: int | None = None,
               most_values: int = 30) -> DataFrame:
    """Verified facts per column.

    Measures with quartiles, shape, outliers and negatives; categories of 2 to ``most_values`` values with their top
    share; the range of typed dates. All of them, or the first so many.
    """
    roles = roles or roles_of(df)
    frames = []
    numbers = roles.measures[:measures]
    if numbers:
        counted = outlier_counts(df, numbers)
        rows = _moments(df, numbers).join(
            F.broadcast(counted.select("column", "q1", "median", "q3", "outliers")), "column"
        ).filter(F.col("count") >= 4)
        frames.append(rows.select(
            F.lit("numeric").alias("section"), "column", "min", "q1", "median", "q3", "max",
            "mean", "std", "skew", shape_word(F.col("skew")).alias("shape"), "outliers",
            percent(F.col("outliers"), F.col("count")).alias("share"), "negatives",
        ))
    texts = [n for n in df.columns if n not in numeric_columns(df) and n not in time_columns(df)]
    if texts:
        position = {n: i for i, n in enumerate(df.columns)}
        place = F.create_map(*[x for n in texts for x in (F.lit(n), F.lit(position[n]))])
        small = _frequency_facts(df, texts).filter(F.col("unique_values").between(2, most_values))
        first = small if categories is None else small.orderBy(place[F.col("column")]).limit(categories)
        frames.append(first.select(
            F.lit("category").alias("section"), "column",
            F.col("unique_values").cast("double").alias("max"),
            F.col("top_value").alias("shape"),
            percent(F.col("top_frequency"), F.col("filled")).alias("share"),
        ))
    dates = time_columns(df)
    if dates:
        frames.append(date_profile(df, dates).filter("valid > 0").select(
            F.lit("date").alias("section"), "column",
            F.concat(F.col("earliest").cast("string"), F.lit(" to "), F.col("latest").cast("string")).alias("shape"),
        ))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out

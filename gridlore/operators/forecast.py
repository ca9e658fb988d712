"""Backtested forecasts for one or many series in one job.

Raw rows are summed per series and timestamp on the cluster; from there on a series
has one row per calendar period, and every model is a closed-form aggregate or a
window over those periods.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlore.functions.columns import as_number, as_ts, col, require

__all__ = ["resample", "trim_partial_period", "backtest_scores", "forecast"]

MIN_POINTS = 8
HISTORY_TAIL = 24
BAND_WIDTH = 1.96


@dataclass(frozen=True)
class Grain:
    """A calendar period: its running number, its label, its last day and its season length."""

    season: int | None
    number: object
    label: object
    last_day: object
    can_be_partial: bool


def _months(d: Column) -> Column:
    return (F.year(d) * 12 + F.month(d) - 1).cast("long")


def _month_start(n: Column) -> Column:
    return F.make_date(F.floor(n / 12).cast("int"), (n % 12 + 1).cast("int"), F.lit(1))


_EPOCH_MONDAY = "1969-12-29"

GRAINS = {
    "D": Grain(7, lambda d: F.unix_date(d).cast("long"), lambda n: F.date_from_unix_date(n.cast("int")),
               lambda n: F.date_from_unix_date(n.cast("int")), False),
    # weeks run Monday to Sunday and are labelled by their Sunday
    "W": Grain(52, lambda d: F.floor(F.datediff(d, F.lit(_EPOCH_MONDAY).cast("date")) / 7).cast("long"),
               lambda n: F.date_add(F.lit(_EPOCH_MONDAY).cast("date"), (n * 7 + 6).cast("int")),
               lambda n: F.date_add(F.lit(_EPOCH_MONDAY).cast("date"), (n * 7 + 6).cast("int")), False),
    "MS": Grain(12, _months, _month_start, lambda n: F.last_day(_month_start(n)), True),
    "QE": Grain(4, lambda d: F.floor(_months(d) / 3).cast("long"),
                lambda n: F.last_day(_month_start(n * 3 + 2)), lambda n: F.last_day(_month_start(n * 3 + 2)), True),
    "Y": Grain(None, lambda d: F.year(d).cast("long"),
               lambda n: F.make_date(n.cast("int"), F.lit(12), F.lit(31)),
               lambda n: F.make_date(n.cast("int"), F.lit(12), F.lit(31)), True),
}


def _grain(freq: str) -> Grain:
    if freq not in GRAINS:
        raise ValueError(f"freq is one of {', '.join(GRAINS)}")
    return GRAINS[freq]


def _points(df: DataFrame, ts: str, m: str, freq: str, groups: list[str]) -> DataFrame:
    """Sum per series and timestamp, with the number of the period it falls in."""
    require(df, ts, m, *groups)
    clean = df.select(
        *[col(g) for g in groups], as_ts(df, ts).alias("_ts"), as_number(df, m).alias("_v")
    ).filter(F.col("_ts").isNotNull() & F.col("_v").isNotNull())
    summed = clean.groupBy(*[col(g) for g in groups], "_ts").agg(F.sum("_v").alias("_v"))
    return summed.withColumn("_p", _grain(freq).number(F.col("_ts").cast("date")))


def _periods(points: DataFrame, groups: list[str]) -> DataFrame:
    """Per series and period: total, different timestamps and last timestamp."""
    return points.groupBy(*[col(g) for g in groups], "_p").agg(
        F.sum("_v").alias("_v"), F.count(F.lit(1)).alias("_n"), F.max("_ts").alias("_last"),
    )


def _by(groups: list[str]):
    return Window.partitionBy(*[col(g) for g in groups])


def _marked(periods: DataFrame, freq: str, groups: list[str]) -> DataFrame:
    """Flag the latest period of a series when it is only partly observed.

    Partial means several timestamps in it and the last of them before its last day.
    The only period of a series is never set aside: the series is too short anyway.
    """
    grain = _grain(freq)
    w = _by(groups)
    rows = periods.withColumns({
        "_points": F.sum("_n").over(w), "_until": F.max("_last").over(w), "_latest": F.max("_p").over(w),
        "_first": F.min("_p").over(w),
    })
    if not grain.can_be_partial:
        return rows.withColumn("_partial", F.lit(False))
    partial = (
        (F.col("_p") == F.col("_latest")) & (F.col("_p") > F.col("_first")) & (F.col("_n") > 1)
        & (F.col("_last").cast("date") < grain.last_day(F.col("_p")))
    )
    return rows.withColumn("_partial", partial)


def _filled(marked: DataFrame, groups: list[str]) -> DataFrame:
    """Complete periods only, gaps filled with 0, each with facts about its series.

    A gap is filled by the row before it, which repeats itself with value 0 for every
    missing period up to the next one: no calendar join is needed.
    """
    w = _by(groups)
    facts = marked.withColumn("_dropped", F.max(F.when(F.col("_partial"), F.col("_p"))).over(w))
    kept = facts.filter(~F.col("_partial"))
    after = F.lead("_p").over(w.orderBy("_p"))
    spread = kept.withColumn("_to", F.coalesce(after - 1, F.col("_p")))
    steps = spread.withColumn("_q", F.explode(F.sequence("_p", "_to")))
    value = F.when(F.col("_q") == F.col("_p"), F.col("_v")).otherwise(F.lit(0.0))
    return steps.select(
        *[col(g) for g in groups], F.col("_q").alias("_p"), value.alias("_v"),
        "_points", "_until", "_dropped",
    )


def _series(df: DataFrame, ts: str, m: str, freq: str, groups: list[str]) -> DataFrame:
    filled = _filled(_marked(_periods(_points(df, ts, m, freq, groups), groups), freq, groups), groups)
    w = _by(groups)
    return filled.withColumns({
        "_i": F.row_number().over(w.orderBy("_p")) - 1,
        "_len": F.count(F.lit(1)).over(w),
    })


def resample(df: DataFrame, ts: str, m: str, freq: str = "MS", group_cols: tuple[str, ...] = ()) -> DataFrame:
    """Total per period, with 0 for periods without rows.

    Labels: the day; the Sunday of a week; the first of a month; the last day of a
    quarter or year.
    """
    groups = list(group_cols)
    periods = _periods(_points(df, ts, m, freq, groups), groups)
    filled = _filled(
        periods.withColumns({
            "_points": F.lit(0), "_until": F.col("_last"), "_partial": F.lit(False),
        }), groups,
    )
    return filled.select(
        *[col(g) for g in groups], _grain(freq).label(F.col("_p")).alias("period"), F.col("_v").alias("value")
    )


def trim_partial_period(
    df: DataFrame, ts: str, m: str, freq: str = "MS", group_cols: tuple[str, ...] = ()
) -> DataFrame:
    """``resample`` without a partly observed latest period, which is named in ``excluded_period``."""
    groups, label = list(group_cols), _grain(freq).label
    rows = _series(df, ts, m, freq, groups)
    return rows.select(
        *[col(g) for g in groups], label(F.col("_p")).alias("period"), F.col("_v").alias("value"),
        label(F.col("_dropped")).alias("excluded_period"),
    )


def _line(y: Column, x: Column, at: Column, over) -> Column:
    """Least squares over a window, evaluated at ``at``."""
    slope = F.regr_slope(y, x).over(over)
    return F.regr_intercept(y, x).over(over) + slope * at


def _backtest_errors(series: DataFrame, freq: str, groups: list[str]) -> DataFrame:
    """One row per series, model and held-out period with prediction and error."""
    season = _grain(freq).season
    w = _by(groups)
    n, i, y = F.col("_len"), F.col("_i"), F.col("_v")
    hold = F.greatest(
        F.lit(1), F.least(F.greatest(F.lit(3), F.floor(n / 5)), F.floor(n / 2))
    )
    rows = series.withColumn("_train", n - hold)
    train_y = F.when(i < F.col("_train"), y)
    x = i.cast("double")
    models = {
        "naive": F.max(F.when(i == F.col("_train") - 1, y)).over(w),
        "linear_trend": _line(train_y, F.when(i < F.col("_train"), x), x, w),
    }
    if season:
        phase = F.pmod(i - F.col("_train"), F.lit(season))
        rows = rows.withColumn("_phase", phase)
        last_in_phase = F.max_by(train_y, F.when(i < F.col("_train"), i)).over(
            Window.partitionBy(*[col(g) for g in groups], "_phase")
        )
        models["seasonal_naive"] = F.when(F.col("_train") >= 2 * season, last_in_phase)
    rows = rows.withColumns({f"_m_{name}": c for name, c in models.items()})
    packed = [
        F.struct(F.lit(k).alias("order"), F.lit(name).alias("method"), F.col(f"_m_{name}").alias("predicted"))
        for k, name in enumerate(models)
    ]
    tested = rows.filter((i >= F.col("_train")) & (F.col("_train") >= 3) & (n >= MIN_POINTS)
                         & (F.col("_points") >= MIN_POINTS))
    return tested.select(
        *[col(g) for g in groups], "_v", F.inline(F.array(*packed))
    ).filter(F.col("predicted").isNotNull())


def _scores(series: DataFrame, freq: str, groups: list[str]) -> DataFrame:
    error = F.abs(F.col("_v") - F.col("predicted"))
    relative = F.when(F.abs("_v") > 1e-9, error / F.abs("_v"))
    return _backtest_errors(series, freq, groups).groupBy(*[col(g) for g in groups], "order", "method").agg(
        F.avg(error).alias("mae"), F.sqrt(F.avg(error * error)).alias("rmse"),
        (F.avg(relative) * 100).alias("mape"),
    )


def backtest_scores(
    df: DataFrame, ts: str, m: str, freq: str = "MS", group_cols: tuple[str, ...] = ()
) -> DataFrame:
    """Error of each model on the held-out end of each series; ``best`` marks the smallest MAE."""
    groups = list(group_cols)
    scores = _scores(_series(df, ts, m, freq, groups), freq, groups)
    first = F.min(F.struct("mae", "order")).over(_by(groups))
    return scores.withColumn("best", F.struct("mae", "order") == first).drop("order")


def _facts(series: DataFrame, groups: list[str]) -> DataFrame:
    """One row per series with everything the models need apart from the last season."""
    step = F.col("_v") - F.lag("_v").over(_by(groups).orderBy("_p"))
    x = F.col("_i").cast("double")
    return series.withColumn("_step", step).groupBy(*[col(g) for g in groups]).agg(
        F.max("_len").alias("_len"), F.max("_points").alias("_points"), F.max("_until").alias("_until"),
        F.max("_dropped").alias("_dropped"), F.max("_p").alias("_end"),
        F.max_by("_v", "_p").alias("_final"),
        F.regr_slope(F.col("_v"), x).alias("_slope"), F.regr_intercept(F.col("_v"), x).alias("_base"),
        F.stddev_pop("_step").alias("_wobble"),
    )


def _join(left: DataFrame, right: DataFrame, groups: list[str], on: list[tuple[str, str]] = (), how="inner"):
    """Join on the series key, where a missing key is a series of its own."""
    renamed = right.select(*[col(g).alias(f"_k{i}") for i, g in enumerate(groups)],
                           *[col(c) for c in right.columns if c not in groups])
    cond = [col(g).eqNullSafe(F.col(f"_k{i}")) for i, g in enumerate(groups)]
    cond += [F.col(a) == F.col(b) for a, b in on]
    return left.join(renamed, cond, how).drop(*[f"_k{i}" for i in range(len(groups))])


def forecast(
    df: DataFrame, ts: str, m: str, freq: str = "MS", horizon: int = 1,
    target_year: int | None = None, group_cols: tuple[str, ...] = (),
) -> DataFrame:
    """History tail and forecast of every series, in one long table.

    The model with the smallest backtest MAE is used; the band is 1.96 times the
    larger of that error and the spread of period-to-period changes. With
    ``target_year`` (monthly) only that year's periods are returned. A series that
    cannot be forecast has one row whose ``status`` says why.
    """
    groups = list(group_cols)
    if target_year is not None:
        freq = "MS"
    grain = _grain(freq)
    keys = [col(g) for g in groups]
    series = _series(df, ts, m, freq, groups)
    # a value that is the same in all rows of a series joins a single one like many
    if not groups:
        series = series.withColumn("_all", F.col("_points"))
        groups_in, keys_in = ["_all"], [F.col("_all")]
    else:
        groups_in, keys_in = groups, keys

    facts = _facts(series, groups_in)
    scores = _scores(series, freq, groups_in)
    best = scores.groupBy(*keys_in).agg(
        F.min_by(F.struct("method", "mae", "rmse", "mape"), F.struct("mae", "order")).alias("_best")
    )
    until = F.col("_until").cast("date")
    anchor = F.when(F.col("_dropped").isNotNull(), grain.number(until)).otherwise(F.col("_end"))
    if target_year is None:
        steps, covered = F.lit(horizon), F.lit(horizon <= 0)
    else:
        same_year = F.year(until) == target_year
        remaining = F.when(
            same_year & F.col("_dropped").isNotNull(), F.lit(12) - F.month(until)
        ).when(
            F.floor(F.col("_end") / 12) < target_year,
            F.greatest(F.lit(1).cast("long"), F.lit(target_year * 12 + 11) - F.col("_end")),
        ).otherwise(F.lit(0))
        steps = remaining
        covered = (F.year(until) > target_year) | (remaining <= 0)
    status = (
        F.when(F.col("_points") < MIN_POINTS, "too few time points")
        .when(covered, "already covered")
        .when(F.col("_len") < MIN_POINTS, "too few periods")
        .otherwise("ok")
    )
    band = BAND_WIDTH * F.greatest(
        F.col("_best.mae"), F.when(F.col("_len") > 2, F.col("_wobble")).otherwise(F.lit(0.0))
    )
    models = _join(facts, best, groups_in, how="left").withColumns({
        "_anchor": anchor, "_steps": steps.cast("long"), "status": status, "_band": band,
    })

    ready = models.filter("status = 'ok'").withColumn(
        "_f", F.explode(F.sequence(F.col("_anchor") + 1, F.col("_anchor") + F.col("_steps")))
    )
    ahead = F.col("_f") - F.col("_end")  # steps after the last modelled period
    ready = ready.withColumn("_ahead", ahead)
    if grain.season:
        source = F.col("_len") - grain.season + F.pmod(F.col("_ahead") - 1, F.lit(grain.season))
        last_season = series.filter(F.col("_i") >= F.col("_len") - grain.season).select(
            *keys_in, F.col("_i").cast("long").alias("_src_i"), F.col("_v").alias("_seasonal")
        )
        ready = _join(ready.withColumn("_src", source.cast("long")), last_season, groups_in,
                      [("_src", "_src_i")], "left")
    else:
        ready = ready.withColumn("_seasonal", F.lit(None).cast("double"))
    method = F.col("_best.method")
    value = (
        F.when(method == "naive", F.col("_final"))
        .when(method == "seasonal_naive", F.col("_seasonal"))
        .otherwise(F.col("_base") + F.col("_slope") * (F.col("_len") - 1 + F.col("_ahead")))
    )
    label = grain.label

    def shaped(rows: DataFrame, kind: str, period: Column, v: Column, width: Column | None) -> DataFrame:
        low = v - width if width is not None else F.lit(None)
        high = v + width if width is not None else F.lit(None)
        return rows.select(
            *keys, F.lit(kind).alias("kind"), period.alias("period"), v.cast("double").alias("value"),
            low.cast("double").alias("lower"), high.cast("double").alias("upper"),
            F.col("_best.method").alias("method"), F.col("_best.mae").alias("mae"),
            F.col("_best.rmse").alias("rmse"), F.col("_best.mape").alias("mape"),
            label(F.col("_dropped")).alias("excluded_period"), F.col("status"),
        )

    future = shaped(ready.withColumn("_y", value), "forecast", label(F.col("_f")), F.col("_y"), F.col("_band"))
    if target_year is not None:
        future = future.filter(F.year("period") == target_year)
    tail = series.filter(F.col("_i") >= F.col("_len") - HISTORY_TAIL).select(
        *keys_in, F.col("_p").alias("_hp"), F.col("_v").alias("_hv")
    )
    history = shaped(
        _join(tail, models.filter("status = 'ok'"), groups_in), "history",
        label(F.col("_hp")), F.col("_hv"), None,
    )
    refused = shaped(
        models.filter("status <> 'ok'"), "refused", F.lit(None).cast("date"), F.lit(None), None
    )
    return history.unionByName(future).unionByName(refused)

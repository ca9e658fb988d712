"""Compositions: insights, recommendations and the tables of a full report."""

from __future__ import annotations

from functools import cached_property
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlore.functions.columns import col, percent
from gridlore.functions.shapes import union_all
from gridlore.operators.charts import histogram
from gridlore.operators.facts import TableFacts, day_facts, group_facts, kept, stored
from gridlore.operators.profile import (
    QUARTILES, _pairwise, extreme_examples, extremes_of_periods, periods_of_days, shape_word, shares_of_groups, strength_of, top_values,
)
from gridlore.operators.quality import dq_issues, quality_actions, quality_findings, quality_score
from gridlore.operators.roles import Roles, roles_of
from gridlore.sources.files import write_table

__all__ = ["insights", "recommendations", "executive_summary", "report_tables", "write_report", "ReportFacts"]


def _row(kind: str, subject: Column, **metrics: Column) -> list[Column]:
    entries = [x for k, v in metrics.items() for x in (F.lit(k), v.cast("string"))]
    return [F.lit(kind).alias("kind"), subject.alias("subject"), F.create_map(*entries).alias("metrics")]


def _num(c: Column, digits: int = 2) -> Column:
    return F.format_string(f"%.{digits}f", c)


class ReportFacts(TableFacts):
    """The facts of a table and, for its roles, what a report says about groups, days, pairs and extreme rows."""

    def __init__(self, df: DataFrame, roles: Roles | None = None):
        super().__init__(df)
        self.roles = roles or roles_of(df)

    @cached_property
    def groups(self) -> DataFrame:
        """(dimension, category, total, average, count) of the primary measure by all categories: one scan."""
        return kept(group_facts(self.df, self.roles.categorical, self.roles.primary))

    @cached_property
    def ends(self) -> DataFrame:
        """Per category with at least two groups: the first and the last by total."""
        highest, lowest = F.struct(-F.col("total"), F.col("category")), F.struct("total", "category")
        body = F.struct("total", "count")
        return kept(self.groups.groupBy("dimension").agg(
            F.count(F.lit(1)).alias("groups"), F.sum("total").alias("whole"),
            F.min_by("category", highest).alias("top"), F.min_by(body, highest).alias("top_facts"),
            F.min_by("category", lowest).alias("bottom"), F.min_by(body, lowest).alias("bottom_facts"),
        ).filter("groups >= 2"))

    @cached_property
    def days(self) -> DataFrame:
        """(column, day, n, value) of all dates, value being the primary measure's sum, or rows: one scan."""
        return kept(day_facts(self.df, self.roles.dates, self.roles.primary))

    @cached_property
    def pairs(self) -> DataFrame:
        """(a, b, r, n) of all pairs of measures, each also with itself: one scan of each 150 pairs."""
        names = self.roles.measures
        return kept(_pairwise(self.df, list(combinations(names, 2)) + [(n, n) for n in names]))

    @cached_property
    def examples(self) -> DataFrame:
        """The rows that hold the primary measure's ends: two scans."""
        return kept(extreme_examples(self.df, self.roles.primary, self.roles))

    def of_measure(self, name: str) -> DataFrame:
        """One row: a measure's moments with its quartiles and outliers."""
        q = self.quartiles_of([name]).drop("n")
        return self.columns.filter(F.col("column") == name).join(F.broadcast(q), "column")

    def at(self, name: str) -> Column:
        """The place of a column's name in the table, for an order without a sort of the table itself."""
        return F.array_position(F.array(*[F.lit(n) for n in self.df.columns]), F.col(name))


def _facts(df: DataFrame, roles: Roles | None, facts: ReportFacts | None, keep: bool = False) -> ReportFacts:
    return facts or ReportFacts(stored(df) if keep else df, roles)


def _spans(facts: ReportFacts) -> DataFrame:
    """Valid values, first and last day, different days and span in days per date column."""
    return facts.days.groupBy("column").agg(
        F.sum("n").alias("valid"), F.min("day").alias("earliest"), F.max("day").alias("latest"),
        F.count(F.lit(1)).alias("unique_days"), (F.datediff(F.max("day"), F.min("day")) + 1).alias("span_days"))


def _modes(facts: ReportFacts, names: list[str]) -> DataFrame:
    """Distinct values, the first modes, their number, frequency and share per column."""
    text = F.concat(F.array_join("modes", ", "), F.when(F.col("n_modes") > F.size("modes"), "...").otherwise(""))
    return facts.frequencies_of(names).select(
        "column", "unique_values", text.alias("top"), "n_modes", F.col("top_frequency").alias("frequency"),
        percent(F.col("top_frequency"), F.col("filled")).alias("share"))


def _first_days(facts: ReportFacts) -> DataFrame:
    return facts.days.filter(F.col("column") == facts.roles.dates[0]).select("day", "value")


def insights(df: DataFrame, roles: Roles | None = None, facts: ReportFacts | None = None, categories: int | None = None,
             keep: bool = False) -> DataFrame:
    """Verified insights as rows: what they are about and their figures as a map. categories: how many categorical columns
    are told of, by their place; all by default. With keep the input is written to the checkpoint folder first: worth it
    when it comes from joins, which would be made again for each of the facts."""
    facts = _facts(df, roles, facts, keep)
    roles = facts.roles
    primary, secondary = roles.primary, roles.secondary
    frames = []
    if primary:
        frames.append(facts.examples.select(*_row(
            "extreme", F.lit(primary), which=F.col("kind"), value=_num(F.col("value")),
            records=F.col("records"), example=F.col("example"),
        )))
        frames.append(facts.of_measure(primary).filter(F.col("count") >= 4).select(*_row(
            "distribution", F.col("column"), shape=shape_word(F.col("skew")), skew=_num(F.col("skew")),
            mean=_num(F.col("mean")), median=_num(F.col("median")), outliers=F.col("outliers"),
            outlier_pct=_num(percent(F.col("outliers"), F.col("count"))),
        )))
    if primary and secondary:
        pair = strength_of(_pair(facts, primary, secondary)).filter("strength is not null")
        frames.append(pair.select(*_row(
            "relationship", F.concat(F.col("a"), F.lit(" / "), F.col("b")), r=_num(F.col("r"), 3),
            strength=F.col("strength"), direction=F.col("direction"), exploratory=F.col("exploratory"),
        )))
    if roles.categorical:
        first = roles.categorical[:categories]
        frames.append(_modes(facts, first).select(*_row(
            "most frequent", F.col("column"), value=F.col("top"), modes=F.col("n_modes"),
            records=F.col("frequency"), share=_num(F.col("share"), 1),
        )))
        if primary:
            frames.append(facts.ends.filter(F.col("dimension").isin(first)).select(*_row(
                "group performance", F.col("dimension"), top=F.col("top"), top_total=_num(F.col("top_facts.total")),
                top_records=F.col("top_facts.count"),
                top_share=_num(percent(F.col("top_facts.total"), F.nullif(F.col("whole"), F.lit(0.0)))),
                bottom=F.col("bottom"), bottom_total=_num(F.col("bottom_facts.total")),
            )))
    if roles.dates:
        frames.append(_spans(facts).filter(F.col("column") == roles.dates[0]).select(*_row(
            "period", F.col("column"), earliest=F.col("earliest"), latest=F.col("latest"),
            days=F.col("span_days"), unique_days=F.col("unique_days"),
        )))
    return union_all(frames)


def _pair(facts: ReportFacts, a: str, b: str) -> DataFrame:
    """The pair's row, by the names it was asked for."""
    found = ((F.col("a") == a) & (F.col("b") == b)) | ((F.col("a") == b) & (F.col("b") == a))
    if a not in facts.roles.measures or b not in facts.roles.measures:
        return _pairwise(facts.df, [(a, b)])
    return facts.pairs.filter(found).select(F.lit(a).alias("a"), F.lit(b).alias("b"), "r", "n")


def _best(facts: ReportFacts) -> DataFrame:
    """The pair with the strongest absolute correlation; ties go to the earlier pair."""
    found = facts.pairs.filter("a <> b and r is not null")
    return found.orderBy(F.abs("r").desc(), facts.at("a"), facts.at("b")).limit(1)


def recommendations(df: DataFrame, roles: Roles | None = None, facts: ReportFacts | None = None, segments: int = 2) -> DataFrame:
    """Which follow-ups the data calls for, in order of priority: gaps, duplicates, the first categories' segments (the
    first of them to compare, the others to monitor), time, correlation; a fallback if there is nothing."""
    facts = _facts(df, roles, facts)
    roles = facts.roles
    primary = roles.primary
    none = F.lit(None).cast("string")

    def rows(source: DataFrame, order: int, kind: str, subject: Column, detail: Column) -> DataFrame:
        return source.select(
            F.lit(order).alias("priority"), F.lit(kind).alias("kind"),
            subject.cast("string").alias("subject"), detail.cast("string").alias("detail"),
        )

    frames = [
        rows(facts.summary.filter("missing_cells > 0"), 1, "review missing values", none, F.col("missing_cells")),
        rows(facts.summary.filter("duplicate_rows > 0"), 2, "review duplicates", none, F.col("duplicate_rows")),
    ]
    for k, key in enumerate(roles.categorical[:segments] if primary else []):
        ends = facts.ends.filter(F.col("dimension") == key)
        kind = (3, "compare segments", F.concat(F.col("top"), F.lit(" .. "), F.col("bottom"))) if k == 0 else (4, "monitor segments", F.lit(primary))
        frames.append(rows(ends, kind[0], kind[1], F.lit(key), kind[2]))
    if primary and roles.dates:
        series = periods_of_days(_first_days(facts)).filter(F.col("value").isNotNull()).agg(
            F.count(F.lit(1)).alias("n"), F.max("grain").alias("grain")
        ).filter("n >= 2")
        frames.append(rows(series, 5, "track over time", F.lit(primary), F.col("grain")))
    if len(roles.measures) >= 2:
        subject = F.concat(F.col("a"), F.lit(" / "), F.col("b"))
        frames.append(rows(_best(facts), 6, "explore correlation", subject, _num(F.col("r"), 3)))
    found = union_all(frames)
    # a handful of rows, so counting them again is nothing
    count = found.agg(F.count(F.lit(1)).alias("n"))
    fallback = rows(count.filter("n = 0"), 7, "use as a baseline", none, none)
    return found.unionByName(fallback).orderBy("priority")


def executive_summary(df: DataFrame, roles: Roles | None = None, facts: ReportFacts | None = None, keep: bool = False) -> DataFrame:
    """One row: size, roles, gaps, the primary measure's range and its leading category. keep: as for insights."""
    facts = _facts(df, roles, facts, keep)
    roles = facts.roles
    out = facts.summary.select(
        "rows", "columns", F.lit(len(roles.numeric)).alias("numeric"),
        F.lit(len(roles.categorical)).alias("categorical"), F.lit(len(roles.dates)).alias("dates"),
        "missing_cells", "duplicate_rows",
    )
    if not roles.primary:
        return out
    of = facts.columns.filter(F.col("column") == roles.primary).join(F.broadcast(facts.quartiles_of([roles.primary]).select("column", "median")), "column", "left")
    out = out.crossJoin(of.select(F.lit(roles.primary).alias("primary"), "mean", "median", "min", "max"))  # one row each
    if not roles.categorical:
        return out
    top = facts.ends.filter(F.col("dimension") == roles.categorical[0]).agg(F.max("top").alias("leading_category"))
    return out.crossJoin(top)


def _columns(facts: ReportFacts) -> DataFrame:
    """The report's column description: detected type, missing share, spread and quartiles."""
    kind = (
        F.when(F.col("column").isin(facts.roles.dates), "Date/Time")
        .when(F.col("column").isin(facts.roles.numeric), "Numeric")
        .otherwise("Categorical")
    )
    gaps = F.col("rows") - F.col("filled")
    rows = facts.columns.join(F.broadcast(facts.frequencies.select("column", "unique_values")), "column", "left")
    rows = rows.join(F.broadcast(facts.quartiles.select("column", *QUARTILES)), "column", "left")
    return rows.select(
        "position", "column", kind.alias("detected_type"), F.coalesce("unique_values", F.lit(0)).alias("unique_values"),
        gaps.alias("missing"), percent(gaps, F.col("rows")).alias("missing_pct"),
        "min", "max", "mean", "median", "std", "q1", "q3")


def report_tables(df: DataFrame, roles: Roles | None = None, groups: int = 10, values: int = 10, preview: int = 5) -> dict[str, DataFrame]:
    """All sections of a report as tables. What they say is gathered once (ReportFacts); a section is a projection of it.
    groups, values and preview are how many rows the top lists and the preview show."""
    facts = ReportFacts(df, roles)
    roles = facts.roles
    primary = roles.primary
    facts.quartiles  # of all columns, before a section asks for one  # noqa: B018
    number = F.col("column").isin(roles.numeric)
    tables = {
        "overview": executive_summary(df, facts=facts),
        "columns": _columns(facts),
        "quality_gate": dq_issues(df, facts),
        "quality_score": quality_score(df, roles, facts),
        "quality_findings": quality_findings(df, facts),
        "quality_actions": quality_actions(df, roles, facts),
        "recommendations": recommendations(df, facts=facts),
        "insights": insights(df, facts=facts),
    }
    if roles.numeric:
        per = facts.columns.filter(number).join(F.broadcast(facts.quartiles.select("column", *QUARTILES, "iqr", "outliers")), "column", "left")
        tables["numeric_statistics"] = per.select(
            "column", "count", "mean", "median", "std", "variance", "q1", "q3", "min", "max", "skew",
            F.try_divide(F.col("std") * 100.0, F.col("mean")).alias("cv"))
        enough = F.col("count") >= 4
        status = F.when(~enough, "not assessed").when(F.col("outliers") > 0, "potential outliers").otherwise("no outliers")
        tables["outliers"] = per.select(
            "column", F.col("count").alias("n"), *[F.when(enough, F.col(c)).alias(c) for c in ("q1", "q3", "iqr", "outliers")], status.alias("status"))
    if roles.categorical:
        tables["categorical_statistics"] = _modes(facts, roles.categorical)
        tables["top_categories"] = top_values(df, roles.categorical, values)
    if primary and roles.categorical:
        tables["group_performance"] = shares_of_groups(facts.groups, groups)
        own = facts.groups.filter(F.col("dimension") == roles.categorical[0])
        tables["chart_ranked"] = own.select(F.col("category").alias("x"), F.col("total").alias("value")).orderBy(F.desc("value"), "x").limit(15)
    if roles.dates:
        periods = periods_of_days(_first_days(facts))
        tables["dates"] = _spans(facts)
        tables["time_series"] = periods.filter(F.col("value").isNotNull()).select("period", "grain", "value")
        tables["time_extremes"] = extremes_of_periods(periods)
    if len(roles.measures) >= 2:
        both = F.explode(F.when(F.col("a") == F.col("b"), F.array(F.struct("a", "b"))).otherwise(
            F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))).alias("p")
        tables["correlations"] = facts.pairs.select(both, "r").select("p.a", "p.b", "r")
        tables["best_correlation"] = _best(facts)
        tables["relationship"] = strength_of(_pair(facts, primary, roles.secondary))
    if primary:
        tables["chart_histogram"] = histogram(df, primary)
        box = facts.finite_quartiles.filter((F.col("column") == primary) & (F.col("n") >= 2))
        tables["chart_box"] = box.select(
            F.col("column").alias("group"), "n", *QUARTILES, "whisker_low", "whisker_high", F.col("outside").alias("outliers"))
    tables["preview"] = df.orderBy(*[col(c) for c in df.columns]).limit(preview)
    return tables


def write_report(
    df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite", keep: bool = False
) -> list[str]:
    """Write one table per section under ``path`` and return the section names.

    With ``keep`` the input is persisted while the sections are computed: worth it when
    it comes from joins, not when it is a columnar table larger than the cluster's memory.
    """
    if keep:
        df.persist()
    try:
        tables = report_tables(df)
        for name, table in tables.items():
            write_table(table, f"{path.rstrip('/')}/{name}", fmt, mode)
        return list(tables)
    finally:
        if keep:
            df.unpersist()

"""The data-quality gate: one function per check, all returning issue rows.

A gate run gathers the facts of a table once (``operators/facts.py``). The checks
themselves look at those facts only, which are as many as the table has columns.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlore.functions import names as N
from gridlore.functions.columns import as_number, col, numeric_columns, percent, strip, text_columns
from gridlore.functions.shapes import per_column, union_all
from gridlore.operators.facts import TableFacts
from gridlore.operators.roles import Roles, roles_of
from gridlore.sources.files import unique_names

__all__ = [
    "QualityFacts", "dq_structure", "dq_empty_dataset", "dq_empty_columns", "dq_empty_rows",
    "dq_missing_values", "dq_duplicates", "dq_non_finite", "dq_numeric_as_text",
    "dq_invalid_dates", "dq_category_variants", "dq_constant_columns", "dq_high_cardinality",
    "dq_negative_values", "dq_outliers", "dq_issues", "dq_status", "cleaning_plan",
    "whitespace_columns", "quality_findings", "quality_actions", "negative_counts",
    "negative_total", "quality_score",
]

# Issue names, their order and category, and the thresholds of the gate.
ISSUES = {
    "empty_dataset": (0, "Empty dataset", "quality"),
    "placeholder_names": (1, "Blank / placeholder column names", "quality"),
    "duplicate_names": (2, "Duplicate column names", "quality"),
    "empty_columns": (3, "Completely empty columns", "quality"),
    "empty_rows": (4, "Completely empty rows", "quality"),
    "high_missing": (5, "Extremely high missing values", "missing"),
    "duplicates": (6, "Duplicate records", "duplicate"),
    "non_finite": (7, "Non-finite numeric values", "numeric"),
    "numeric_text": (8, "Numeric values stored as text / mixed numeric type", "data_type"),
    "invalid_dates": (9, "Invalid / inconsistent date values", "date"),
    "variants": (10, "Inconsistent categorical values", "category"),
    "constant": (11, "Constant / zero-variation columns", "structure"),
    "negative": (12, "Potentially invalid negative values", "validity"),
    "outliers": (13, "Potential outliers", "outlier"),
    "missing_present": (14, "Missing values present", "info"),
    "high_cardinality": (15, "High-cardinality field", "info"),
}
EMPTY_ROWS_BLOCK = 5.0
MISSING_WARN, MISSING_BLOCK = 50.0, 70.0
DUPLICATES_BLOCK = 20.0
BAD_VALUES_BLOCK = 10.0
MIN_VALUES = 20
NUMERIC_RATIO = 0.80
DATE_RATIO = 0.50
CARDINALITY_MIN, CARDINALITY_RATIO = 50, 0.95
OUTLIER_MIN, OUTLIER_DISTINCT, OUTLIER_PCT = 30, 5, 1.0

# What an issue means and what to do about it: reason, action, expected result.
ADVICE = {
    "empty_dataset": ("Nothing can be computed from zero rows.", "Load a table that has rows.", None),
    "placeholder_names": (
        "A field without a real name cannot be referred to.", "Give every field a meaningful name.",
        "Fields can be referred to without ambiguity."),
    "duplicate_names": (
        "Two fields of one name cannot be told apart.", "Rename repeated fields.",
        "Every field has its own name."),
    "empty_columns": (
        "A field without values supports no analysis.", "Drop the field or fill it at the source.",
        "Only usable fields remain."),
    "empty_rows": (
        "Blank records inflate counts.", "Remove blank records.", "Counts cover real records only."),
    "high_missing": (
        "Too few values are left to rely on.", "Decide how missing values of this field are treated.",
        "Enough observations are usable."),
    "duplicates": (
        "Repeated records inflate sums and counts.", "Confirm which repeats are accidental and drop those.",
        "Totals and frequencies are not inflated."),
    "non_finite": (
        "Infinite values break averages and charts.", "Replace infinite values by the domain's rule.",
        "Calculations stay finite."),
    "numeric_text": (
        "Values that are not numbers drop out of calculations.", "Convert the field and repair the rest.",
        "Numeric aggregation works on all values."),
    "invalid_dates": (
        "Rows without a readable date drop out of time analysis.", "Use one date format throughout.",
        "Sorting and grouping by time is reliable."),
    "variants": (
        "One category is split over several spellings.", "Unify spelling, case and blanks.", None),
    "constant": ("A field without variation explains nothing.", "Review whether the field is needed.", None),
    "negative": (
        "The field's name suggests values of zero or more.", "Check the definition before correcting.", None),
    "outliers": (
        "Extreme values pull averages and scales.", "Look at the extreme records before deciding.", None),
    "missing_present": ("Some cells are missing.", "Keep in mind when aggregating.", None),
    "high_cardinality": ("Almost every value is different.", "Treat as a label, not as a category.", None),
}
DEFAULT_RESULT = "Later analysis is more reliable."


def share(part: Column, whole: Column) -> Column:
    """Percentage rounded to two decimals; thresholds apply to the rounded value."""
    return F.coalesce(F.round(percent(part, whole), 2), F.lit(0.0))


class QualityFacts:
    """What the checks look at: a row per column. ``parts`` names the costlier facts to gather: text values
    ("variants"), text columns of many values ("distinct"), quartiles ("outliers")."""

    PARTS = ("variants", "distinct", "outliers")

    def __init__(self, df: DataFrame, parts: tuple[str, ...] = PARTS, facts: TableFacts | None = None):
        self.facts, self.parts = facts or TableFacts(df), parts

    @cached_property
    def table(self) -> DataFrame:
        """Position, column and all facts; facts that were not asked for are NULL."""
        none = F.lit(None).cast("long")
        rows = self.facts.columns
        if "variants" in self.parts:
            rows = rows.join(F.broadcast(self.facts.variants), "column", "left")
        elif "distinct" in self.parts:
            counted = self.facts.distinct_texts(CARDINALITY_RATIO)
            rows = rows.join(F.broadcast(counted), "column", "left").withColumns({"raw": none, "unified": none, "affected": none})
        else:
            rows = rows.withColumns({"distinct": none, "raw": none, "unified": none, "affected": none})
        if "outliers" in self.parts:
            found = self.facts.finite_quartiles.select("column", "n", "iqr", "outliers")
            # only columns with outliers are asked how many values they hold
            asked = [r["column"] for r in found.filter("outliers > 0").collect()]
            several = self.facts.several(asked, OUTLIER_DISTINCT)
            enough = F.col("column").isin([n for n in asked if several[n]])
            return rows.join(F.broadcast(found.withColumn("several", enough)), "column", "left")
        return rows.withColumns({"n": none, "iqr": none.cast("double"), "outliers": none, "several": F.lit(None).cast("boolean")})

    @cached_property
    def packed(self) -> DataFrame:
        """All facts in one row, as a list as long as the schema is wide."""
        rows = self.table
        listed = F.sort_array(F.collect_list(F.struct("position", *[col(c) for c in rows.columns if c != "position"])))
        return rows.agg(listed.alias("facts"))


_SCHEMA = (
    "array<struct<seq:bigint,issue:string,severity:string,columns:array<string>,affected_rows:bigint,"
    "affected_pct:double,observed:string,why:string,recommended_action:string,category:string>>"
)


def _issue(
    kind: str, found: Column, severity: Column | str, columns: Column | None = None,
    position: Column | None = None, affected: Column | None = None, pct: Column | None = None,
) -> Column:
    """The issue as a struct, or NULL when it was not found."""
    order, name, category = ISSUES[kind]
    why, action, _ = ADVICE[kind]
    columns = (F.array() if columns is None else columns).cast("array<string>")
    affected = (F.lit(None) if affected is None else affected).cast("long")
    observed = F.concat_ws(
        "", F.lit(name), F.concat(F.lit(": "), F.nullif(F.array_join(columns, ", "), F.lit(""))),
        F.concat(F.lit(" ("), affected.cast("string"), F.lit(" affected)")),
    )
    return F.when(found, F.struct(
        (F.lit(order) * 10000 + (F.lit(0) if position is None else position)).cast("long").alias("seq"),
        F.lit(name).alias("issue"),
        (F.lit(severity) if isinstance(severity, str) else severity).alias("severity"),
        columns.alias("columns"), affected.alias("affected_rows"),
        (F.lit(None) if pct is None else pct).cast("double").alias("affected_pct"),
        observed.alias("observed"), F.lit(why).alias("why"),
        F.lit(action).alias("recommended_action"), F.lit(category).alias("category"),
    ))


def _block_from(pct: Column, limit: float) -> Column:
    return F.when(pct >= limit, "BLOCKING").otherwise("WARNING")


def _rows(packed: DataFrame, *issues: Column) -> DataFrame:
    """Issue rows from a list of issue arrays."""
    return packed.select(F.inline(F.concat(*[F.array_compact(i).cast(_SCHEMA) for i in issues])))


# Checks of one column's facts ``x`` and checks of the whole list of facts ``xs``.

def _of_column(kind: str, x: Column, found: Column, severity: Column | str, affected: Column, whole: Column) -> Column:
    pct = share(affected, whole)
    return _issue(
        kind, found, severity, F.array(x["column"]), x["position"], affected, pct,
    )


def _gap_pct(x: Column) -> Column:
    return share(x["rows"] - x["filled"], x["rows"])


def _high_missing(x: Column) -> Column:
    return _of_column(
        "high_missing", x, (x["rows"] > 0) & (_gap_pct(x) >= MISSING_WARN),
        _block_from(_gap_pct(x), MISSING_BLOCK), x["rows"] - x["filled"], x["rows"],
    )


def _non_finite(x: Column) -> Column:
    return _of_column("non_finite", x, x["infinite"] > 0, "BLOCKING", x["infinite"], x["rows"])


def _unreadable(kind: str, x: Column, good: Column, low: float) -> Column:
    found = (x["filled"] >= MIN_VALUES) & (good / x["filled"] >= low) & (good < x["filled"])
    bad = x["filled"] - good
    return _of_column(kind, x, found, _block_from(share(bad, x["filled"]), BAD_VALUES_BLOCK), bad, x["filled"])


def _numeric_text(x: Column) -> Column:
    return _unreadable("numeric_text", x, x["numbers"], NUMERIC_RATIO)


def _invalid_dates(x: Column) -> Column:
    return _unreadable("invalid_dates", x, x["dates"], DATE_RATIO)


def _category_variants(x: Column) -> Column:
    found = (x["filled"] >= MIN_VALUES) & (x["raw"] > x["unified"])
    return _of_column("variants", x, found, "WARNING", x["affected"], x["filled"])


def _negative(x: Column) -> Column:
    return _of_column("negative", x, x["measure_name"] & (x["negative"] > 0), "WARNING", x["negative"], x["filled"])


def _outliers(x: Column) -> Column:
    found = (
        (x["n"] >= OUTLIER_MIN) & x["several"] & (x["iqr"] > 0)
        & (x["outliers"] > 0) & (share(x["outliers"], x["n"]) >= OUTLIER_PCT)
    )
    return _of_column("outliers", x, found, "WARNING", x["outliers"], x["n"])


def _high_cardinality(x: Column) -> Column:
    found = (
        x["is_text"] & (x["filled"] >= CARDINALITY_MIN)
        & (x["distinct"] / x["filled"] >= CARDINALITY_RATIO)
    )
    return _of_column("high_cardinality", x, found, "INFO", x["distinct"], x["filled"])


def _names(xs: Column, keep) -> Column:
    return F.transform(F.filter(xs, keep), lambda x: x["column"])


def _empty_dataset(xs: Column) -> Column:
    return _issue("empty_dataset", F.get(xs, F.lit(0))["rows"] == 0, "BLOCKING")


def _empty_columns(xs: Column) -> Column:
    names = _names(xs, lambda x: (x["filled"] == 0) & (x["rows"] > 0))
    return _issue("empty_columns", F.size(names) > 0, "BLOCKING", names)


def _empty_rows(xs: Column) -> Column:
    first = F.get(xs, F.lit(0))
    pct = share(first["empty_rows"], first["rows"])
    return _issue(
        "empty_rows", first["empty_rows"] > 0, _block_from(pct, EMPTY_ROWS_BLOCK),
        affected=first["empty_rows"], pct=pct,
    )


def _some_missing(xs: Column) -> Column:
    gaps = F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + x["rows"] - x["filled"])
    high = F.exists(xs, lambda x: _gap_pct(x) >= MISSING_WARN)
    return _issue("missing_present", (gaps > 0) & ~high, "INFO", affected=gaps)


def _constant(xs: Column) -> Column:
    names = _names(xs, lambda x: (x["rows"] > 0) & x["single"])
    return _issue("constant", F.size(names) > 0, "WARNING", names)


COLUMN_CHECKS = (
    _high_missing, _non_finite, _numeric_text, _invalid_dates, _category_variants, _negative,
    _outliers, _high_cardinality,
)
TABLE_CHECKS = (_empty_dataset, _empty_columns, _empty_rows, _some_missing, _constant)


def _check(df: DataFrame, parts: tuple[str, ...], column=(), table=(), facts: TableFacts | None = None) -> DataFrame:
    """Run checks on the facts they need, in one plan."""
    packed = QualityFacts(df, parts, facts).packed
    found = []
    if column:
        found.append(F.flatten(F.transform("facts", lambda x: F.array(*[c(x) for c in column]))))
    if table:
        found.append(F.array(*[c(F.col("facts")) for c in table]))
    return _rows(packed, *found)


def dq_structure(df: DataFrame) -> DataFrame:
    """Blank, placeholder or repeated column names. Reads the schema only."""
    blank = [c for c in df.columns if N.is_placeholder_name(c)]
    repeated = sorted({c for c in df.columns if df.columns.count(c) > 1})
    named = [
        _issue(kind, F.lit(bool(cols)), "BLOCKING", F.array(*[F.lit(c) for c in cols]))
        for kind, cols in (("placeholder_names", blank), ("duplicate_names", repeated))
    ]
    return _rows(df.sparkSession.range(1), F.array(*named))


def dq_empty_dataset(df: DataFrame) -> DataFrame:
    return _check(df, (), table=(_empty_dataset,))


def dq_empty_columns(df: DataFrame) -> DataFrame:
    return _check(df, (), table=(_empty_columns,))


def dq_empty_rows(df: DataFrame) -> DataFrame:
    return _check(df, (), table=(_empty_rows,))


def dq_missing_values(df: DataFrame) -> DataFrame:
    """Columns at least half missing; if there is none, an INFO row when anything is missing."""
    return _check(df, (), column=(_high_missing,), table=(_some_missing,))


def dq_duplicates(df: DataFrame, facts: TableFacts | None = None) -> DataFrame:
    facts = facts or TableFacts(df)
    copies = df.sparkSession.createDataFrame([(facts.size, facts.duplicate_rows)], "rows long, duplicate_rows long")
    n = F.col("duplicate_rows")
    pct = share(n, F.col("rows"))
    return _rows(copies, F.array(
        _issue("duplicates", n > 0, _block_from(pct, DUPLICATES_BLOCK), affected=n, pct=pct)
    ))


def dq_non_finite(df: DataFrame) -> DataFrame:
    return _check(df, (), column=(_non_finite,))


def dq_numeric_as_text(df: DataFrame) -> DataFrame:
    return _check(df, (), column=(_numeric_text,))


def dq_invalid_dates(df: DataFrame) -> DataFrame:
    return _check(df, (), column=(_invalid_dates,))


def dq_category_variants(df: DataFrame) -> DataFrame:
    """Text columns whose values collapse when case and surrounding blanks are unified."""
    return _check(df, ("variants",), column=(_category_variants,))


def dq_constant_columns(df: DataFrame) -> DataFrame:
    """Columns with at most one different value; empty ones count too."""
    return _check(df, (), table=(_constant,))


def dq_high_cardinality(df: DataFrame) -> DataFrame:
    return _check(df, ("distinct",), column=(_high_cardinality,))


def dq_negative_values(df: DataFrame) -> DataFrame:
    return _check(df, (), column=(_negative,))


def dq_outliers(df: DataFrame) -> DataFrame:
    """Numeric columns with at least 1 % of their finite values outside the fences."""
    return _check(df, ("outliers",), column=(_outliers,))


def dq_issues(df: DataFrame, facts: TableFacts | None = None) -> DataFrame:
    """All findings of the gate as rows, in the order of ``seq``.

    An empty table or one without columns has that single finding. Columns that share a name are looked at one by one,
    the second of a name ``a`` being named ``a_2``.
    """
    if not df.columns:
        no_columns = _issue("empty_dataset", F.lit(True), "BLOCKING").withField("issue", F.lit("No columns"))
        return _rows(df.sparkSession.range(1), F.array(no_columns))
    names = unique_names(df.columns)
    facts = facts or TableFacts(df.toDF(*names) if names != df.columns else df)
    found = _check(facts.df, QualityFacts.PARTS, COLUMN_CHECKS, TABLE_CHECKS, facts)
    return union_all([found, dq_structure(df), dq_duplicates(facts.df, facts)])


def dq_status(df: DataFrame, issues: DataFrame | None = None) -> DataFrame:
    """One row: ready unless anything blocks, with the number of findings by severity."""
    issues = dq_issues(df) if issues is None else issues
    count = lambda s: F.count_if(F.col("severity") == s)
    status = F.when(F.col("blocking") > 0, "NOT READY").otherwise("READY")
    return issues.agg(
        count("BLOCKING").alias("blocking"), count("WARNING").alias("warnings"),
        count("INFO").alias("info"),
    ).select(status.alias("status"), (F.col("blocking") == 0).alias("analysis_ready"),
             "blocking", "warnings", "info")


def cleaning_plan(df: DataFrame, issues: DataFrame | None = None) -> DataFrame:
    """Blocking findings first, then warnings, numbered, each with what fixing it achieves."""
    issues = dq_issues(df) if issues is None else issues
    todo = issues.filter(F.col("severity").isin("BLOCKING", "WARNING"))
    results = F.create_map(*[
        x for kind, (_, name, _) in ISSUES.items()
        for x in (F.lit(name), F.lit(ADVICE[kind][2] or DEFAULT_RESULT))
    ])
    # a few rows per column of the schema
    order = Window.orderBy(F.when(F.col("severity") == "BLOCKING", 0).otherwise(1), "seq")
    return todo.select(
        F.row_number().over(order).cast("long").alias("priority"), "issue", "severity", "columns", "recommended_action", "why",
        results[F.col("issue")].alias("expected_result"),
    )


# --- report side ------------------------------------------------------------

def whitespace_columns(df: DataFrame) -> DataFrame:
    """Text columns with values that begin or end with white space, and how many."""
    names = text_columns(df)
    counts = per_column(df, names, lambda n: {"affected": F.count_if(col(n) != strip(col(n)))})
    return counts.filter("affected > 0").select("column", "affected")


def negative_counts(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Negative values per numeric column and their share of the non-missing ones."""
    names = numeric_columns(df) if names is None else names
    counts = per_column(df, names, lambda n: {
        "negative": F.count_if(as_number(df, n) < 0), "filled": F.count(as_number(df, n)),
    })
    return counts.select("column", "negative", percent(F.col("negative"), F.col("filled")).alias("share"))


def negative_total(df: DataFrame) -> DataFrame:
    """One row: does any numeric column hold negative values, and how many in all."""
    total = F.coalesce(F.sum("negative"), F.lit(0))
    return negative_counts(df).agg((total > 0).alias("present"), total.alias("negative_values"))


def _constant_with_missing() -> Column:
    """Whether a column has at most one different value when missing counts as a value."""
    return F.col("single") & ((F.col("filled") == 0) | (F.col("filled") == F.col("rows")))


def quality_findings(df: DataFrame, facts: TableFacts | None = None) -> DataFrame:
    """The report's quality section as rows: duplicates, gaps, blanks, constants, negatives, outliers."""
    facts = facts or TableFacts(df)
    none = F.lit(None).cast("string")

    def rows(source: DataFrame, kind: str, column: Column, n: Column | None) -> DataFrame:
        n = (F.lit(None) if n is None else n).cast("long")
        return source.select(F.lit(kind).alias("finding"), column.alias("column"), n.alias("n"))

    per = facts.columns
    frames = [
        rows(facts.summary.filter("duplicate_rows > 0"), "duplicate rows", none, F.col("duplicate_rows")),
        rows(per.filter("filled < rows"), "missing values", F.col("column"), F.col("rows") - F.col("filled")),
        rows(per.filter(_constant_with_missing()), "constant", F.col("column"), None),
        rows(per.filter("blanks > 0"), "whitespace", F.col("column"), F.col("blanks")),
        rows(per.filter("measure_name and negative > 0"), "negative values", F.col("column"), F.col("negative")),
    ]
    if facts.numbers:
        assessed = per.select("column", "count").join(F.broadcast(facts.quartiles), "column")
        frames.append(rows(assessed.filter("count >= 4 and outliers > 0"), "outliers", F.col("column"), F.col("outliers")))
    return union_all(frames)


def quality_actions(df: DataFrame, roles: Roles | None = None, facts: TableFacts | None = None) -> DataFrame:
    """Which checks were made and which need a review."""
    roles, facts = roles or roles_of(df), facts or TableFacts(df)
    made = lambda kind, review: F.struct(F.lit(kind).alias("action"), review.alias("review"))
    actions = [
        made("duplicate check", F.col("duplicate_rows") > 0),
        made("missing-value check", F.col("missing_cells") > 0),
        made("date fields", F.lit(not roles.dates)),
    ]
    if roles.categorical:
        actions.append(made("category profile", F.lit(False)))
    if roles.numeric:
        actions.append(made("numeric profile", F.lit(False)))
    rows = facts.summary.select(F.inline(F.array(*actions)))
    negative = facts.columns.filter(F.col("column").isin(roles.numeric) & F.col("measure_name") & (F.col("negative") > 0))
    return rows.unionByName(negative.select(
        F.concat(F.lit("negative values: "), F.col("column")).alias("action"), F.lit(True).alias("review")
    ))


def quality_score(df: DataFrame, roles: Roles | None = None, facts: TableFacts | None = None) -> DataFrame:
    """One row: a 0-100 screening score with bounded penalties and its band."""
    facts = facts or TableFacts(df)
    counted = facts.columns.agg(
        F.max("rows").alias("rows"), F.sum(F.col("rows") - F.col("filled")).alias("gaps"), F.count_if(_constant_with_missing()).alias("constant"),
        F.count_if(F.col("blanks") > 0).alias("blank"),
    ).withColumn("duplicate_rows", F.lit(facts.duplicate_rows))
    # columns with fewer than four values aren't assessed, but their values count
    assessed = facts.columns.filter(F.col("column").isin(facts.numbers)).select("column", "count").join(
        F.broadcast(facts.quartiles.select("column", "outliers")), "column", "left")
    outliers = assessed.agg(F.coalesce(F.sum(F.when(F.col("count") >= 4, F.col("outliers"))), F.lit(0)).alias("outliers"), F.sum("count").alias("values"))
    width, rows = max(len(df.columns), 1), F.greatest(F.col("rows"), F.lit(1))
    parts = counted.crossJoin(outliers).select(  # one row each
        percent(F.col("gaps"), rows * width).alias("missing_pct"),
        percent(F.col("duplicate_rows"), rows).alias("duplicate_pct"),
        percent(F.col("constant"), F.lit(width)).alias("constant_pct"),
        percent(F.col("blank"), F.lit(max(len(facts.texts), 1))).alias("whitespace_pct"),
        F.coalesce(percent(F.col("outliers"), F.col("values")), F.lit(0.0)).alias("outlier_pct"),
    )
    # Weight and bound of each penalty, and the bands.
    weights = {
        "missing_pct": (0.60, 30.0), "duplicate_pct": (0.50, 20.0), "constant_pct": (0.40, 10.0),
        "whitespace_pct": (0.20, 5.0), "outlier_pct": (0.15, 10.0),
    }
    penalty = sum((F.least(F.col(c) * w, F.lit(top)) for c, (w, top) in weights.items()), F.lit(0.0))
    score = F.greatest(F.lit(0.0), F.lit(100.0) - penalty)
    band = (
        F.when(F.col("score") >= 90, "Excellent").when(F.col("score") >= 75, "Good")
        .when(F.col("score") >= 60, "Fair").otherwise("Needs Attention")
    )
    return parts.withColumn("score", score).withColumn("band", band)
